"""A few registered queries against their SQL; ``oracle_check.py`` runs them all."""

import pytest

import oracle_check as check
from typeharvest.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "ex1_pattern_counts_documents", "ex5_file_info", "p1_p9_predicates", "tv8_tv9_variable_summaries",
    "a6_summary_per_package", "ex6_ex12_extract_annotations", "a13_o5_sorted_distinct_lines",
    "ex14_source_order", "ex17_extract_errors", "snk1_src5_printed_table", "src5_stored_errors", "src1_src4_folder_texts", "src7_package_list",
    "p11_failing_predicate", "snk6_report_lines",
])
def test_query_matches_sql(spark, name):
    assert check.compare(spark, check.connect(SF), name, SF) is None


def test_every_query_has_sql():
    # those of the operators for training data say themselves which SQL can state
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(check.entry.oracle_sql()) <= set(check.entry.queries())
