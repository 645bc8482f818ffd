"""Costly work on rows of few input splits is dealt over tasks."""

import pytest

from typeharvest.plans import catalog, corpora
from typeharvest.session import shuffle_width


@pytest.fixture
def one_split(spark, tmp_path):
    path = str(tmp_path)
    spark.range(40).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{path}/part.parquet")
    assert corpora.read(spark, path, "part").rdd.getNumPartitions() == 1
    return path


@pytest.mark.parametrize("name", ["tv8_tv9_variable_summaries", "tv1_tv2_unrolled_text"])
def test_summaries_of_one_split_are_many_tasks(spark, one_split, name):
    df = catalog.queries()[name](spark, one_split)
    assert df.rdd.getNumPartitions() == shuffle_width(spark)
