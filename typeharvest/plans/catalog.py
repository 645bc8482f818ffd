"""Registered queries and, for each, the SQL that states its result.

Queries run the engine's operators over the whole tables. The SQL never repeats
an operator's logic: it joins the known results of each shape to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeharvest.functions import lexical
from typeharvest.functions.predicates import Predicate, PredicateRegistry
from typeharvest.operators import analysis, extract, logs, lowerbounds, summary, typevars
from typeharvest.plans import corpora as C
from typeharvest.session import shuffle_width, tune
from typeharvest.sources import readers, schemas, writers
from typeharvest.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------------------
# SQL helpers
# ---------------------------------------------------------------------------
def _lit(v: object) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], name: str, columns: list[str]) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({', '.join(columns)})"


def _ann_cte() -> str:
    rows = [(i, a, *(f or (None,) * 9), 0 if f else 1) for i, (a, f) in enumerate(C.ANNOTATIONS)]
    t = _values(rows, "t", ["tid", "txt", *C.FLAGS, "W", "Error"])
    flags = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in C.FLAGS)
    return f"""ann AS (SELECT 'Pkg' || (l_partkey % 50) AS Package,
      'src/f' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber || '.jl' AS File,
      replace(txt, '~A', 'N' || l_orderkey) AS TypeAnnotation, CAST(Error AS BIGINT) AS Error,
      CAST(coalesce(W, 1) AS BIGINT) AS Warning, {flags}, CAST(VarCnt > 0 AS BIGINT) AS HasWhere
      FROM lineitem JOIN {t} ON tid = (l_orderkey * 7 + l_linenumber) % {len(C.ANNOTATIONS)})"""


def _code_cte() -> str:
    t = _values([(i, *c[:4]) for i, c in enumerate(C.CODE)], "t", ["tid", "txt", "sub", "sup", "status"])
    lb = _values([(i, v) for i, c in enumerate(C.CODE) for v in c[4]], "b", ["tid", "v"])
    times = f"(CASE WHEN status = 'error' THEN 1 ELSE o_orderkey % {C.REPEATS} + 1 END)"
    return f"""code AS (SELECT 'Pkg' || (o_custkey % 50) AS Package, 'src/f' || o_orderkey || '.jl' AS File, tid, {times} AS times,
      'C' || o_custkey AS fill, CAST(sub * {times} AS BIGINT) AS sub, CAST(sup * {times} AS BIGINT) AS sup, status
      FROM orders JOIN {t} ON tid = o_orderkey % {len(C.CODE)}),
    lbs AS (SELECT Package, File, replace(v, '~A', fill) AS value FROM code JOIN {lb} USING (tid), range(1, {C.REPEATS + 1}) r(k)
      WHERE k <= times)"""


def _key(prefix: str, number: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(number) if isinstance(number, str) else number).cast("string"))


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


ALL_FLAGS = ["Error", "Warning", "VarCnt", "HasWhere", "VarsUsedOnce", "UseSiteVariance", "ImprUseSiteVariance",
             "ExistInInv", "RestrictedScope", "ClosedLowerBound", "TrivConsistBounds"]


def _analyzed(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    return analysis.analyze_annotations(C.annotations(spark, sf), dedupe=True)


def _census(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    return lowerbounds.file_census(C.code_files(spark, sf))


def _sources(spark: SparkSession, sf: str) -> extract.Extracted:
    tune(spark)
    return extract.extract(C.source_files(spark, sf))


def _decls(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    # one split of the table is more work than one task should have
    return analysis.analyze_declarations(C.declarations(spark, sf).repartition(shuffle_width(spark), "id"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.drop("ord").withColumns({c: F.round(c, 9) for c in ("mean", "min", "median", "max", "sum")})


def _summary_sql(cte: str, source: str, columns: list[str], keys: str = "") -> str:
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    parts = " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS variable, round(avg(CAST({c} AS DOUBLE)), 9) AS mean, min(CAST({c} AS DOUBLE)) AS min,"
        f" round(median(CAST({c} AS DOUBLE)), 9) AS median, max(CAST({c} AS DOUBLE)) AS max,"
        f" count(*) - count({c}) AS nmissing, coalesce(sum(CAST({c} AS DOUBLE)), 0) AS sum FROM {source}{group}"
        for c in columns)
    return f"{cte} {parts}"


def _catalog() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    ann, code = "WITH " + _ann_cte(), "WITH " + _code_cte()

    # --- text census -----------------------------------------------------
    q["ex1_pattern_counts_pages"] = (
        lambda s, d: C.read(s, d, "pages").select(
            "page_id", *lexical.pattern_counts("html", {"closing": "</", "selfclosing": "/>", "opening": "<"})),
        "SELECT page_id, " + ", ".join(
            f"CAST((length(html) - length(replace(html, '{p}', ''))) / {len(p)} AS BIGINT) AS {n}"
            for n, p in (("closing", "</"), ("selfclosing", "/>"), ("opening", "<"))) + " FROM pages")
    q["ex1_pattern_counts_documents"] = (
        lambda s, d: C.read(s, d, "documents").select(
            "doc_id", *lexical.pattern_counts("text", {"commas": ", ", "stops": ".", "doubled": "ee"})),
        "SELECT doc_id, " + ", ".join(
            f"CAST((length(text) - length(replace(text, '{p}', ''))) / {len(p)} AS BIGINT) AS {n}"
            for n, p in (("commas", ", "), ("stops", "."), ("doubled", "ee"))) + " FROM documents")
    q["ex1_constraint_counts"] = (
        lambda s, d: lowerbounds.text_counts(C.code_files(s, d)),
        f"{code} SELECT Package, File, sub, sup FROM code")
    q["ex2_non_vacuous_files"] = (
        lambda s, d: lowerbounds.text_counts(C.code_files(s, d)).filter(
            lowerbounds.non_vacuous(F.col("sub"), F.col("sup"))).groupBy("Package").agg(F.count("*").alias("files")),
        f"{code} SELECT Package, count(*) AS files FROM code WHERE sub + sup > 0 GROUP BY Package")

    # --- lower bounds ----------------------------------------------------
    def bounds(s: SparkSession, d: str) -> DataFrame:
        tune(s)
        return lowerbounds.frequencies(lowerbounds.lower_bounds(C.code_files(s, d))[0], ["Package", "File"])

    q["ex3_ex4_lower_bounds_per_file"] = (
        bounds, f"{code} SELECT Package, File, value, count(*) AS freq FROM lbs GROUP BY Package, File, value")
    q["ex5_file_info"] = (
        lambda s, d: _census(s, d).select("Package", "File", "sub", "sup", "status", "lbs", "lbsUnique"),
        f"""{code}, n AS (SELECT Package, File, count(*) AS lbs, count(DISTINCT value) AS u FROM lbs GROUP BY 1, 2)
        SELECT code.Package AS Package, code.File AS File, sub, sup, status,
          CASE WHEN status = 'ok' THEN coalesce(lbs, 0) END AS lbs,
          CASE WHEN status = 'ok' THEN coalesce(u, 0) END AS lbsUnique
        FROM code LEFT JOIN n ON code.Package = n.Package AND code.File = n.File""")
    q["a4_rollup_file_package_corpus"] = (
        lambda s, d: lowerbounds.roll_up(lowerbounds.exploded(_census(s, d))),
        f"""{code} SELECT 'file' AS level, Package, File, count(*) AS lbs, count(DISTINCT value) AS lbsUnique
        FROM lbs GROUP BY Package, File UNION ALL
        SELECT 'package', Package, NULL, count(*), count(DISTINCT value) FROM lbs GROUP BY Package UNION ALL
        SELECT 'corpus', NULL, NULL, count(*), count(DISTINCT value) FROM lbs""")
    q["a4_rollup_constraint_counts"] = (
        lambda s, d: lowerbounds.rollup_counters(
            lowerbounds.text_counts(C.code_files(s, d)), {"sub": F.col("sub"), "sup": F.col("sup")}),
        f"""{code} SELECT 'file' AS level, Package, File, CAST(sum(sub) AS BIGINT) AS sub, CAST(sum(sup) AS BIGINT) AS sup
        FROM code GROUP BY Package, File UNION ALL
        SELECT 'package', Package, NULL, CAST(sum(sub) AS BIGINT), CAST(sum(sup) AS BIGINT) FROM code GROUP BY Package
        UNION ALL SELECT 'corpus', NULL, NULL, CAST(sum(sub) AS BIGINT), CAST(sum(sup) AS BIGINT) FROM code""")
    counters = """SELECT code.Package AS Package, count(*) AS totalFilesNum,
        count(*) FILTER (status = 'error') AS failedFilesNum, count(n.File) AS nonVacFilesNum
        FROM code LEFT JOIN (SELECT DISTINCT Package, File FROM lbs) n
        ON code.Package = n.Package AND code.File = n.File GROUP BY code.Package"""
    q["a5_package_file_counters"] = (
        lambda s, d: lowerbounds.package_counters(_census(s, d)), f"{code} {counters}")
    q["src6_package_census"] = (
        lambda s, d: lowerbounds.package_census(C.packages(s, d), _census(s, d)),
        f"""{code}, c AS ({counters}), n AS (SELECT Package, count(*) AS lbs, count(DISTINCT value) AS u FROM lbs GROUP BY 1)
        SELECT coalesce(p.Package, c.Package) AS Package, c.Package IS NOT NULL AS hasSrc, coalesce(totalFilesNum, 0) AS totalFilesNum,
          coalesce(failedFilesNum, 0) AS failedFilesNum, coalesce(nonVacFilesNum, 0) AS nonVacFilesNum,
          coalesce(lbs, 0) AS lbs, coalesce(u, 0) AS lbsUnique
        FROM (SELECT 'Pkg' || s_suppkey AS Package FROM supplier) p FULL JOIN c ON p.Package = c.Package
        LEFT JOIN n ON coalesce(p.Package, c.Package) = n.Package""")
    q["f12_good_bad_packages"] = (
        lambda s, d: (lambda gb: gb[0].select("Package", F.lit("good").alias("verdict")).unionByName(
            gb[1].select("Package", F.lit("bad").alias("verdict"))))(lowerbounds.split_good_bad(
                C.packages(s, d).join(C.code_files(s, d).select("Package").distinct().withColumn("f", F.lit(True)),
                                      "Package", "left").select("Package", F.col("f").isNotNull().alias("hasSrc")))),
        f"""{code} SELECT 'Pkg' || s_suppkey AS Package,
        CASE WHEN 'Pkg' || s_suppkey IN (SELECT Package FROM code) THEN 'good' ELSE 'bad' END AS verdict FROM supplier""")
    q["f12_labelled_documents"] = (
        lambda s, d: C.read(s, d, "documents").select("doc_id", "lang").join(
            C.read(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("lang").agg(
                F.count("*").alias("bad")),
        "SELECT lang, count(*) AS bad FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
    q["o1_package_ranking"] = (
        lambda s, d: lowerbounds.rank_packages(lowerbounds.package_census(
            C.packages(s, d), _census(s, d))).select("Package", "lbs", "lbsUnique", "interest"),
        f"""{code} SELECT Package, count(*) AS lbs, count(DISTINCT value) AS lbsUnique,
        count(DISTINCT value) * 100 + count(*) AS interest FROM lbs GROUP BY Package""")
    q["o2_value_frequencies"] = (
        lambda s, d: lowerbounds.rank_values(lowerbounds.multiset_sum(lowerbounds.exploded(_census(s, d)), [])),
        f"{code} SELECT value, count(*) AS freq FROM lbs GROUP BY value")
    q["snk6_report_lines"] = (
        lambda s, d: lowerbounds.report_rows(C.packages(s, d), _census(s, d)),
        f"""{code}, c AS ({counters}), pv AS (SELECT Package, value, count(*) AS f FROM lbs GROUP BY 1, 2),
        bad AS (SELECT DISTINCT 'Pkg' || s_suppkey AS Package FROM supplier WHERE 'Pkg' || s_suppkey NOT IN (SELECT Package FROM code)),
        fv AS (SELECT Package, File, value, count(*) AS f FROM lbs GROUP BY 1, 2, 3),
        pl AS (SELECT Package, sum(f) AS n, count(*) AS u, string_agg((CASE WHEN length(value) >= 8 THEN value ELSE
          rpad(value, 8, ' ') END) || ' => ' || f, ', ' ORDER BY f DESC, value) AS body FROM pv GROUP BY 1),
        fl AS (SELECT Package, File, sum(f) AS n, count(*) AS u, string_agg((CASE WHEN length(value) >= 8 THEN value ELSE
          rpad(value, 8, ' ') END) || ' => ' || f, ', ' ORDER BY f DESC, value) AS body FROM fv GROUP BY 1, 2)
        SELECT 1 AS section, CAST(-(u * 100 + n) AS BIGINT) AS rank, pl.Package AS Package, '' AS File,
          pl.Package || ': {{ unique/lbs: ' || u || '/' || n || ',' || chr(10) || '  ' || body || chr(10) || '}}' || chr(10)
          || 'Non vacuous files: ' || nonVacFilesNum || '/' || totalFilesNum AS line
        FROM pl JOIN c ON pl.Package = c.Package
        UNION ALL SELECT 1, CAST(-(pl.u * 100 + pl.n) AS BIGINT), fl.Package, fl.File,
          '* ' || (CASE WHEN length(fl.File) >= 8 THEN fl.File ELSE rpad(fl.File, 8, ' ') END) || ' => (<: ' || sub || ', >: ' || sup || ')' || chr(10)
          || '{{ unique/lbs: ' || fl.u || '/' || fl.n || ',' || chr(10) || '  ' || fl.body || chr(10) || '}}'
        FROM fl JOIN pl ON fl.Package = pl.Package JOIN code ON code.Package = fl.Package AND code.File = fl.File
        UNION ALL SELECT 0, 0, '', '', CASE WHEN count(*) = 0 THEN 'All packages processed successfully'
          ELSE 'Failed packages (no src folder): ' || count(*) END FROM bad
        UNION ALL SELECT 0, 1, Package, '', Package FROM bad
        UNION ALL SELECT 0, 2, '', '', 'Good packages: ' || count(*) FROM c
        UNION ALL SELECT 2, 0, '', '', 'Interesting packages: ' || (SELECT count(*) FROM pl) || chr(10) || 'Lower bounds: '
          || count(*) || chr(10) || 'Unique lower bounds: ' || count(DISTINCT value) FROM lbs
        UNION ALL SELECT 3, CAST(-count(*) AS BIGINT), value, '', (CASE WHEN length(value) >= 8 THEN value ELSE
          rpad(value, 8, ' ') END) || ' => ' || count(*) FROM lbs GROUP BY value""")
    q["a1_multiset_union"] = (
        lambda s, d: lowerbounds.multiset_sum(
            lowerbounds.frequencies(C.read(s, d, "part").select(F.col("p_type").alias("value"))).unionByName(
                lowerbounds.frequencies(C.read(s, d, "orders").select(F.col("o_orderpriority").alias("value")))
            ).unionByName(lowerbounds.frequencies(C.read(s, d, "part").select(F.col("p_type").alias("value")))), []),
        """SELECT value, count(*) AS freq FROM (SELECT p_type AS value FROM part UNION ALL SELECT o_orderpriority FROM orders
        UNION ALL SELECT p_type FROM part) u GROUP BY value""")
    q["a2_a3_totals_and_uniques"] = (
        lambda s, d: lowerbounds.roll_up(lowerbounds.frequencies(
            C.read(s, d, "part").select("p_type", "p_brand", F.col("p_name").alias("value")), ["p_type", "p_brand"]),
            "p_type", "p_brand"),
        """SELECT 'file' AS level, p_type, p_brand, count(*) AS lbs, count(DISTINCT p_name) AS lbsUnique FROM part
        GROUP BY p_type, p_brand UNION ALL SELECT 'package', p_type, NULL, count(*), count(DISTINCT p_name) FROM part
        GROUP BY p_type UNION ALL SELECT 'corpus', NULL, NULL, count(*), count(DISTINCT p_name) FROM part""")

    # --- annotation analysis ---------------------------------------------
    shown = ", ".join(ALL_FLAGS)
    q["p1_p9_predicates"] = (
        lambda s, d: _analyzed(s, d).select("Package", "File", "TypeAnnotation", *_big(*ALL_FLAGS)),
        f"{ann} SELECT Package, File, TypeAnnotation, {shown} FROM ann")
    # without dedupe the work is per row: spread it where the input has few splits
    q["p1_p9_predicates_row_local"] = (
        lambda s, d: analysis.analyze_annotations(
            C.annotations(tune(s), d).repartition(shuffle_width(s), "Package", "File")).groupBy("Package").agg(
            *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ALL_FLAGS]),
        f"{ann} SELECT Package, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ALL_FLAGS)
        + " FROM ann GROUP BY Package")
    wide = [(i, v.split("|")[0], v.split("|")[1], v.split("|")[2], v.split("|")[3], v.split("|")[4], k)
            for i, (_, _, vs) in enumerate(C.SUMMARIES) for k, v in enumerate(vs)]

    def spread_parts(s: SparkSession, d: str) -> DataFrame:
        # one split of the table is more work than one task should have
        return C.summary_annotations(s, d).repartition(shuffle_width(s))

    def variables(s: SparkSession, d: str) -> DataFrame:
        df = typevars.summarize(spread_parts(s, d))
        v = df.select("id", F.posexplode("TypeVarsSummary").alias("ord", "v"))
        return v.select(
            "id", F.col("ord").cast("bigint").alias("ord"), "v.name", "v.lb", "v.ub",
            F.array_join(F.transform("v.occurrs", lambda o: F.array_join(o, ".")), ";").alias("occurrs"),
            F.array_join("v.context", ".").alias("context"))

    q["tv8_tv9_variable_summaries"] = (
        variables,
        f"""SELECT p_partkey AS id, CAST(k AS BIGINT) AS ord, name, replace(lb, '~A', 'N' || p_partkey) AS lb,
        replace(ub, '~A', 'N' || p_partkey) AS ub, occurrs, context FROM part JOIN
        {_values(wide, 't', ['tid', 'name', 'lb', 'ub', 'occurrs', 'context', 'k'])} ON tid = p_partkey % {len(C.SUMMARIES)}""")
    q["tv1_tv2_unrolled_text"] = (
        lambda s, d: typevars.summarize(spread_parts(s, d)).select("id", "UnrolledTypeAnnotation"),
        f"""SELECT p_partkey AS id, replace(txt, '~A', 'N' || p_partkey) AS UnrolledTypeAnnotation FROM part JOIN
        {_values([(i, u) for i, (_, u, _) in enumerate(C.SUMMARIES)], 't', ['tid', 'txt'])}
        ON tid = p_partkey % {len(C.SUMMARIES)}""")
    q["tv12_unreadable_annotations"] = (
        lambda s, d: _analyzed(s, d).filter("Error").select("Package", "File", *_big("Error", "Warning", "VarCnt")),
        f"{ann} SELECT Package, File, Error, Warning, VarCnt FROM ann WHERE Error = 1")
    tables = {
        "f2_interesting": ("interesting", "ImprUseSiteVariance = 0 OR RestrictedScope = 0 OR ClosedLowerBound = 0"
                           " OR ExistInInv = 1 OR TrivConsistBounds = 0"),
        "f3_non_use_site": ("non-use-site", "UseSiteVariance = 0"),
        "f4_non_imp_use_site": ("non-imp-use-site", "ImprUseSiteVariance = 0"),
        "f5_exist_in_inv": ("exist-in-inv", "ExistInInv = 1"),
        "f6_non_triv_consist": ("non-triv-consist-bnds", "TrivConsistBounds = 0"),
    }
    for key, (name, where) in tables.items():
        q[key] = (
            lambda s, d, n=name: summary.annotation_tables(_analyzed(s, d))[f"{n}-type-annotations"].select(
                "Package", "File", "TypeAnnotation"),
            f"{ann} SELECT Package, File, TypeAnnotation FROM ann WHERE {where}")
    q["a6_summary_corpus"] = (
        lambda s, d: _rounded(summary.summarize_columns(_analyzed(s, d), ALL_FLAGS)),
        _summary_sql(ann, "ann", ALL_FLAGS))
    q["a6_summary_per_package"] = (
        lambda s, d: _rounded(summary.summarize_columns(_analyzed(s, d), ALL_FLAGS, ["Package"])),
        _summary_sql(ann, "ann", ALL_FLAGS, "Package"))
    q["a6_summary_filtered"] = (
        lambda s, d: _rounded(summary.summarize_columns(
            summary.annotation_tables(_analyzed(s, d))["non-imp-use-site-type-annotations"], ALL_FLAGS)),
        _summary_sql(f"{ann}, sel AS (SELECT * FROM ann WHERE ImprUseSiteVariance = 0)", "sel", ALL_FLAGS))
    q["a6_summary_labels"] = (
        lambda s, d: _rounded(summary.summarize_columns(C.read(s, d, "labels"), ["quality", "toxic"])),
        _summary_sql("", "labels", ["quality", "toxic"]))
    q["a7_corpus_totals"] = (
        lambda s, d: summary.corpus_totals(_analyzed(s, d), ALL_FLAGS),
        f"{ann} SELECT 'total' AS statistic, count(*) AS total FROM ann" + "".join(
            f" UNION ALL SELECT '{c}', CAST(coalesce(sum({c}), 0) AS BIGINT) FROM ann" for c in ALL_FLAGS))
    flag = lambda cols: " OR ".join(f"coalesce(sum({c}), 0) < count(*)" for c in cols)
    for mode, cols in (("named", ["ImprUseSiteVariance", "RestrictedScope", "ClosedLowerBound"]),
                       ("compat", ["ImprUseSiteVariance", "ExistInInv", "RestrictedScope"])):
        q[f"a9_a11_package_flags_{mode}"] = (
            lambda s, d, m=mode: summary.annotation_package_flags(_analyzed(s, d), m),
            f"""{ann} SELECT Package, count(*) AS total, bool_or(Error = 1 OR Warning = 1) AS pkgwarn,
            {flag(['UseSiteVariance'])} AS pkgusesite, {flag(cols)} AS pkgintr FROM ann GROUP BY Package""")
    q["a12_good_bad_totals"] = (
        lambda s, d: summary.good_and_bad(C.packages(s, d), C.annotations(s, d)),
        """SELECT count(*) FILTER (p IN (SELECT 'Pkg' || (l_partkey % 50) FROM lineitem)) AS goodPkg,
        count(*) FILTER (p NOT IN (SELECT 'Pkg' || (l_partkey % 50) FROM lineitem)) AS badPkg
        FROM (SELECT DISTINCT 'Pkg' || s_suppkey AS p FROM supplier) x""")
    q["src6_bad_packages"] = (
        lambda s, d: readers.bad_packages(C.packages(s, d), C.annotations(s, d)),
        """SELECT 'Pkg' || s_suppkey AS Package FROM supplier
        WHERE 'Pkg' || s_suppkey NOT IN (SELECT 'Pkg' || (l_partkey % 50) FROM lineitem)""")

    def custom(s: SparkSession, d: str) -> DataFrame:
        tune(s)
        registry = PredicateRegistry().register(
            Predicate("OneVariable", lambda tv: F.size(tv) == 1, True, "one-variable"))
        df = analysis.analyze_annotations(C.annotations(s, d), registry, dedupe=True)
        return summary.annotation_tables(df, registry)["one-variable-type-annotations"].groupBy("Package").agg(
            F.count("*").alias("n"))

    q["p12_registered_predicate"] = (
        custom, f"{ann} SELECT Package, count(*) AS n FROM ann WHERE VarCnt = 1 GROUP BY Package")

    # --- declarations ----------------------------------------------------
    rows = [(i, t, sup, td, ts, *(f or (None,) * 6), 0 if f else 1) for i, (t, sup, td, ts, f) in enumerate(C.DECLARATIONS)]
    fill = lambda c, a: f"replace({c}, '~A', 'D' || c_custkey) AS {a}"
    dec = f"""WITH dec AS (SELECT 'Pkg' || ((c_custkey * 7) % 40) AS Package, c_custkey AS id,
      {fill('ptd', 'ProcessedTypeDecl')}, {fill('pts', 'ProcessedSuper')}, CAST(Error AS BIGINT) AS Error,
      CAST(Error AS BIGINT) AS Warning, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in C.DECL_FLAGS)}
      FROM customer JOIN {_values(rows, 't', ['tid', 'txt', 'sup', 'ptd', 'pts', *C.DECL_FLAGS, 'Error'])}
      ON tid = c_custkey % {len(C.DECLARATIONS)})"""
    decl_cols = ["Error", "Warning", *C.DECL_FLAGS]
    q["tv4_tv6_p10_declarations"] = (
        lambda s, d: _decls(s, d).select("Package", "id", "ProcessedTypeDecl", "ProcessedSuper", *_big(*decl_cols)),
        f"{dec} SELECT Package, id, ProcessedTypeDecl, ProcessedSuper, {', '.join(decl_cols)} FROM dec")
    for key, name, where in (
        ("f7_decl_non_use_site", "non-use-site", "TyDeclUseSiteVariance = 0 OR SuperUseSiteVariance = 0 OR TrivConsistBounds = 0"),
        ("f8_decl_non_imp_use_site", "non-imp-use-site", "TyDeclImpUseSiteVariance = 0 OR SuperImpUseSiteVariance = 0"),
        ("f9_decl_non_triv_consist", "non-triv-consist-bnds", "TrivConsistBounds = 0"),
    ):
        q[key] = (
            lambda s, d, n=name: summary.declaration_tables(_decls(s, d))[f"{n}-type-declarations"].select("Package", "id"),
            f"{dec} SELECT Package, id FROM dec WHERE {where}")
    q["a6_summary_declarations"] = (
        lambda s, d: _rounded(summary.summarize_columns(_decls(s, d), summary.DECLARATION_COLUMNS)),
        _summary_sql(dec, "dec", summary.DECLARATION_COLUMNS))
    q["a10_decl_package_flags"] = (
        lambda s, d: summary.declaration_package_flags(_decls(s, d)),
        f"""{dec} SELECT Package, count(*) AS total, bool_or(Error = 1 OR Warning = 1) AS pkgwarn,
        {flag(['TyDeclUseSiteVariance', 'SuperUseSiteVariance'])} AS pkgusesite FROM dec GROUP BY Package""")

    # --- extraction ------------------------------------------------------
    fill = lambda c: f"replace({c}, '~A', 'P' || p_partkey)"
    src = "SELECT 'Pkg' || (p_size % 50) AS Package, 'src/p' || p_partkey || '.jl' AS File"
    on = f"ON tid = p_partkey % {len(C.SOURCES)}"
    anns = [(i, *a) for i, (_, rows_, _) in enumerate(C.SOURCES) for a in rows_]
    decs = [(i, *a) for i, (_, _, rows_) in enumerate(C.SOURCES) for a in rows_]
    q["ex6_ex12_extract_annotations"] = (
        lambda s, d: _sources(s, d).annotations.select("Package", "File", "Function", "Kind", "TypeAnnotation"),
        f"""{src}, f AS "Function", k AS Kind, {fill('t')} AS TypeAnnotation FROM part
        JOIN {_values(anns, 'x', ['tid', 'f', 'k', 't'])} {on}""")
    q["ex13_extract_declarations"] = (
        lambda s, d: _sources(s, d).declarations.select("Package", "File", "Name", "Kind", "TypeDeclaration", "Supertype"),
        f"""{src}, n AS Name, k AS Kind, {fill('t')} AS TypeDeclaration, {fill('u')} AS Supertype FROM part
        JOIN {_values(decs, 'x', ['tid', 'n', 'k', 't', 'u'])} {on}""")
    order = {}
    for i, (_, rows_, _) in enumerate(C.SOURCES):
        order[i] = [(i, k, *r) for k, r in enumerate(rows_, 1)]
    q["ex14_source_order"] = (
        lambda s, d: extract.ranked(_sources(s, d).annotations).select("Package", "File", "rank", "Function", "Kind", "TypeAnnotation"),
        f"""{src}, CAST(r AS BIGINT) AS rank, f AS "Function", k AS Kind, {fill('t')} AS TypeAnnotation FROM part
        JOIN {_values([r for rows_ in order.values() for r in rows_], 'x', ['tid', 'r', 'f', 'k', 't'])} {on}""")
    errors = [(i, *e) for i, (text, _, _) in enumerate(C.SOURCES) for start, es in C.ERRORS.items() if text.startswith(start) for e in es]
    q["ex17_extract_errors"] = (
        lambda s, d: _sources(s, d).errors.select("Package", "File", F.col("Pos").cast("bigint").alias("Pos"), "kind", "snippet"),
        f"""{src}, CAST(pos + fills * length('P' || p_partkey) AS BIGINT) AS Pos, kind, {fill('snippet')} AS snippet FROM part
        JOIN {_values(errors, 'x', ['tid', 'pos', 'fills', 'kind', 'snippet'])} {on}""")
    broken = [i for i, c in enumerate(C.SOURCES) if c[0].startswith("broken")][0]
    q["ex16_file_log"] = (
        lambda s, d: extract.log_by_package(_sources(s, d).file_log),
        f"""SELECT 'Pkg' || (p_size % 50) AS Package, count(*) FILTER (p_partkey % {len(C.SOURCES)} <> {broken}) AS succ,
        count(*) FILTER (p_partkey % {len(C.SOURCES)} = {broken}) AS fail FROM part GROUP BY 1""")

    # --- logs and lists --------------------------------------------------
    body = "'Tuple{C' || (o_custkey % 97) || '} where T'"
    q["src8_marked_lines_prefix"] = (
        lambda s, d: logs.marked(C.log_lines(s, d)).groupBy("value").agg(F.count("*").alias("n")),
        f"""SELECT value, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN {body}
        ELSE 'y JLSUBTYPELOG: ' || {body} END AS value FROM orders WHERE o_orderkey % 4 IN (0, 2)) x GROUP BY value""")
    q["src8_marked_lines_anywhere"] = (
        lambda s, d: logs.marked(C.log_lines(s, d), anywhere=True).groupBy("value").agg(F.count("*").alias("n")),
        f"SELECT {body} AS value, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1")
    q["a13_o5_sorted_distinct_lines"] = (
        lambda s, d: logs.sorted_distinct(logs.marked(C.log_lines(s, d), anywhere=True)),
        f"SELECT DISTINCT {body} AS value FROM orders WHERE o_orderkey % 4 < 3")
    q["a13_distinct_document_sources"] = (
        lambda s, d: logs.sorted_distinct(C.read(s, d, "documents"), "source"),
        "SELECT DISTINCT source FROM documents")

    # tables of the source written as files, and read by the sources
    def listed(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "package_list")
        C.read(s, d, "supplier").orderBy("s_suppkey").select(
            F.concat_ws(",", "s_name", "s_suppkey", F.concat(F.lit("0."), F.col("s_nationkey")))).write.text(path)
        return readers.package_list(s, path, first=10).select(F.col("uuid").cast("bigint").alias("s_suppkey"), F.col("name").alias("s_name"))

    q["o4_first_packages"] = (listed, "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 10")

    def numbered_list(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "package_list")
        rows = C.read(s, d, "part").select(
            F.col("p_brand").alias("B"), "p_partkey", F.concat_ws(",", _key("P", "p_partkey"), "p_brand", "p_size").alias("value"))
        # one list for each brand
        rows.repartition("B").sortWithinPartitions("B", "p_partkey").select("B", "value").write.partitionBy("B").text(path)
        return readers.package_list(s, path).select("name", "uuid", "version", F.col("line").cast("bigint").alias("line"))

    q["src7_package_list"] = (
        numbered_list,
        """SELECT 'P' || p_partkey AS name, p_brand AS uuid, CAST(p_size AS VARCHAR) AS version,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line FROM part""")

    def folder_texts(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "folders")
        rows = C.read(s, d, "customer").select(
            _key("Pkg", "c_nationkey").alias("Package"), F.col("c_mktsegment").alias("Part"), F.concat(F.lit("x"), "c_custkey").alias("value"))
        rows.write.partitionBy("Package", "Part").text(path)
        files = readers.code_files(s, path, suffix=".txt")
        newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        return files.select("Package", F.substring_index("File", "/", 1).alias("Folder"), "ReadStatus", newlines.alias("n")).groupBy(
            "Package", "Folder", "ReadStatus").agg(F.sum("n").cast("bigint").alias("lines"))

    q["src1_src4_folder_texts"] = (
        folder_texts,
        """SELECT 'Package=Pkg' || c_nationkey AS Package, 'Part=' || c_mktsegment AS Folder, 'ok' AS ReadStatus, count(*) AS lines
        FROM customer GROUP BY 1, 2""")

    def package_folders(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "folders")
        rows = C.read(s, d, "supplier").select(_key("Pkg", "s_suppkey").alias("P"), F.when(F.col("s_suppkey") % 3 == 0, "src").otherwise("doc").alias("S"))
        writers.write_folders(rows.withColumn("value", F.lit("x")), path, ["P", "S"])
        found = readers.package_dirs(s, path, src="S=src")
        return found.groupBy("hasSrc").agg(F.count("*").alias("packages"))

    q["src1_package_folders"] = (
        package_folders, "SELECT s_suppkey % 3 = 0 AS hasSrc, count(DISTINCT s_suppkey) AS packages FROM supplier GROUP BY 1")

    def printed_table(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "printed")
        awkward = F.concat(F.lit('Val{"'), F.col("c_custkey").cast("string"), F.lit('"} \\ $x\n\t'), "c_name")
        rows = C.read(s, d, "customer").select(
            _key("Pkg", "c_nationkey").alias("Package"), _key("src/f", "c_custkey").alias("File"), F.col("c_custkey").alias("Pos"),
            F.lit(0).alias("Ord"), F.col("c_mktsegment").alias("Function"), F.lit("mtsig").alias("Kind"), awkward.alias("TypeAnnotation"))
        writers.write_annotations(rows, path)
        return readers.type_annotations(s, path, "*.csv")

    q["snk1_src5_printed_table"] = (
        printed_table,
        """SELECT 'Pkg' || c_nationkey AS Package, 'src/f' || c_custkey AS File, c_mktsegment AS "Function", 'mtsig' AS Kind,
        'Val{"' || c_custkey || '"} ' || chr(92) || ' $x' || chr(10) || chr(9) || c_name AS TypeAnnotation FROM customer""")

    def damaged(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "damaged")
        good = F.concat(F.lit('"src/f'), F.col("o_orderkey").cast("string"), F.lit('.jl","f","mtsig","Tuple{}"'))
        n = F.col("o_orderkey") % 5
        line = (F.when(n == 1, F.concat(good, F.lit(',"more"'))).when(n == 2, F.replace(good, F.lit('"f"'), F.lit("f")))
                .when(n == 3, F.replace(good, F.lit("Tuple{}"), F.lit("Tuple{}\\q"))).when(n == 4, F.replace(good, F.lit("Tuple"), F.lit("Tu\tple"))).otherwise(good))
        C.read(s, d, "orders").select(_key("Pkg", F.col("o_custkey") % 20).alias("Package"), line.alias("value")).write.partitionBy("Package").text(path)
        read = readers.type_annotations(s, path, "*.txt").select("Package", F.lit("ok").alias("kind"))
        errors = readers.stored_errors(s, path, schemas.TYPE_ANNOTATIONS, "*.txt").select("Package", "kind")
        return read.unionByName(errors).groupBy("Package", "kind").agg(F.count("*").alias("n"))

    q["src5_stored_errors"] = (
        damaged,
        """SELECT 'Pkg' || (o_custkey % 20) AS Package, CASE o_orderkey % 5 WHEN 1 THEN 'fields' WHEN 2 THEN 'quotes' WHEN 3 THEN 'escape'
        WHEN 4 THEN 'control' ELSE 'ok' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2""")

    def isolated(s: SparkSession, d: str) -> DataFrame:
        tune(s)
        registry = PredicateRegistry().register(Predicate("SecondOpen", lambda tv: F.element_at(tv, 2)["lb"] == "Union{}"))
        df = analysis.analyze_annotations(C.annotations(s, d), registry, dedupe=True)
        return df.groupBy("Package").agg(F.count("SecondOpen").alias("known"), F.sum(F.col("VarCnt").cast("bigint")).alias("VarCnt"))

    q["p11_failing_predicate"] = (
        isolated, f"{ann} SELECT Package, count(*) FILTER (VarCnt > 1) AS known, CAST(sum(VarCnt) AS BIGINT) AS VarCnt FROM ann GROUP BY Package")
    return q


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalog().items() if sql is not None}
