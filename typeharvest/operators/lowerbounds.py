"""Lower-bound census: text counts, bounds per file, roll-ups and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeharvest.functions import lexical, scanner
from typeharvest.operators import marks as M
from typeharvest.storage import stored

KEY = M.FILE_KEY
LB_WIDTH = 8


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------
def text_counts(files: DataFrame) -> DataFrame:
    """Package, File, sub, sup: raw text counts of ``<:`` and ``>:``."""
    return files.select(*KEY, *lexical.pattern_counts("text"))


def non_vacuous(sub: Column, sup: Column) -> Column:
    return F.coalesce((sub + sup) > 0, F.lit(False))


def has_constraint(text: str = "text") -> Column:
    return non_vacuous(lexical.literal_count(text, "<:"), lexical.literal_count(text, ">:"))


def _gated_bounds(files: DataFrame) -> DataFrame:
    """Package, File, sub, sup, status, value of all files.

    One row per lower bound, and one with a null value for a file without any.
    Files are scanned once; only those with a constraint take their text along,
    for a lower bound needs one. The token windows, the join back to the text
    and the groupings by file reuse the one exchange.
    """
    gate = has_constraint()
    spread = M.distribute(files.select(
        *KEY, *lexical.pattern_counts("text"), F.col("text").isNull().alias("missing"), F.when(gate, F.col("text")).alias("text")))
    found = M.marks(spread.select(*KEY, "text").filter("text is not null"), ("lb",)).groupBy(*KEY).agg(
        F.bool_or("broken").alias("broken"),
        F.collect_list(F.when(F.col("kind") == "lb", F.struct("pos", "kind", "start", "stop"))).alias("spans"))
    rows = spread.join(found, KEY, "left")
    status = (F.when(F.col("missing"), "error").when(F.col("text").isNull(), "vacuous")
              .when(F.col("broken"), "error").otherwise("ok"))
    rows = scanner.cut(rows.select(*KEY, "sub", "sup", status.alias("status"), "text", "spans"))
    rows = rows.withColumn("_tok", lexical.snippet_tokens(F.col("snippet")))
    # most bounds are one token, which is printed as it is
    alone = F.size("_tok") == 1
    rows = rows.withColumn("_b", F.when(~alone, F.expr(lexical.bracketed("_tok"))))
    return rows.select(*KEY, "sub", "sup", "status", "pos", F.when(alone, F.trim(F.get("_tok", F.lit(0)))).otherwise(
        F.expr(lexical.spaced("_b.out", "0", "size(_b.out)"))).alias("value"))


def lower_bounds(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, broken): each lower bound as (Package, File, pos, value), and the
    files that cannot be read."""
    rows = _gated_bounds(files)
    return (rows.filter("value is not null and status = 'ok'").select(*KEY, "pos", "value"),
            rows.filter("status = 'error'").select(*KEY).distinct())


def file_census(files: DataFrame) -> DataFrame:
    """One row per file: counts, status, and the bounds as (value, freq) entries.

    status is ok, vacuous (no constraint in the text) or error (cannot be read;
    a null text is an unreadable file).
    """
    per_value = _gated_bounds(files).groupBy(*KEY, "value").agg(
        F.count("*").alias("freq"), F.first("sub").alias("sub"), F.first("sup").alias("sup"), F.first("status").alias("status"))
    counted = F.when(F.col("value").isNotNull(), F.col("freq"))
    gated = per_value.groupBy(*KEY).agg(
        F.first("sub").alias("sub"), F.first("sup").alias("sup"), F.first("status").alias("status"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("lbs"), F.count("value").alias("lbsUnique"),
        F.sort_array(F.collect_list(F.when(counted.isNotNull(), F.struct("value", "freq")))).alias("lbsFreq"))
    return gated.select(
        *KEY, "sub", "sup", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("lbs", "lbsUnique", "lbsFreq")])


# ---------------------------------------------------------------------------
# Multisets as (value, freq) rows
# ---------------------------------------------------------------------------
def multiset_sum(rows: DataFrame, keys: list[str], value: str = "value", freq: str = "freq") -> DataFrame:
    """Union of multisets, adding frequencies; partial sums are taken map-side."""
    return rows.groupBy(*keys, value).agg(F.sum(freq).cast("bigint").alias(freq))


def frequencies(bounds: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Occurrence rows to a multiset per key."""
    return bounds.groupBy(*(keys or []), value).agg(F.count("*").alias("freq"))


def roll_up(freqs: DataFrame, package: str = "Package", file: str = "File", value: str = "value") -> DataFrame:
    """lbs and lbsUnique for every file, package and the corpus.

    Uniques are recounted per level. Each (value, freq) counts in its three
    levels at once, so ``freqs`` is computed once; values are summed before the
    levels are counted, and partial sums are taken map-side.
    """
    none = F.lit(None).cast("string")
    at = F.array(*[F.struct(F.lit(level).alias("level"), p.alias(package), f.alias(file)) for level, p, f in (
        ("file", F.col(package), F.col(file)), ("package", F.col(package), none), ("corpus", none, none))])
    rows = freqs.select(F.explode(at).alias("at"), F.col(value).alias("value"), F.col("freq").cast("bigint").alias("freq"))
    # the corpus has a row even without a bound
    empty = freqs.sparkSession.sql(
        f"SELECT named_struct('level', 'corpus', '{package}', string(null), '{file}', string(null)) AS at, string(null) AS value, 0L AS freq")
    sums = rows.unionByName(empty).groupBy("at", "value").agg(F.sum("freq").alias("freq"), F.max(F.col("freq") > 0).alias("real"))
    stats = sums.groupBy("at").agg(F.sum("freq").cast("bigint").alias("lbs"), F.count_if("real").alias("lbsUnique"))
    return stats.select("at.*", "lbs", "lbsUnique")


def rollup_counters(files: DataFrame, counters: dict[str, Column], package: str = "Package",
                    file: str = "File") -> DataFrame:
    """Additive counters per file, package and corpus in one ROLLUP."""
    rolled = files.rollup(package, file).agg(
        *[F.sum(c).cast("bigint").alias(name) for name, c in counters.items()],
        F.grouping_id().alias("_gid"))
    level = F.when(F.col("_gid") == 0, "file").when(F.col("_gid") == 1, "package").otherwise("corpus")
    return rolled.select(level.alias("level"), package, file, *counters)


# ---------------------------------------------------------------------------
# Packages and corpus
# ---------------------------------------------------------------------------
def package_counters(census: DataFrame) -> DataFrame:
    """Files per package: total, failed, non-vacuous (with at least one bound)."""
    return census.groupBy("Package").agg(
        F.count("*").alias("totalFilesNum"),
        F.count_if(F.col("status") == "error").alias("failedFilesNum"),
        F.count_if(F.coalesce(F.col("lbs") > 0, F.lit(False))).alias("nonVacFilesNum"),
    )


def exploded(census: DataFrame) -> DataFrame:
    """The bounds of a census as (Package, File, value, freq) rows."""
    return census.select(*KEY, F.explode("lbsFreq").alias("e")).select(
        *KEY, F.col("e.value").alias("value"), F.col("e.freq").alias("freq"))


#: what a row of ``_leveled`` adds up
_SUMS = ("freq", "totalFilesNum", "failedFilesNum", "nonVacFilesNum")


def _leveled(census: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The census by level, grouped in one pass: (level, Package, File, value) with sums.

    ``package``: the counters of each package under a null value, and its
    values; ``corpus``: the values of all; ``file``: each file with bounds,
    with its counts and entries. Tasks add up before the shuffle.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    no_entries = F.lit(None).cast(census.schema["lbsFreq"].dataType)

    def row(level: str, package: Column, file: Column, value: Column, sums: list[Column], counts: list[Column], entries: Column) -> Column:
        named = [c.cast("bigint").alias(n) for n, c in zip((*_SUMS, "sub", "sup"), (*sums, *counts))]
        return F.struct(F.lit(level).alias("level"), package.alias("Package"), file.alias("File"), value.alias("value"), *named, entries.alias("entries"))

    package, has_bounds = F.col("Package"), F.coalesce(F.col("lbs") > 0, F.lit(False))
    no_counts = [F.lit(None), F.lit(None)]
    counters = [zero, F.lit(1), (F.col("status") == "error").cast("int"), has_bounds.cast("int")]
    entries = F.coalesce("lbsFreq", F.array().cast(census.schema["lbsFreq"].dataType))

    def values(level: str, package: Column) -> Column:
        return F.transform(entries, lambda e: row(level, package, none, e["value"], [e["freq"], zero, zero, zero], no_counts, no_entries))

    parts = {
        "package": [F.array(row("package", package, none, none, counters, no_counts, no_entries)), values("package", package)],
        "corpus": [values("corpus", none)],
        "file": [F.when(has_bounds, F.array(row("file", package, F.col("File"), none, [F.col("lbs"), zero, zero, zero], [F.col("sub"), F.col("sup")], F.col("lbsFreq")))).otherwise(F.array())],
    }
    rows = census.select(F.explode(F.concat(*[c for level in levels for c in parts[level]])).alias("r")).select("r.*")
    return rows.groupBy("level", "Package", "File", "value").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.first("sub").alias("sub"), F.first("sup").alias("sup"), F.first("entries").alias("entries"))


def _census_of(packages: DataFrame, grouped: DataFrame, *more: Column) -> DataFrame:
    """Packages, listed or with files, from the rows of level ``package``."""
    stats = grouped.filter("level = 'package'").groupBy("Package").agg(
        *[F.sum(c).alias(c) for c in _SUMS[1:]], F.sum("freq").alias("lbs"), F.count("value").alias("lbsUnique"), *more)
    joined = packages.join(stats, "Package", "full")
    with_files = F.col("totalFilesNum").isNotNull()
    has_src = F.coalesce("hasSrc", with_files) if "hasSrc" in packages.columns else with_files
    kept = set(joined.columns) - {*packages.columns, *_SUMS, "lbs", "lbsUnique"}
    return joined.select(
        "Package", has_src.alias("hasSrc"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*_SUMS[1:], "lbs", "lbsUnique")], *sorted(kept))


def package_census(packages: DataFrame, census: DataFrame) -> DataFrame:
    """Every package that is listed or has files: whether it has sources, its
    counters and bounds.

    A package without source files is *bad* and contributes zeros. The census
    is read once.
    """
    return _census_of(packages, _leveled(census, ("package",)))


def split_good_bad(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return packages.filter("hasSrc"), packages.filter("not hasSrc")


def interest(lbs: Column, unique: Column) -> Column:
    return unique * 100 + lbs


def rank_packages(package_stats: DataFrame) -> DataFrame:
    """Packages with bounds, the most interesting first."""
    return (
        package_stats.filter("lbs > 0")
        .withColumn("interest", interest(F.col("lbs"), F.col("lbsUnique")))
        .orderBy(F.desc("interest"), "Package")
    )


def rank_values(freqs: DataFrame, value: str = "value") -> DataFrame:
    """Most frequent first; ties by value so the order is fixed."""
    return freqs.orderBy(F.desc("freq"), value)


def freq_line(value: Column, freq: Column) -> Column:
    """``v => n`` with the value padded to eight; longer values stay whole."""
    padded = F.when(F.length(value) >= LB_WIDTH, value).otherwise(F.rpad(value, LB_WIDTH, " "))
    return F.concat(padded, F.lit(" => "), freq.cast("string"))


def text_stat(sub: Column, sup: Column) -> Column:
    return F.concat(F.lit("(<: "), sub.cast("string"), F.lit(", >: "), sup.cast("string"), F.lit(")"))


def stat_block(unique: Column, lbs: Column, entries: Column) -> Column:
    """``{ unique/lbs: u/n, ... }`` of an array of (freq desc, value) entries."""
    ordered = F.sort_array(F.transform(entries, lambda e: F.struct((-e["freq"]).alias("order"), e["value"].alias("value"), e["freq"].alias("freq"))))
    return F.concat(
        F.lit("{ unique/lbs: "), unique.cast("string"), F.lit("/"), lbs.cast("string"), F.lit(",\n  "),
        F.array_join(F.transform(ordered, lambda e: freq_line(e["value"], e["freq"])), ", "), F.lit("\n}"))


def report_rows(packages: DataFrame, census: DataFrame) -> DataFrame:
    """The report as rows (section, rank, Package, File, line): packages without
    sources, the ranked good ones with their files, totals, corpus values.

    The census is read once and grouped into a table of its levels, from which
    the sections come. One row per package header, file block or corpus value:
    no block is ever built for a whole corpus, and a package's values are rows
    of their own file.
    """
    grouped = stored(_leveled(census, ("package", "corpus", "file")), "levels")
    pair = F.when(F.col("value").isNotNull(), F.struct("value", "freq"))
    counted = stored(_census_of(packages, grouped, F.collect_list(pair).alias("entries")), "packages")
    good = counted.filter("hasSrc and lbs > 0").withColumn("rank", -interest(F.col("lbs"), F.col("lbsUnique")))
    line = lambda rank, text: F.struct(F.lit(rank).cast("bigint").alias("rank"), F.lit("").alias("Package"), text.alias("line"))
    # The report's wording
    failed = F.when(F.col("bad") == 0, "All packages processed successfully").otherwise(
        F.concat(F.lit("Failed packages (no src folder): "), F.col("bad").cast("string")))
    outcome = counted.agg(F.count_if(~F.col("hasSrc")).alias("bad"), F.count_if("hasSrc").alias("good")).select(F.explode(F.array(
        line(0, failed), line(2, F.concat(F.lit("Good packages: "), F.col("good").cast("string"))))).alias("l")).select("l.*")
    outcome = outcome.unionByName(counted.filter("not hasSrc").select(
        F.lit(1).cast("bigint").alias("rank"), "Package", F.col("Package").alias("line"))).select(
        F.lit(0).alias("section"), "rank", "Package", F.lit("").alias("File"), "line")
    headers = good.select(
        F.lit(1).alias("section"), "rank", "Package", F.lit("").alias("File"),
        F.concat(F.col("Package"), F.lit(": "), stat_block(F.col("lbsUnique"), F.col("lbs"), F.col("entries")),
                 F.lit("\nNon vacuous files: "), F.col("nonVacFilesNum").cast("string"), F.lit("/"),
                 F.col("totalFilesNum").cast("string")).alias("line"))
    file_rows = grouped.filter("level = 'file'").join(good.select("Package", "rank"), "Package").select(
        F.lit(1).alias("section"), "rank", "Package", "File",
        F.concat(F.lit("* "), F.when(F.length("File") >= LB_WIDTH, F.col("File")).otherwise(F.rpad("File", LB_WIDTH, " ")),
                 F.lit(" => "), text_stat(F.col("sub"), F.col("sup")), F.lit("\n"),
                 stat_block(F.size("entries"), F.col("freq"), F.col("entries"))).alias("line"))
    corpus = grouped.filter("level = 'corpus'")
    values = corpus.select(
        F.lit(3).alias("section"), (-F.col("freq")).alias("rank"), F.col("value").alias("Package"),
        F.lit("").alias("File"), freq_line(F.col("value"), F.col("freq")).alias("line"))
    # packages with bounds, and the bounds of all, in one sum
    counts = good.select(F.lit(1).alias("n"), F.lit(0).alias("u"), F.lit(0).cast("bigint").alias("lbs")).unionByName(
        corpus.select(F.lit(0).alias("n"), F.lit(1).alias("u"), F.col("freq").alias("lbs")))
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in ("n", "u", "lbs")]).select(
        F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("Package"), F.lit("").alias("File"),
        F.concat(F.lit("Interesting packages: "), "n", F.lit("\nLower bounds: "), "lbs", F.lit("\nUnique lower bounds: "), "u").alias("line"))
    return (
        outcome.unionByName(headers).unionByName(file_rows).unionByName(totals).unionByName(values)
        .orderBy("section", "rank", "Package", "File")
    )
