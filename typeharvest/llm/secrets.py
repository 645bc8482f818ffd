"""Multipart credential linking, in DataFrame functions only.

Strong finds (assignments of long secrets, access identifiers, long hex runs) stand alone. Weak candidates (short secrets,
login names, endpoints) are reported only where a complementary part starts within the same scope, SCOPE code points
either way. The interval join meets weak candidates with the first and last start of each part in their own and the
neighbouring buckets of SCOPE code points, which decides exactly whether any start lies in reach; no pair is made.

Null text: empty. Null ids are ids of their own; rows that repeat id and text get the same result each. An empty table: no
rows. Other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import unused, whole_text

SCOPE = 300
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
LOGIN = r"""(?<![A-Za-z])(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?"""
#: kind, prefix, value, least length of the value, role; in the order of kinds. The first three are the base.
KINDS = (
    ("assign", ASSIGN, VALUE, 12, "secret"),
    ("access", "", "AKIA[A-Z0-9]+", 18, "id"),
    ("hex", "", "[0-9a-f]{16,}", 16, "secret"),
    ("short", ASSIGN, VALUE, 6, "secret"),
    ("login", LOGIN, "[A-Za-z0-9._@-]{3,}", 3, "id"),
    ("endpoint", r"(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://", "[^\\x20\\x09-\\x0D\"'<>]+", 4, "endpoint"),
)
BASE = ("assign", "access", "hex")
#: Which parts complete a weak candidate.
COMPLEMENTS = {"short": ("id", "endpoint"), "login": ("secret",), "endpoint": ("secret", "id")}


def _found(text: Column, kind: str, prefix: str, value: str) -> Column:
    """All matches of a kind, leftmost first: what lies before each, and its lengths."""
    # \G: each match begins where the last one ended, so text after the last one is read once
    pattern = F.lit(rf"\G(?s)(.*?)({prefix}({value}))")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, pattern, F.lit(g)).alias(n) for g, n in ((1, "gap"), (2, "whole"), (3, "value"))))
    return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("len"), p["value"].alias("value")))


def credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, value) of each reported span."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    any_part = "|".join(f"{prefix}{value}" for kind, prefix, value, _, _ in KINDS if kind != "short")
    texts = rows.where(text.rlike(any_part)).distinct()
    scans = [k for k in KINDS if k[0] != "short"]  # short secrets are what the long ones' pattern leaves
    found = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.flatten(F.array(*(_found(text, k, p, v) for k, p, v, _, _ in scans)))).alias("m")).select("doc_id", "text_hash", "m.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("doc_id", "text_hash", "kind").orderBy("n"))
    size = F.length("value")
    least = {k: n for k, _, _, n, _ in KINDS}
    kind = F.when((F.col("kind") == "assign") & (size < least["assign"]), "short").otherwise(F.col("kind"))
    marks = found.select("doc_id", "text_hash", kind.alias("kind"), (upto - F.col("len")).alias("start"), upto.alias("end"), "value", size.alias("size"))
    enough = F.lit(False)
    role = F.lit(None).cast("string")
    for k, _, _, n, r in KINDS:
        enough = enough | ((F.col("kind") == k) & (F.col("size") >= n))
        role = F.when(F.col("kind") == k, r).otherwise(role)
    marks = marks.where(enough).drop("size").withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / scope))
    strong = marks.where(F.col("kind").isin(*BASE))
    weak = marks.where(~F.col("kind").isin(*BASE))
    # each bucket's parts, seen from the three buckets that they can reach
    ends = marks.groupBy("doc_id", "text_hash", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    reach = ends.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), F.col("role").alias("p_role"), "first", "last", F.col("bucket").alias("p_bucket"), F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("at"))
    near = F.when(F.col("p_bucket") == F.col("bucket"), True).when(F.col("p_bucket") < F.col("bucket"), F.col("last") >= F.col("start") - scope).otherwise(F.col("first") <= F.col("start") + scope)
    completes = F.lit(False)
    for k, roles in COMPLEMENTS.items():
        completes = completes | ((F.col("kind") == k) & F.col("p_role").isin(*roles))
    linked = weak.join(reach, weak.doc_id.eqNullSafe(reach.p_id) & (weak.text_hash == reach.p_hash) & (weak.bucket == reach["at"]) & near & completes, "left_semi")
    out = ["doc_id", "text_hash", "kind", "start", "end", "value"]
    return strong.select(*out).unionByName(linked.select(*out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_weak, base, spans) of each row; base, spans: arrays of kind:start:end by start, then kind as listed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"))
    order = F.lit(None).cast("int")
    for i, k in enumerate(KINDS):
        order = F.when(F.col("kind") == k[0], i).otherwise(order)
    spans = credentials(docs, id_col, text_col, scope).select("doc_id", "text_hash", F.struct("start", order.alias("i"), "kind", "end").alias("s"))
    named = lambda a: F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    per_doc = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("s")).alias("all"))
    per_doc = per_doc.select(
        F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"),
        *(F.size(F.expr(f"filter(all, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE),
        F.size(F.filter("all", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_weak"),
        named(F.filter("all", lambda s: s["kind"].isin(*BASE))).alias("base"), named(F.col("all")).alias("spans"))
    none = F.array().cast("array<string>")
    return rows.join(per_doc, rows.doc_id.eqNullSafe(per_doc.f_id) & (rows.text_hash == per_doc.f_hash), "left").select(
        "doc_id", *(F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in (*BASE, "weak")), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "<secret>") -> DataFrame:
    """The rows of docs, with each reported secret and identifier replaced in the text (and n_chars counted anew there); endpoints stay."""
    value = F.struct((F.col("end") - F.length("value")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    own, found, values, hash_ = (unused(docs, c) for c in ("_id", "_found", "_values", "_hash"))
    per_doc = credentials(docs, scope=scope).where("kind <> 'endpoint'").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(value)).alias(values))
    per_doc = per_doc.select(F.col("doc_id").alias(own), F.col("text_hash").alias(found), values)
    keyed = docs.withColumn(hash_, F.xxhash64(whole_text()))
    joined = keyed.join(per_doc, keyed.doc_id.eqNullSafe(F.col(own)) & (F.col(hash_) == F.col(found)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(keyed.text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
    cut = F.aggregate(values, start, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), piece(a, s).alias("out")), lambda a: F.concat(a["out"], F.substring(keyed.text, a["at"] + 1, F.length(keyed.text))))
    clean = F.when(F.col(values).isNull(), keyed.text).otherwise(cut)
    changed = {"text": clean, "n_chars": F.when(F.col(values).isNull(), keyed["n_chars"]).otherwise(F.length(clean)).cast("long")} if "n_chars" in docs.columns else {"text": clean}
    return joined.select(*(changed.get(c, keyed[c]).alias(c) for c in docs.columns))
