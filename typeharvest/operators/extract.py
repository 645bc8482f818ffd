"""Extraction of type annotations and type declarations from source files.

``marks`` finds the heads and ``::`` positions of a file; here each head's own
text is shaped into rows with array functions. What cannot be shaped becomes a
row of ``extract_errors`` and hides nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeharvest.functions import lexical, scanner
from typeharvest.operators import declarations as D
from typeharvest.operators import marks as M

# Names and stand-ins of the annotation table
NOT_A_SIGNATURE = "<NOT A FUNSIG>"
NO_NAME = "<NA-name>"
KEY = M.FILE_KEY
HEADS = ("fn", "short", "arrow", "do")


@dataclass(frozen=True)
class Extracted:
    annotations: DataFrame
    declarations: DataFrame
    errors: DataFrame
    file_log: DataFrame


def _shape_heads(heads: DataFrame) -> DataFrame:
    """Name, signature and return type of heads; the printed type of ``e :: T``.

    ``ok`` marks readable heads; ``printed`` is null for unreadable types.
    """
    sp = lexical.spaced
    df = heads.withColumn("_tok", lexical.snippet_tokens(F.col("snippet")))
    df = df.withColumn("_a", F.expr(lexical.bracketed("_tok")))
    df = df.withColumn("_t", F.col("_a.out"))
    # close[i]: the closer of an opener
    close = lambda o: f"get(transform(filter(_t, c -> c.mate = {o}), c -> c.i), 0)"
    df = df.withColumn("_c0", F.expr(f"if(get(_t, 0).t = '(', {close('0')}, -1)"))
    # a parenthesised head, (f(x) :: R) where T: its content is a call
    df = df.withColumn("_wrapped", F.expr("""
        kind in ('fn', 'short') and _c0 > 2 and coalesce(get(_t, _c0 + 1).t <> '(', true)
        and get(_t, 1).k in ('n', 'q') and get(_t, 2).t in ('(', '{')
        and not exists(_t, y -> y.par = 0 and y.t = ',')
        and exists(_t, y -> y.t = ')' and y.par = 0 and coalesce(get(_t, y.i + 1).t = '::' or y.i + 1 = _c0, false))"""))
    df = df.withColumn("_pb", F.expr("if(_wrapped, 0, -1)"))
    df = df.withColumn("_hs", F.expr("if(_wrapped, 1, 0)"))
    df = df.withColumn("_bare", F.expr("""
        kind in ('arrow', 'do') or (kind = 'fn' and _c0 >= 0 and not _wrapped and coalesce(get(_t, _c0 + 1).t <> '(', true))"""))
    df = df.withColumn("_ao", F.expr("""
        case when kind in ('arrow', 'fn') and _bare and _c0 >= 0 then 0
             when _bare then -1
             else get(transform(filter(_t, y -> y.t = '(' and y.par = _pb and y.i > _hs
                    and (y.i = _hs + 1 or get(_t, y.i - 1).k in ('n', 'q') or get(_t, y.i - 1).t in (')', '}'))),
                    y -> y.i), 0) end"""))
    df = df.withColumn("_ac", F.expr(f"case when _ao >= 0 then {close('_ao')} when _bare then size(_t) end"))
    df = df.withColumn("_w", F.expr("transform(filter(_t, y -> y.k = 'w' and y.i > _ac and y.par = -1), y -> y.i)"))
    # one segment per argument, positional first as written
    df = df.withColumn("_cuts", F.expr("""
        concat(array(_ao), transform(filter(_t, y -> y.t in (',', ';') and y.par = _ao), y -> y.i), array(_ac))"""))
    df = df.withColumn("_seg", F.expr("""
        case when _bare and _ao < 0 and size(_t) = 0 then cast(array() as array<struct<s:int,e:int>>)
             else filter(transform(sequence(1, size(_cuts) - 1), j -> struct(
                get(_cuts, j - 1) + 1 as s, get(_cuts, j) - 1 as e)), a -> a.s <= a.e) end"""))
    df = df.withColumn("_seg2", F.expr("""
        transform(_seg, a -> struct(a.s as s, coalesce(get(transform(filter(_t,
            y -> y.t = '=' and y.par = _ao and y.i between a.s and a.e), y -> y.i), 0) - 1, a.e) as e))"""))
    df = df.withColumn("_seg3", F.expr("""
        transform(_seg2, a -> struct(a.s as s, if(get(_t, a.e).t = '...', a.e - 1, a.e) as e,
                                     get(_t, a.e).t = '...' as va))"""))
    df = df.withColumn("_seg4", F.expr("""
        transform(_seg3, a -> struct(a.s as s, a.e as e, a.va as va, get(transform(filter(_t,
            y -> y.t = '::' and y.par = _ao and y.i between a.s and a.e), y -> y.i), 0) as cc))"""))
    kind_of = f"""
        case when get(_t, a.s).t = '@nospecialize' then 'NOSPECIALIZE'
             when get(_t, a.s).k = 'm' then 'MACROCALL'
             when a.cc is not null and a.cc < a.e then {sp('_t', 'a.cc + 1', 'a.e')}
             when get(_t, a.s).t = '(' and get(_t, a.e).mate = a.s then 'TUPLE_ARG'
             when a.s = a.e and get(_t, a.s).k = 'n' then 'Any'
             when a.s < a.e and get(_t, a.s).k in ('n', 'q') and get(_t, a.s + 1).t = '(' and get(_t, a.e).mate = a.s + 1
               then 'CALL' end"""
    df = df.withColumn("_types", F.expr(
        f"transform(_seg4, a -> if(a.va, concat('Vararg{{', {kind_of}, '}}'), {kind_of}))"))
    df = df.withColumn("_where_end", F.expr("if(_wrapped, _c0 - 1, size(_t) - 1)"))
    df = df.withColumn("_rs", F.expr("if(get(_t, _ac + 1).t = '::', _ac + 2, null)"))
    # a short definition's return type takes the where clauses along
    df = df.withColumn("_re", F.expr("""
        case when _rs is null then null
             when kind = 'fn' and not _wrapped then coalesce(array_min(_w) - 1, size(_t) - 1)
             else _where_end end"""))
    df = df.withColumn("_wl", F.expr("""
        if(_rs is not null and not _wrapped and kind <> 'fn', cast(array() as array<int>), _w)"""))
    # the outermost clause first; inside braces the first variable first
    df = df.withColumn("_vars", F.expr(f"""
        flatten(reverse(transform(_wl, w ->
          case when get(_t, w + 1).t = '{{' then
            filter(transform(
              sequence(1, 1 + size(filter(_t, y -> y.t = ',' and y.par = w + 1))),
              j -> {sp('_t',
                       "coalesce(get(transform(filter(_t, y -> y.t = ',' and y.par = w + 1), y -> y.i), j - 2), w + 1) + 1",
                       "coalesce(get(transform(filter(_t, y -> y.t = ',' and y.par = w + 1), y -> y.i), j - 1), get(transform(filter(_t, y -> y.mate = w + 1), y -> y.i), 0)) - 1")}),
              v -> v <> '')
          else array({sp('_t', 'w + 1', 'coalesce(array_min(filter(_wl, q -> q > w)) - 1, size(_t) - 1)')}) end)))"""))
    # the name without parameters or the parentheses of a callable object
    df = df.withColumn("_name", F.expr(f"""
        case when _bare then '{NO_NAME}'
             when get(_t, _ao - 1).t = ')' then {sp('_t', '_hs + 1', '_ao - 2')}
             when get(_t, _ao - 1).t = '}}' then {sp('_t', '_hs', 'get(_t, _ao - 1).mate - 1')}
             else {sp('_t', '_hs', '_ao - 1')} end"""))
    ok = F.expr("""
        not _a.bad and _ac is not null and (size(_t) > 0 or kind = 'do')
        and not exists(_types, y -> y is null)
        and (get(_t, _ac + 1) is null or get(_t, _ac + 1).t in ('::', 'where') or (_wrapped and _ac + 1 = _c0))
        and coalesce(_name <> '', false)""")
    df = df.withColumn("ok", F.coalesce(ok, F.lit(False)) & (F.col("kind") != "ann"))
    body = F.concat(F.lit("Tuple{"), F.array_join("_types", ", "), F.lit("}"))
    return lexical.sealed(df, [*KEY, "pos", "kind", "start", "stop", "snippet"], {
        "ok": F.col("ok"),
        # a name without an argument list, such as function f end, is no head
        "is_head": F.col("ok") | ~((F.col("kind") == "fn") & F.col("_ac").isNull()),
        "Function": F.when(F.col("ok"), F.col("_name")),
        "sig": F.when(F.col("ok"), D.wrap_in_where(body, F.col("_vars"))),
        "rtype": F.when(F.col("ok"), F.expr(f"if(_rs is null, null, {sp('_t', '_rs', '_re')})")),
        "printed": F.expr(f"if(kind = 'ann' and not _a.bad and size(_t) > 0, {sp('_t', '0', 'size(_t)')}, null)"),
    })


def _shape_declarations(decls: DataFrame) -> DataFrame:
    sp = lexical.spaced
    df = decls.withColumn("_tok", lexical.snippet_tokens(F.col("snippet")))
    df = df.withColumn("_a", F.expr(lexical.bracketed("_tok")))
    df = df.withColumn("_t", F.col("_a.out"))
    df = df.withColumn("_sub", F.expr(
        "get(transform(filter(_t, y -> y.t = '<:' and y.par = -1), y -> y.i), 0)"))
    df = df.withColumn("_last", F.expr("coalesce(_sub, size(_t)) - 1"))
    df = df.withColumn("_brace", F.expr("if(get(_t, _last).t = '}', get(_t, _last).mate, null)"))
    ok = F.expr("not _a.bad and size(_t) > 0 and _last >= 0 and (_sub is null or _sub < size(_t) - 1)")
    kind = F.create_map(*[F.lit(x) for x in (
        "abstract", "tdabst", "primitive", "tdprim", "struct", "tdstrc", "mutable", "tdmtbl")])
    return lexical.sealed(df, [*KEY, "pos", "start", "snippet"], {
        "ok": F.coalesce(ok, F.lit(False)),
        "Kind": kind[F.col("kind")],
        "Name": F.expr(f"""case when _brace is not null then {sp('_t', '0', '_brace - 1')}
                        when _last = 0 and get(_t, 0).k = 'n' then get(_t, 0).t
                        else '<NA-typename>' end"""),
        "TypeDeclaration": F.expr(sp("_t", "0", "_last")),
        "Supertype": F.expr(f"if(_sub is null, 'Any', {sp('_t', '_sub + 1', 'size(_t) - 1')})"),
    })


def marked(files: DataFrame) -> DataFrame:
    """All heads, types and declarations of files (Package, File, text), each
    with its text; a file without any has one row without a kind.

    The files are tokenised here and nowhere else: a job writes these rows and
    derives its tables from them.
    """
    spread = M.distribute(files.select(*KEY, "text"))
    found = M.marks(spread, (*M.ANNOTATION_KINDS, *M.DECLARATION_KINDS)).groupBy(*KEY).agg(
        F.bool_or("broken").alias("broken"),
        F.collect_list(F.when(~F.col("broken") & (F.col("kind") != "file"), F.struct("pos", "kind", "start", "stop"))).alias("spans"))
    failed = F.col("text").isNull() | F.coalesce("broken", F.lit(False))
    return scanner.cut(spread.join(found, KEY, "left").select(*KEY, failed.alias("failed"), "text", "spans"))


def extract(files: DataFrame) -> Extracted:
    """Files (Package, File, text) to annotations, declarations and logs."""
    return tables(marked(files))


def tables(found: DataFrame) -> Extracted:
    """The tables of ``marked`` rows.

    Rows carry Pos, the character offset of their head, so that writers can
    keep source order. A file that cannot be read gives no rows.
    """
    texts = found.filter("kind is not null")
    shaped_heads = _shape_heads(texts.filter(F.col("kind").isin(*HEADS, "ann")))

    # a :: inside the head of a method belongs to its signature
    behind = Window.partitionBy(*KEY).orderBy("start", F.desc("ok")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("ok"), F.col("stop"))).over(behind)
    rows = shaped_heads.withColumn("own", ~F.coalesce(reach > F.col("start"), F.lit(False)))
    asserted = (F.col("kind") == "ann") & F.col("own")

    def row(ord_: int, name: Column, kind: str, text: str) -> Column:
        return F.struct(F.lit(ord_).alias("Ord"), name.alias("Function"), F.lit(kind).alias("Kind"),
                        F.col(text).alias("TypeAnnotation"))

    annotations = rows.select(
        *KEY, F.col("start").alias("Pos"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("ok"), row(0, F.col("Function"), "mtsig", "sig")),
            F.when(F.col("ok") & F.col("rtype").isNotNull(), row(1, F.col("Function"), "retty", "rtype")),
            F.when(asserted & F.col("printed").isNotNull(),
                   row(0, F.lit(NOT_A_SIGNATURE), "tyassorann", "printed"))))).alias("r"),
    ).select(*KEY, "Pos", "r.Ord", "r.Function", "r.Kind", "r.TypeAnnotation")
    shaped = _shape_declarations(texts.filter(F.col("kind").isin(*M.DECLARATION_KINDS)))

    failed = rows.filter(
        (F.col("kind").isin("fn", "arrow", "do") & ~F.col("ok") & F.col("is_head"))
        | (asserted & F.col("printed").isNull()))
    error = [*KEY, F.col("start").alias("Pos")]
    errors = failed.select(*error, "kind", "snippet").unionByName(
        shaped.filter("not ok").select(*error, F.lit("decl").alias("kind"), "snippet"))
    return Extracted(
        annotations=annotations,
        declarations=shaped.filter("ok").select(*KEY, F.col("start").alias("Pos"), "Name", "Kind",
                                                "TypeDeclaration", "Supertype"),
        errors=errors,
        file_log=file_log(found),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Annotations or declarations with ``rank``, their place in their file from 1."""
    place = [c for c in ("Pos", "Ord") if c in rows.columns]
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(*place))
    return rows.withColumn("rank", rank.cast("bigint"))


def file_log(found: DataFrame) -> DataFrame:
    """(Package, File, status): succ or fail; a file without tokens succeeds."""
    return found.groupBy(*KEY).agg(F.when(F.bool_or("failed"), "fail").otherwise("succ").alias("status"))


def log_by_package(log: DataFrame) -> DataFrame:
    """Counts per package and status; the file lists stay rows of the log."""
    return log.groupBy("Package").agg(
        F.count_if(F.col("status") == "succ").alias("succ"), F.count_if(F.col("status") == "fail").alias("fail"))
