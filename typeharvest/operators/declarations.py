"""Type declarations: split into name, parameters and bare names; full types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeharvest.functions import lexical



def split_declaration(decls: DataFrame, text: str = "TypeDeclaration") -> DataFrame:
    """Add ``_name``, ``_params`` (as declared), ``_vars`` (names only).

    ``_params`` is null where the declaration has no readable shape.
    """
    # the parameter list is the outermost brace group that closes the text
    df = decls.withColumn("_dtok", lexical.snippet_tokens(F.col(text)))
    df = df.withColumn("_dt", F.expr(lexical.bracketed("_dtok")))
    df = df.withColumn("_dg", F.expr("""
        case when size(_dt.out) > 2 and element_at(_dt.out, -1).t = '}' then
          transform(
            filter(sequence(1, 1 + size(filter(_dt.out, y -> y.t = ',' and y.par = element_at(_dt.out, -1).mate))),
                   j -> element_at(_dt.out, -1).i > element_at(_dt.out, -1).mate + 1),
            j -> struct(
              coalesce(get(transform(filter(_dt.out, y -> y.t = ',' and y.par = element_at(_dt.out, -1).mate), y -> y.i), j - 2),
                       element_at(_dt.out, -1).mate) + 1 as s,
              coalesce(get(transform(filter(_dt.out, y -> y.t = ',' and y.par = element_at(_dt.out, -1).mate), y -> y.i), j - 1),
                       element_at(_dt.out, -1).i) - 1 as e))
        end"""))
    spaced = lexical.spaced
    df = df.withColumn("_params", F.expr(f"""
        case when _dt.bad or size(_dt.out) = 0 then null
             when _dg is null then cast(array() as array<string>)
             else transform(_dg, a -> {spaced("_dt.out", "a.s", "a.e")}) end"""))
    df = df.withColumn("_vars", F.expr("""
        case when _dt.bad or size(_dt.out) = 0 then null
             when _dg is null then cast(array() as array<string>)
             else transform(_dg, a -> case
               when size(filter(_dt.out, y -> y.t = '<:' and y.i between a.s and a.e
                      and y.par = element_at(_dt.out, -1).mate)) = 2
               then get(_dt.out, get(filter(_dt.out, y -> y.t = '<:' and y.i between a.s and a.e
                      and y.par = element_at(_dt.out, -1).mate), 0).i + 1).t
               else get(_dt.out, a.s).t
             end) end"""))
    df = df.withColumn("_name", F.expr(f"""
        case when _dg is not null then {spaced("_dt.out", "0", "element_at(_dt.out, -1).mate - 1")}
             when size(_dt.out) = 1 and get(_dt.out, 0).k = 'n' then get(_dt.out, 0).t
             else '<NA-typename>' end"""))
    return df.drop("_dt", "_dtok", "_dg")


def wrap_in_where(body: Column, variables: Column) -> Column:
    """``t`` and [a, b] to ``(t where b) where a``: the first is outermost."""
    wrapped = F.aggregate(
        F.reverse(variables),
        F.struct(body.alias("text"), F.lit(0).alias("n")),
        lambda acc, v: F.struct(
            F.concat(
                F.when(acc["n"] > 0, F.concat(F.lit("("), acc["text"], F.lit(")"))).otherwise(acc["text"]),
                F.lit(" where "), v,
            ).alias("text"),
            (acc["n"] + 1).alias("n"),
        ),
        lambda acc: acc["text"],
    )
    return wrapped


def full_types(decls: DataFrame, text: str = "TypeDeclaration", super_: str = "Supertype") -> DataFrame:
    """Add ``_DeclFull``, ``_VarCnt`` and ``_SuperFull``.

    The declaration keeps its bounds; the supertype gets bare variables.
    """
    df = split_declaration(decls, text)
    bare = F.when(F.size("_params") > 0, F.concat(
        F.col("_name"), F.lit("{"), F.array_join("_vars", ", "), F.lit("}"))).otherwise(F.col(text))
    return df.withColumns({
        "_DeclFull": wrap_in_where(bare, F.col("_params")),
        "_VarCnt": F.size("_params"),
        "_SuperFull": wrap_in_where(
            F.when((F.size("_vars") > 0) & F.col(super_).contains(" where "),
                   F.concat(F.lit("("), F.col(super_), F.lit(")"))).otherwise(F.col(super_)),
            F.col("_vars")),
    }).drop("_name", "_params", "_vars")
