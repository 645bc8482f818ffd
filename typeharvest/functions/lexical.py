"""Lexical column functions over source text.

Everything here is a built-in Spark expression. Token patterns use possessive
groups only, so matching never recurses however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Token patterns of the corpus language
# ---------------------------------------------------------------------------
IDENT = r"(?:[\p{L}\p{Nl}_∂∇∞][\p{L}\p{N}\p{Mn}_′]*+(?:!(?!=)[\p{L}\p{N}_!]*+)?+)"
OPERATOR_NAME = r"(?:[-+*/\\^%÷<>=!~&|≤≥≠∈∉⊆⊂∪∩∘⊻]++)"
QUALIFIED = (
    rf"(?:@?{IDENT}(?:\.@?{IDENT})*+"
    rf"(?:\.:\({OPERATOR_NAME}\)|\.:{OPERATOR_NAME})?+)"
)
NUMBER = r"(?:0x[0-9a-fA-F_]++|\d[\d_]*+(?:\.\d[\d_]*+)?+(?:[eEf][-+]?\d++)?+)"
TRIPLE_STRING = r'(?:"""(?s:.*?)""")'
STRING = (
    r'(?:"(?:[^"\\$]++|\\(?s:.)'
    r'|\$\((?:[^()"]++|"[^"]*+"|\((?:[^()"]++|"[^"]*+")*+\))*+\)|\$)*+")'
)
CHAR = r"(?:(?=')(?<![\p{L}\p{N}_)\]}'])'(?:\\[^']*+(?:'(?=')|)|[^'\\])')"
COMMAND = r"(?:`[^`]*+`)"
VAR_STRING = r'(?:var"[^"]*+")'
BLOCK_COMMENT = r"(?:#=(?s:.*?)=#)"
LINE_COMMENT = r"(?:#[^\n]*+)"
MULTI_OPERATOR = (
    r"(?:<:|>:|::|\.\.\.|===|!==|==|!=|<=|>=|->|=>|&&=?|\|\|=?|\|>|<\||<<|>>>?|//"
    r"|\.=|\.[-+*/\\^%&|÷<>=!]=?|[-+*/\\^%&|÷⊻]=|[≤≥≠∈∉⊆⊂]|\.\.)"
)
ANY_CHAR = r"(?:[^\s])"

#: tokens of one annotation or head (white space is dropped)
SNIPPET_TOKEN = "|".join(
    [VAR_STRING, TRIPLE_STRING, STRING, CHAR, COMMAND, NUMBER, QUALIFIED, MULTI_OPERATOR, ANY_CHAR]
)
#: tokens of a whole file: each match carries the white space before it, so
#: lengths add up to exact character offsets
FILE_TOKEN = r"\s*+(?:" + "|".join(
    [BLOCK_COMMENT, LINE_COMMENT, VAR_STRING, TRIPLE_STRING, STRING, CHAR, COMMAND,
     NUMBER, QUALIFIED, MULTI_OPERATOR, ANY_CHAR]
) + ")"

#: a bracketed list of plain names, nested at most three deep: no variable, no operator
_PLAIN0 = rf"\s*+{IDENT}(?:\.{IDENT})*+\s*+"
_PLAIN1 = rf"(?:{_PLAIN0}(?:\{{(?:{_PLAIN0}(?:,{_PLAIN0})*+)?+\}}\s*+)?+)"
_PLAIN2 = rf"(?:{_PLAIN0}(?:\{{(?:{_PLAIN1}(?:,{_PLAIN1})*+)?+\}}\s*+)?+)"
_PLAIN3 = rf"(?:{_PLAIN0}(?:\{{(?:{_PLAIN2}(?:,{_PLAIN2})*+)?+\}}\s*+)?+)"
PLAIN_TYPE = rf"^(?!.*\bwhere\b){_PLAIN3}$"

#: constraint operators of the text census
CONSTRAINT_PATTERNS = {"sub": "<:", "sup": ">:"}


def literal_count(text: Column | str, needle: str) -> Column:
    """Number of non-overlapping occurrences of ``needle``, as BIGINT."""
    text = F.col(text) if isinstance(text, str) else text
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle))).cast("bigint")


def pattern_counts(text: Column | str, patterns: dict[str, str] | None = None) -> list[Column]:
    """One BIGINT count column per named literal pattern."""
    patterns = CONSTRAINT_PATTERNS if patterns is None else patterns
    return [literal_count(text, p).alias(name) for name, p in patterns.items()]


def snippet_tokens(text: Column) -> Column:
    """Array of the tokens of a short snippet, white space and comments dropped."""
    return F.regexp_extract_all(text, F.lit(SNIPPET_TOKEN), F.lit(0))


# ---------------------------------------------------------------------------
# Bracket structure of a token array
# ---------------------------------------------------------------------------
def bracketed(tokens: str) -> str:
    """SQL: token array -> struct(stack, out, bad).

    ``out`` holds (i, t, k, par, mate): position, text, class, enclosing opener
    (-1 at top) and, for a closer, its opener (-2 otherwise). Classes:
    n name, q qualified name, m macro name, d literal, w ``where``, o other.
    """
    cls = (
        "case when t = 'where' then 'w'"
        r" when t rlike '^[\\p{L}\\p{Nl}_∂∇∞]' and not t rlike '^var\"' and contains(t, '.') then 'q'"
        r" when t rlike '^var\"' then 'n'"
        r" when t rlike '^[\\p{L}\\p{Nl}_∂∇∞]' then 'n'"
        r" when startswith(t, '@') and length(t) > 1 then 'm'"
        r" when t rlike '^[0-9\"`]' or (startswith(t, '\'') and length(t) > 1) then 'd'"
        " else 'o' end"
    )
    return f"""
    aggregate({tokens},
      named_struct('stack', array(-1),
                   'out', cast(array() as array<struct<i:int,t:string,k:string,par:int,mate:int>>),
                   'bad', false),
      (acc, t) -> named_struct(
        'stack', case when t in ('(', '[', '{{') then array_append(acc.stack, size(acc.out))
                      when t in (')', ']', '}}') then slice(acc.stack, 1, greatest(size(acc.stack) - 1, 1))
                      else acc.stack end,
        'out', array_append(acc.out, named_struct(
            'i', size(acc.out), 't', t, 'k', {cls},
            'par', case when t in (')', ']', '}}')
                        then coalesce(get(acc.stack, size(acc.stack) - 2), -1)
                        else element_at(acc.stack, -1) end,
            'mate', case when t in (')', ']', '}}') then element_at(acc.stack, -1) else -2 end)),
        'bad', acc.bad or (t in (')', ']', '}}') and not (
            (t = ')' and get(acc.out, element_at(acc.stack, -1)).t <=> '(') or
            (t = ']' and get(acc.out, element_at(acc.stack, -1)).t <=> '[') or
            (t = '}}' and get(acc.out, element_at(acc.stack, -1)).t <=> '{{')))),
      acc -> named_struct('out', acc.out, 'bad', acc.bad or size(acc.stack) <> 1))
    """


#: classes of tokens as numbers, in an order that makes the usual questions ranges
NAME, QUALIFIED_NAME, LITERAL, MACRO, WHERE, SQUARE_OPEN, COMMA, BELOW, ABOVE, OTHER, SQUARE_CLOSE, CURLY_CLOSE, ROUND_CLOSE, CURLY_OPEN, ROUND_OPEN = range(15)


def bracket_steps(tokens: str, out: str) -> list[tuple[str, str]]:
    """(column, SQL) projections, in order: the column ``out`` is what ``bracketed``
    calls so, null where the brackets are bad. ``out``_c holds the classes as numbers,
    ``out``_i the positions and ``out``_p the pairs of brackets, in the order they are
    closed in; who reads these alone does not pay for ``out``. Only brackets pass through
    a stack, as numbers; tokens look up the few pairs around them, of which the innermost
    was closed first, so no array grows token by token.

    Spark evaluates lambdas by interpretation, where ``in`` (of few values) and
    ``array_position`` throw to return, ``case`` looks its branches up in a linked list
    and each struct is built from one; so they are avoided here.
    """
    name = f"if(contains(t, '.'), {QUALIFIED_NAME}, {NAME})"
    fixed = {"{": CURLY_OPEN, "}": CURLY_CLOSE, ",": COMMA, "<:": BELOW, "(": ROUND_OPEN, ")": ROUND_CLOSE, ">:": ABOVE,
             "[": SQUARE_OPEN, "]": SQUARE_CLOSE}
    rest = f"""
      if(t in ('$', ':', '::', '=', '.', '...', ';', '+', '-', '*', '/', '->', '=>', '?'), {OTHER},
      if(t rlike '^[\\\\p{{L}}\\\\p{{Nl}}_∂∇∞]', {name},
      if(startswith(t, '@') and length(t) > 1, {MACRO},
      if(t rlike '^[0-9\\"`]' or (startswith(t, '\\'') and length(t) > 1), {LITERAL}, {OTHER}))))
    """
    classes = f"""
    transform({tokens}, t ->
      if(t >= 'A' and t < '[', {name},
      if(t >= 'a' and t < '{{', if(t = 'where', {WHERE}, if(startswith(t, 'var"'), {NAME}, {name})),
      {"".join(f"if(t = '{t}', {c}, " for t, c in fixed.items())}{rest}{")" * len(fixed)})))
    """
    positions = f"if(size({tokens}) > 0, sequence(0, size({tokens}) - 1), cast(array() as array<int>))"
    # a number on the stack: the position of an open bracket, or below zero a closed pair; null for a closer without one
    o, c = "cast((-1 - v) div 4294967296 as int)", "cast((-1 - v) % 4294967296 as int)"
    opens = f"(get({out}_c, i) >= {CURLY_OPEN} or get({out}_c, i) = {SQUARE_OPEN})"
    pairs = f"""
    aggregate(filter({out}_i, i -> get({out}_c, i) >= {SQUARE_CLOSE} or get({out}_c, i) = {SQUARE_OPEN}),
      cast(array() as array<bigint>),
      (acc, i) -> if({opens}, array_append(acc, cast(i as bigint)),
        if(coalesce(array_max(acc), -1) < 0, array_append(acc, cast(null as bigint)),
          array_append(array_remove(acc, array_max(acc)), -1 - (array_max(acc) * 4294967296 + i)))),
      acc -> if({tokens} is null or exists(acc, v -> v is null or v >= 0 or not get({out}_c, {o}) <=>
                 if(get({out}_c, {c}) = {ROUND_CLOSE}, {ROUND_OPEN}, if(get({out}_c, {c}) = {CURLY_CLOSE}, {CURLY_OPEN}, {SQUARE_OPEN}))),
               null, transform(acc, v -> named_struct('o', {o}, 'c', {c}))))
    """
    placed = f"""
    if({out}_p is null, null, transform({tokens}, (t, i) -> named_struct('i', i, 't', t,
        'k', coalesce(get(array('n','q','d','m','w'), get({out}_c, i)), 'o'),
        'par', coalesce(get(filter({out}_p, p -> i < p.c and i > p.o), 0).o, -1),
        'mate', if(get({out}_c, i) >= {SQUARE_CLOSE} and get({out}_c, i) <= {ROUND_CLOSE},
                   get(filter({out}_p, p -> p.c = i), 0).o, -2))))
    """
    return [(f"{out}_c", classes), (f"{out}_i", positions), (f"{out}_p", pairs), (out, placed)]


def spaced(tokens: str, lo: str, hi: str) -> str:
    """SQL: text of the tokens lo..hi in the corpus' printed spacing.

    A binary constraint operator has spaces around it, a leading one has none.
    """
    return f"""
    trim(array_join(transform(filter({tokens}, z -> z.i between {lo} and {hi}), z -> case
        when z.t = ',' then ', '
        when z.t = ';' then '; '
        when z.k = 'w' then ' where '
        when z.t in ('<:', '>:') and (z.i = 0 or get({tokens}, z.i - 1).t in ('{{', '(', ',')) then z.t
        when z.t in ('<:', '>:', '=', '->', '+', '*', '/', '==', '!=', '<', '>', '<=', '>=', '|', '&', '-', '÷', '%')
          then concat(' ', z.t, ' ')
        else z.t end), ''))
    """


def sealed(df: DataFrame, keep: list[str], derived: dict[str, Column]) -> DataFrame:
    """Project ``keep`` and ``derived`` so that later filters stay above them.

    A filter on a column is otherwise rewritten in terms of the projections it
    was built from; through a long chain of array columns that rewrite grows
    without bound. A filter on generated columns is not pushed down.
    """
    fields = [c.alias(n) for n, c in derived.items()]
    out = df.select(*keep, F.explode(F.array(F.struct(*fields))).alias("_sealed"))
    return out.select(*keep, *[F.col("_sealed")[n].alias(n) for n in derived])
