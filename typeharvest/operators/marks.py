"""Positions of interest in source files, found with windows over a token table.

Files are hash-distributed once by (Package, File) *before* they are exploded to
tokens, so only the raw text is shuffled; every window below then reuses that
distribution. All windows are running (prefix) frames, hence linear in the file.

(Package, File) must identify a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeharvest.functions import lexical, scanner
from typeharvest.session import shuffle_width

FILE_KEY = ["Package", "File"]

# Reserved words of the corpus language
KEYWORDS = [
    "function", "macro", "begin", "quote", "try", "catch", "finally", "if", "elseif", "else",
    "for", "while", "let", "do", "struct", "module", "baremodule", "end", "return", "const",
    "global", "local", "export", "import", "using", "abstract", "primitive", "mutable", "in",
    "isa", "break", "continue",
]
BLOCK_WORDS = [
    "function", "macro", "begin", "quote", "try", "catch", "finally", "if", "elseif", "else", "for",
    "while", "let", "do", "struct", "module", "baremodule", "import", "using", "export", "primitive",
    "abstract", "mutable", "end",
]
COMPARISONS = ["<:", ">:", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "≤", "≥", "≠", "∈", "∉", "⊆", "⊂"]
LOWER_THAN_COMPARISON = ["=", "&&", "||", "?", "->", "=>", "+=", "-=", "*=", "/=", ".="]


ANNOTATION_KINDS = ("fn", "short", "arrow", "do", "ann")
DECLARATION_KINDS = ("struct", "mutable", "abstract", "primitive")
ALL_KINDS = (*ANNOTATION_KINDS, *DECLARATION_KINDS, "lb")

# One BIGINT of bits per token: its class, what it cuts, and the words that matter
_NAMES = (
    "ID NUM STR MACRO OP OPEN CLOSE SEP WHERE KW COMMENT K E T H CMP BLOCK SUP SUB SQUARE PAREN COLON"
    " TAIL FUNCTION EQ ARROW DO DCOLON STRUCT TYPEWORD MUTABLE ABSTRACT PRIMITIVE ASWORD QUOTE"
    " STARTS BESIDE CALL OPERAND"
).split()
_B = {name: 1 << i for i, name in enumerate(_NAMES)}


def _bits(*names: str) -> int:
    return sum(_B[n] for n in names)


def _word_bits() -> dict[str, int]:
    """Bits of every token with a meaning of its own (about a hundred)."""
    words: dict[str, int] = {}

    def add(tokens: list[str], *names: str) -> None:
        for tok in tokens:
            words[tok] = words.get(tok, 0) | _bits(*names)

    add(["(", "[", "{"], "OPEN")
    add([")", "]", "}"], "CLOSE")
    add([",", ";"], "SEP", "K", "E", "T")
    add([";"], "H")
    add(["where"], "WHERE", "K")
    add(KEYWORDS, "KW", "K", "E", "T", "H")
    add(BLOCK_WORDS, "BLOCK")
    add(LOWER_THAN_COMPARISON, "OP", "K", "E", "T")
    add([t for t in COMPARISONS if t not in ("<:", ">:")], "T")
    add(COMPARISONS, "OP", "CMP")
    add([".", "$"], "OP")
    add([":", "...", "'", "::"], "OP", "T")
    add([">:"], "SUP")
    add(["<:"], "SUB")
    add(["["], "SQUARE")
    add(["("], "PAREN")
    add([":"], "COLON")
    add(["...", "'"], "TAIL")
    add(['"', "`"], "QUOTE", "OP", "T")
    add(["as", "public"], "ASWORD", "ID")
    add(["type"], "TYPEWORD", "ID")
    for tok, name in (("function", "FUNCTION"), ("=", "EQ"), ("->", "ARROW"), ("do", "DO"), ("::", "DCOLON"),
                      ("struct", "STRUCT"), ("mutable", "MUTABLE"), ("abstract", "ABSTRACT"),
                      ("primitive", "PRIMITIVE")):
        add([tok], name)
    return words


def word_table(spark: SparkSession) -> DataFrame:
    """The fixed word table (tok, bits): its size does not depend on any data."""
    quote = lambda w: w.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    rows = ", ".join(f"('{quote(w)}', {bits}L)" for w, bits in _word_bits().items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(word, bits)")


_FAR = 2147483647


def distribute(files: DataFrame) -> DataFrame:
    """The one exchange of the file jobs: the code of each file, by file.

    The number of partitions is given, so adaptive execution does not merge
    them: a partition that is small as text is large once it is tokens.
    """
    return scanner.code_only(files).repartition(shuffle_width(files.sparkSession), *FILE_KEY)


def _other_bits() -> Column:
    """Bits of a token without a meaning of its own, from its first character."""
    code = F.ascii("tok")
    name = F.when(F.col("tok").contains("@"), _bits("MACRO", "E")).otherwise(_bits("ID"))
    string = F.when(F.length("tok") > 1, _bits("STR")).otherwise(_bits("OP", "T"))
    return (
        F.when(code.between(97, 122) | code.between(65, 90) | (code == 95), name)
        .when(code.between(48, 57), _bits("NUM"))
        .when(code == 35, _bits("COMMENT"))
        .when(code.isin(34, 39, 96), string)
        .when((code == 64) & (F.length("tok") > 1), name)
        .when(code < 128, _bits("OP", "T"))
        .when(F.col("tok").rlike(r"^[\p{L}\p{Nl}_∂∇∞]"), name)
        .otherwise(_bits("OP", "T"))
    )


def _any(column: str, *names: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(_bits(*names))) != 0


def _flag(test: Column, *names: str) -> Column:
    return F.when(test, F.lit(_bits(*names))).otherwise(F.lit(0)).cast("bigint")


def tokens(files: DataFrame) -> DataFrame:
    """Token table of already distributed files, comments removed.

    Columns: pos, bits (with STARTS for the first token of a statement, BESIDE
    for an operand right after an operand, CALL for the bracket of a call,
    OPERAND after an operand), off/end (character offsets, 0-based, end
    exclusive), lev (brackets around the token), the bits and end of the previous
    token, the offset of the next, and ``bad`` (a sign the file cannot be read).
    """
    by_pos = Window.partitionBy(*FILE_KEY).orderBy("pos")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    df = files.select(
        *FILE_KEY,
        F.posexplode(F.regexp_extract_all("text", F.lit(lexical.FILE_TOKEN), F.lit(0))).alias("pos", "raw"),
    )
    df = df.select(
        *FILE_KEY, "pos", F.ltrim("raw", F.lit(" \n\t\r\f\x0b")).alias("tok"),
        F.length("raw").alias("width"), newlines(F.col("raw")).alias("nlines"))
    words = word_table(files.sparkSession)
    df = df.join(F.broadcast(words), F.col("tok") == F.col("word"), "left")
    df = df.select(
        *FILE_KEY, "pos", F.coalesce("bits", _other_bits()).alias("bits"), "width", "nlines",
        F.length("tok").alias("size"), newlines(F.col("tok")).alias("inside"))
    step = F.when(_any("bits", "OPEN"), 1).when(_any("bits", "CLOSE"), -1).otherwise(0)
    df = df.withColumns({
        "end": F.sum("width").over(by_pos),
        "line2": F.sum("nlines").over(by_pos),
        "run": F.sum(step).over(by_pos),
    })
    df = df.filter(~_any("bits", "COMMENT")).select(
        *FILE_KEY, "pos", "bits", "end", "line2", "run",
        (F.col("width") > F.col("size")).alias("spaced"),
        (F.col("end") - F.col("size")).alias("off"),
        (F.col("line2") - F.col("inside")).alias("line"),
    )
    df = df.withColumns({
        "pbits": F.lag("bits").over(by_pos), "pend": F.lag("end").over(by_pos),
        "pline": F.lag("line2").over(by_pos), "noff": F.lead("off").over(by_pos),
        "freeline": F.last(F.when(_any("bits", "BLOCK", "MACRO"), F.col("line")),
                           ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)),
    })
    df = df.withColumns({
        "lev": F.col("run") - F.when(_any("bits", "OPEN"), 1).otherwise(0),
        "pbits": F.coalesce("pbits", F.lit(0).cast("bigint")),
        "first": F.col("pend").isNull(),
        "fresh": F.col("pline").isNull() | (F.col("line") > F.col("pline")),
    })
    starts = F.col("first") | (
        F.col("fresh")
        & (~_any("pbits", "OP", "OPEN", "SEP", "WHERE") | _any("pbits", "TAIL"))
        & ~_any("bits", "CLOSE")
        & ~((F.col("lev") > 0) & _any("bits", "OP"))
    )
    operand = _any("pbits", "ID", "NUM", "STR", "CLOSE")
    beside = ~F.col("fresh") & operand & ~_any("pbits", "TYPEWORD") & F.col("spaced") & _any("bits", "ID", "NUM", "STR", "MACRO")
    call = ~F.col("spaced") & _any("bits", "PAREN") & _any("pbits", "ID", "CLOSE", "OP")
    cut_colon = F.col("spaced") & _any("bits", "COLON")
    df = df.withColumn("bits", F.col("bits").bitwiseOR(_flag(starts, "STARTS")).bitwiseOR(
        _flag(beside, "BESIDE", "T", "H")).bitwiseOR(_flag(call, "CALL")).bitwiseOR(
        _flag(operand, "OPERAND")).bitwiseOR(_flag(cut_colon, "K", "E")))
    bad = (F.col("run") < 0) | _any("bits", "QUOTE") | (F.col("noff").isNull() & (F.col("run") != 0))
    # two operands side by side, where no macro or block word on the line allows it
    juxtaposed = (_any("bits", "BESIDE") & _any("bits", "ID") & ~_any("bits", "ASWORD")
                  & ~_any("pbits", "ASWORD", "TYPEWORD")
                  & ~F.coalesce(F.col("freeline") == F.col("line"), F.lit(False)))
    return df.select(*FILE_KEY, F.col("pos").cast("bigint").alias("pos"), "bits", "off", "end", "pend", "noff",
                     "lev", "pbits", "first", bad.alias("bad"), juxtaposed.alias("jux"))


_MARKED = ("FUNCTION", "EQ", "ARROW", "DO", "DCOLON", "STRUCT", "SUP", "SUB", "TYPEWORD", "CMP")


def levels(token_table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows per bracket level, each a small set of numbers.

    A bracket is a *node* of the level around it and an *edge* of the level it
    encloses. Tokens that neither cut, nor open, nor could be marked are left
    out: positions keep counting them.
    """
    needed = ("STARTS", "K", "CMP", "OPEN", "CLOSE")
    if not set(kinds) <= {"lb"}:
        needed += ("E", "T", "H", "CALL", "WHERE", *_MARKED)
    df = token_table.filter(_any("bits", *needed) | F.col("bad") | F.col("jux") | F.col("first"))
    edge = F.struct((F.col("lev") + 1).alias("lv"), F.lit(True).alias("edge"))
    plain = F.struct(F.col("lev").alias("lv"), F.lit(False).alias("edge"))
    df = df.withColumn("at", F.explode(
        F.when(_any("bits", "OPEN", "CLOSE"), F.array(plain, edge)).otherwise(F.array(plain))))
    is_edge = F.col("at.edge")
    return df.select(
        *FILE_KEY, "pos", "off", "end", "pend", "noff", F.col("at.lv").alias("lv"), "pbits",
        F.when(is_edge, F.col("bits").bitwiseAND(F.lit(_bits("OPEN", "SQUARE"))).bitwiseOR(
            F.lit(_bits("K", "E", "T", "H")))).otherwise(F.col("bits")).alias("bits"),
        F.when(is_edge & _any("bits", "OPEN"), _any("bits", "SQUARE")).alias("square"),
        (F.col("bad") & ~is_edge).alias("bad"), (F.col("jux") & ~is_edge).alias("jux"),
        (F.col("first") & ~is_edge).alias("first"), is_edge.alias("edge"),
    )


def _kind() -> Column:
    return (
        F.when(F.col("edge"), None)
        .when(_any("bits", "FUNCTION"), F.when(~_any("pbits", "COLON"), "fn"))
        .when(_any("bits", "EQ"), "short").when(_any("bits", "ARROW"), "arrow").when(_any("bits", "DO"), "do")
        .when(_any("bits", "DCOLON"), "ann")
        .when(_any("bits", "STRUCT"), F.when(_any("pbits", "MUTABLE"), "mutable").otherwise("struct"))
        .when(_any("bits", "TYPEWORD"), F.when(_any("pbits", "ABSTRACT"), "abstract").when(
            _any("pbits", "PRIMITIVE"), "primitive"))
        .when(_any("bits", "SUP", "SUB"), "lb").when(_any("bits", "CMP"), "cmp")
    )


def _pack(pos: Column, off: Column) -> Column:
    """Position and offset in one BIGINT: windows keep fixed-width state."""
    return F.shiftleft(pos.cast("bigint"), 32).bitwiseOR(off.cast("bigint"))


def _pos(packed: str) -> Column:
    return F.shiftright(F.col(packed), 32)


def _off(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << 32) - 1))


def marks(files: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """One row per position of interest of already distributed files.

    Columns: kind, pos, start/stop (character range of its text, stop exclusive)
    and broken (the file cannot be read). Each file with a token has one ``file``
    row. Kinds: fn, short, arrow, do (method heads), ann (``e :: T``), struct,
    mutable, abstract, primitive (declarations), lb (lower bound).
    """
    wanted = set(kinds)
    df = levels(tokens(files), kinds)
    by_level = Window.partitionBy(*FILE_KEY, "lv").orderBy("pos")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*FILE_KEY, "lv").orderBy(F.desc("pos")).rowsBetween(
        Window.unboundedPreceding, -1)
    own = F.when(_any("bits", "STARTS"), _pack(F.col("pos"), F.col("off")))

    def from_cut(bit: str) -> Column:
        here = F.when(_any("bits", bit), _pack(F.col("pos") + 1, F.col("end"))).when(
            _any("bits", "STARTS"), _pack(F.col("pos"), F.col("off")))
        return F.coalesce(own, F.last(here, ignorenulls=True).over(before))

    def to_cut(bit: str) -> Column:
        here = F.when(_any("bits", bit, "STARTS"), _pack(F.col("pos"), F.coalesce(F.col("pend"), F.lit(0))))
        return F.last(here, ignorenulls=True).over(after)

    def last_pos(bit: str) -> Column:
        return F.last(F.when(_any("bits", bit) & ~F.col("edge"), F.col("pos")), ignorenulls=True).over(before)

    forward = {"around": F.last("square", ignorenulls=True).over(before)}
    backward = {}
    if "lb" in wanted:
        forward["k0"], backward["k1"] = from_cut("K"), to_cut("K")
    if wanted & {"short", "arrow"}:
        forward |= {"e0": from_cut("E"), "call_at": last_pos("CALL"), "where_at": last_pos("WHERE")}
    if "ann" in wanted:
        backward["t1"] = to_cut("T")
    if wanted & {"fn", "do", *DECLARATION_KINDS}:
        backward["h1"] = to_cut("H")
    df = df.withColumns(forward)
    keep = [k for k in ("fn", "short", "arrow", "do", "ann", *DECLARATION_KINDS, "lb") if k in wanted]
    if "lb" in wanted:
        keep.append("cmp")
    if backward:
        df = df.withColumns(backward)
    df = df.withColumn("kind", _kind()).withColumn("bad", F.col("bad") | (F.col("jux") & ~F.coalesce("around", F.lit(False))))
    df = df.filter(F.col("kind").isin(keep) | F.col("bad") | F.col("first"))

    # few rows are left: chains of comparisons, and whether the file is readable
    extra = {"broken": F.max("bad").over(Window.partitionBy(*FILE_KEY))}
    far = F.lit(_FAR).cast("bigint")
    operand = _any("bits", "OPERAND")
    kind = F.col("kind")
    next_off = F.coalesce(F.col("noff"), F.col("end"))

    def mark(start: Column, stop: Column) -> Column:
        return F.struct(F.greatest(start, F.lit(0)).cast("bigint").alias("start"),
                        stop.cast("bigint").alias("stop"))

    found = F.lit(None).cast("struct<start:bigint,stop:bigint>")
    cases: list[tuple[Column, Column]] = []
    if "fn" in wanted:
        cases.append((kind == "fn", mark(next_off, F.coalesce(_off("h1"), far))))
    if "short" in wanted:
        cases.append(((kind == "short") & F.coalesce(
            (F.col("call_at") >= _pos("e0")) | (F.col("where_at") >= _pos("e0")), F.lit(False)),
            mark(_off("e0"), F.col("pend"))))
    if "arrow" in wanted:
        cases.append((kind == "arrow", mark(_off("e0"), F.col("pend"))))
    if "do" in wanted:
        cases.append((kind == "do", mark(F.col("end"), F.coalesce(_off("h1"), far))))
    if "ann" in wanted:
        cases.append(((kind == "ann") & operand, mark(next_off, F.coalesce(_off("t1"), far))))
    if wanted & set(DECLARATION_KINDS):
        cases.append((kind.isin(*DECLARATION_KINDS), mark(next_off, F.coalesce(_off("h1"), far))))
    if "lb" in wanted:
        chain = Window.partitionBy(*FILE_KEY, "lv", F.when(_any("bits", "CMP"), _pos("k0"))).orderBy("pos")
        for name, n in (("c1", 1), ("c2", 2), ("c3", -1)):
            extra[name] = F.lag(F.struct("off", _any("bits", "SUP").alias("sup"), operand.alias("operand"), kind.alias("kind")), n).over(chain)
        has_left = operand & (_pos("k0") < F.col("pos"))
        has_right = F.col("noff").isNotNull() & (F.coalesce(_pos("k1"), far) > F.col("pos") + 1)
        last = F.col("c3").isNull()
        single = (kind == "lb") & _any("bits", "SUP") & F.col("c1").isNull() & last & has_right & (
            has_left | ~_any("pbits", "OP"))
        second = ((kind == "lb") & _any("bits", "SUB") & F.col("c1").isNotNull() & F.col("c2").isNull() & last
                  & has_right & has_left & (F.col("c1.kind") == "lb") & ~F.col("c1.sup") & F.col("c1.operand"))
        cases.append((single, mark(next_off, F.coalesce(_off("k1"), far))))
        cases.append((second, mark(_off("k0"), F.col("c1.off"))))
    df = df.withColumns(extra)
    picked = None
    for test, value in cases:
        picked = F.when(test, value) if picked is None else picked.when(test, value)
    df = df.withColumn("m", found if picked is None else picked)
    df = df.withColumn("hit", F.explode(F.array_compact(F.array(
        F.when(F.col("m").isNotNull(), F.struct(kind.alias("kind"), F.col("m.start"), F.col("m.stop"))),
        F.when(F.col("first"), F.struct(F.lit("file").alias("kind"), F.lit(0).cast("bigint").alias("start"),
                                        F.lit(0).cast("bigint").alias("stop")))))))
    return df.select(*FILE_KEY, "pos", F.col("hit.kind").alias("kind"), F.col("hit.start").alias("start"),
                     F.col("hit.stop").alias("stop"), "broken")
