"""Corpora derived from the star-schema tables, for queries and benchmarks.

The tables hold no source code, so each row of a table becomes a package file or
an annotation: its text is one of a fixed list of shapes, picked by the row's key
and filled with a type name that the row alone has, so distinct texts grow with
the table. A shape carries its known results, worked out by hand, so a plain SQL
join can state what a query must return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILL = "~A"  # stands for a type name of the row

# Known results: annotation shapes and their flags, in the order VarCnt,
# VarsUsedOnce, UseSiteVariance, ImprUseSiteVariance, RestrictedScope,
# ClosedLowerBound, ExistInInv, TrivConsistBounds, Warning; None where unreadable
ANNOTATIONS: list[tuple[str, tuple[int, ...] | None]] = [
    # no variable, one used once, one used twice
    ("Deque{~A}", (0, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Tuple{Deque{~A}, Shelf}", (0, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Deque{E} where E<:~A", (1, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Graph{V, V} where V", (1, 0, 0, 1, 1, 1, 0, 1, 0)),
    ("Tuple{V, Queue{V}, ~A} where V", (1, 0, 0, 1, 1, 1, 0, 1, 0)),
    # below an invariant constructor: another one, a tuple, a union
    ("Queue{Queue{V}} where V", (1, 1, 0, 1, 1, 1, 0, 1, 0)),
    ("Queue{Tuple{V, ~A}} where V", (1, 1, 0, 1, 1, 1, 0, 1, 0)),
    ("Queue{Union{~A, V}} where V", (1, 1, 0, 1, 0, 1, 0, 1, 0)),
    ("Union{Queue{V}, ~A} where V", (1, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Tuple{Union{V, Queue{~A}}} where V", (1, 1, 1, 1, 1, 1, 0, 1, 0)),
    # in the bounds of another variable
    ("Bag{W} where W<:Queue{V} where V", (2, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Bag{W} where W>:Queue{V} where V<:~A", (2, 1, 0, 1, 1, 0, 0, 1, 0)),
    ("Bag{W} where ~A<:W<:Queue{~A}", (1, 1, 1, 1, 1, 1, 0, 0, 0)),
    # shorthands
    ("Bag{<:~A}", (1, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Tuple{Bag{<:~A}, Bag{>:Odd}}", (2, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Queue{Bag{<:~A}}", (1, 1, 1, 1, 1, 1, 1, 1, 0)),
    # binders inside constructors
    ("Queue{Graph{V, ~A} where V}", (1, 1, 1, 1, 1, 1, 1, 1, 0)),
    ("Heap{K, Bag{L} where L} where K", (2, 1, 1, 1, 1, 1, 1, 1, 0)),
    ("Heap{K, Bag{K} where L<:~A} where K", (2, 0, 0, 1, 0, 1, 1, 1, 0)),
    ("Queue{Heap{K, K} where K<:~A}", (1, 0, 0, 0, 1, 1, 1, 1, 0)),
    ("Tuple{Heap{K, K} where K, ~A}", (1, 0, 0, 1, 1, 1, 0, 1, 0)),
    ("Queue{Tuple{Queue{K}, ~A} where K}", (1, 1, 1, 1, 1, 1, 1, 1, 0)),
    ("Queue{Queue{Queue{K}} where K}", (1, 1, 0, 0, 1, 1, 1, 1, 0)),
    ("Queue{Union{Bag{K}, ~A} where K}", (1, 1, 1, 1, 1, 1, 1, 1, 0)),
    # several variables in braces
    ("Tuple{Bag{J}, I} where {I, J}", (2, 1, 1, 1, 1, 1, 0, 1, 0)),
    ("Tuple{Bag{J}, Heap{I, J}} where {I, J<:~A}", (2, 0, 0, 1, 1, 1, 0, 1, 0)),
    ("Heap{$~A, K} where K", (1, 1, 1, 1, 1, 1, 0, 1, 1)),
    ("Bag{~A", None),
    ("Heap{~A}}", None),
    ("Bag{K<:~A}", None),
    ("Bag{K} where", None),
    ("~A Bag", None),
]

# Known results: shapes with their unrolled text and variables in order, each as
# name | lb | ub | occurrences ; separated | context (labels outermost first)
SUMMARIES: list[tuple[str, str, list[str]]] = [
    ("~A", "~A", []),
    ("K where K", "K where K", ["K|Union{}|Any||"]),
    ("Heap{K, Bag{L} where L>:K} where K<:~A", "Heap{K, Bag{L} where L >: K} where K <: ~A",
     ["L|K|Any|Invar|Where.Invar", "K|Union{}|~A|Invar;Invar.LoBnd|"]),
    ("Tuple{Queue{K}, L} where L<:Queue{K} where K", "(Tuple{Queue{K}, L} where L <: Queue{K}) where K",
     ["L|Union{}|Queue{K}|Tuple|Where", "K|Union{}|Any|UpBnd.Invar;Where.Tuple.Invar|"]),
    ("Queue{Union{Bag{K}, ~A} where K}", "Queue{Union{Bag{K}, ~A} where K}", ["K|Union{}|Any|Union.Invar|Invar"]),
    ("Map{R, S, ~A, T} where {R, S, T}", "((Map{R, S, ~A, T} where R) where S) where T",
     ["R|Union{}|Any|Invar|Where.Where", "S|Union{}|Any|Where.Invar|Where", "T|Union{}|Any|Where.Where.Invar|"]),
    ("Trie{Link{R, ~A} where Int<:R<:~A}", "Trie{Link{R, ~A} where Int <: R <: ~A}", ["R|Int|~A|Invar|Invar"]),
    ("R{S, ~A} where S where R", "(R{S, ~A} where S) where R", ["S|Union{}|Any|Var|Where", "R|Union{}|Any|Where|"]),
]

# Known results: source files with counts of <: and >:, status and lower bounds.
# A file that can be read holds its program once, twice or three times.
CODE: list[tuple[str, int, int, str, list[str]]] = [
    ("rotate(m::Mesh{<:~A}, angle) = m\n", 1, 0, "ok", []),
    ("origin() = ~A()\n", 0, 0, "vacuous", []),
    ("function restock!(s::Shelf{K, >:~A}, n::Int) where K\n  s.count += n\nend\n", 0, 1, "ok", ["~A"]),
    ("lend(b::Book, r::R) where {R >: ~A} = r\nborrow(b::Book; to::Set{>:Member} = none) = b\n", 0, 2, "ok", ["~A", "Member"]),
    ("weigh(c::Crate{U}) where {Gram <: U <: ~A} = c\n", 2, 0, "ok", ["Gram"]),
    ("pour(j::Jug{V}) where V <: ~A = j\n", 1, 0, "ok", []),
    ("paint(w::W, c::C) where {~A <: C <: Colour, W >: Wall} = w\n", 2, 1, "ok", ["~A", "Wall"]),
    ("inner(f::Fence{Post{>:~A}, Rail{>:Wood}}) :: Vector{>:Nail} = f\n", 0, 3, "ok", ["~A", "Wood", "Nail"]),
    ("check(x) = x isa Lens{>:~A} || Any >: Frame\n", 0, 2, "ok", ["~A", "Frame"]),
    ("chain(a::P) where ~A >: P >: Link = a\n", 0, 2, "ok", []),
    ("kinds = filter(k -> k <: ~A, all)\n", 1, 0, "ok", []),
    ("#= shelf >: ~A =#\nlabel = \"crate >: ~A\" # <: none\n", 1, 2, "ok", []),
    ("note = \"made of $(join(parts(Kit{>:~A}())))\"\n", 0, 1, "ok", ["~A"]),
    ("seal(v::Vat) where {S >: ~A, T >: S, U <: T} = v\n", 1, 2, "ok", ["~A", "S"]),
    ("mix(p::Paint{>:~A}, q::Paint{>:~A}) = p\nthin(p::Paint{>:Oil}) = p\n", 0, 3, "ok", ["~A", "~A", "Oil"]),
    ("tie(r::Rope{T}) where T >: Union{~A, Nothing} = r\n", 0, 1, "ok", ["Union{~A, Nothing}"]),
    ("cast(n::Net{>:Tuple{~A, Vararg{Fish}}}) = n\n", 0, 1, "ok", ["Tuple{~A, Vararg{Fish}}"]),
    ("#= low #= lower =# T >: ~A =#\nafter(y::Tank{>:~A}) = y\n", 0, 2, "ok", ["~A"]),
    ("", 0, 0, "vacuous", []),
    ("lock(d::Door{>:~A}) = key(\n", 0, 1, "error", []),
    ("open gate::Gate >: ~A\n", 0, 1, "error", []),
    ("drain(t::Tank{>:~A}) = t #= level #= low =#\n", 0, 1, "error", []),
    ("hide(b::Box{>:~A}) = \"lid\n", 0, 1, "error", []),
]

# Source files with their annotation rows (function, kind, type)
# and declaration rows (name, kind, declaration, supertype), in source order
_N = "<NOT A FUNSIG>"
SOURCES: list[tuple[str, list[tuple[str, str, str]], list[tuple[str, str, str, str]]]] = [
    ("area(r::~A) = r * r\nsides() = 4\n", [("area", "mtsig", "Tuple{~A}"), ("sides", "mtsig", "Tuple{}")], []),
    ("function walk(tree, depth::Int = 1, seen::Set{~A} = none)\n  left :: Node{<:~A}\n  left\nend\n",
     [("walk", "mtsig", "Tuple{Any, Int, Set{~A}}"), (_N, "tyassorann", "Node{<:~A}")], []),
    ("(top(h::Heap{K}) :: Entry{K, ~A}) where K = h\n",
     [("top", "mtsig", "Tuple{Heap{K}} where K"), ("top", "retty", "Entry{K, ~A}")], []),
    ("function pull(io::IO, n::~A; limit::L = 10, strict = true) :: Bool where L <: Integer\n  n < limit\nend\n",
     [("pull", "mtsig", "Tuple{IO, ~A, L, Any} where L <: Integer"), ("pull", "retty", "Bool")], []),
    ("Lib.Sub.step(s::~A) :: State = s\n", [("Lib.Sub.step", "mtsig", "Tuple{~A}"), ("Lib.Sub.step", "retty", "State")], []),
    ("module Geometry\nstruct Point\n  x :: ~A\nend\nmodule Inner\n  norm(p::Point, q::P) where P <: Point = 1\n"
     "  zero :: Float64\nend\nabstract type Shape end\nend\n",
     [(_N, "tyassorann", "~A"), ("norm", "mtsig", "Tuple{Point, P} where P <: Point"), (_N, "tyassorann", "Float64")],
     [("Point", "tdstrc", "Point", "Any"), ("Shape", "tdabst", "Shape", "Any")]),
    # comments inside heads, types and declarations; nested comments
    ("function draw(x::~A, # first, of two\n  #= #= =# z::Int, =# y::Bool)\n  x\nend\n",
     [("draw", "mtsig", "Tuple{~A, Bool}")], []),
    ("struct Grid{T, # cells\n  S} <: Base{T} end\nq :: Dict{~A, # key\n  Int}\n",
     [(_N, "tyassorann", "Dict{~A, Int}")], [("Grid", "tdstrc", "Grid{T, S}", "Base{T}")]),
    ("#= #= =# hidden(x::Int)=1 =#\nshown(y::~A)=1\n", [("shown", "mtsig", "Tuple{~A}")], []),
    ("say(s = \"$(g(h(\"x # y\")))\", t::~A = 1) = t\n", [("say", "mtsig", "Tuple{Any, ~A}")], []),
    ("f(; x, y = 0, z :: ~A, w :: Bool = false) = 1\n", [("f", "mtsig", "Tuple{Any, Any, ~A, Bool}")], []),
    ("f((a, b), @nospecialize(x), g(z), c::~A...) = 1\n",
     [("f", "mtsig", "Tuple{TUPLE_ARG, NOSPECIALIZE, CALL, Vararg{~A}}")], []),
    ("map(x -> x + 1, xs)\nfoo(xs) do a, b::~A\n  a\nend\n",
     [("<NA-name>", "mtsig", "Tuple{Any}"), ("<NA-name>", "mtsig", "Tuple{Any, ~A}")], []),
    ("abstract type Vehicle{F, W} end\nstruct Truck{L<:Load} <: Vehicle{Diesel, L}\n  axle :: ~A\nend\n"
     "primitive type Plate 32 end\nprimitive type Tag <: Label{~A} 16 end\n"
     "mutable struct Fleet{V, D<:Dict{V}} <: Group{V} end\n", [(_N, "tyassorann", "~A")],
     [("Vehicle", "tdabst", "Vehicle{F, W}", "Any"), ("Truck", "tdstrc", "Truck{L <: Load}", "Vehicle{Diesel, L}"),
      ("Plate", "tdprim", "Plate", "Any"), ("Tag", "tdprim", "Tag", "Label{~A}"),
      ("Fleet", "tdmtbl", "Fleet{V, D <: Dict{V}}", "Group{V}")]),
    # heads that have no signature, among some that have
    ("fine(c::~A) = c\nfunction twist(a + 1, b::~A)\n  b\nend\nlast(d::~A) = d\n",
     [("fine", "mtsig", "Tuple{~A}"), (_N, "tyassorann", "~A"), ("last", "mtsig", "Tuple{~A}")], []),
    ("each(~A()) do k + 1\n  k\nend\nnext(n::~A) :: Step = n\n(k + 1) -> k\n",
     [("next", "mtsig", "Tuple{~A}"), ("next", "retty", "Step")], []),
    ("broken(x::~A = 1\n", [], []),
    ("# f(x::Int) = 1\ns = \"g(y::Int) = 2\"\n@inline h(z::~A) = 3\n", [("h", "mtsig", "Tuple{~A}")], []),
]

# Known results: what extraction cannot shape in SOURCES, by the start of the
# program: offset without the fills, fills before it, kind, text
ERRORS: dict[str, list[tuple[int, int, str, str]]] = {
    "fine(c::": [(23, 1, "fn", "twist(a + 1, b::~A)")],
    "each(~A": [(11, 1, "do", "k + 1"), (48, 2, "arrow", "(k + 1)")],
}

# Known results: declarations with their full types and flags (VarCnt,
# declaration and supertype use-site, both impredicative, trivial bounds)
DECLARATIONS: list[tuple[str, str, str | None, str | None, tuple[int, ...] | None]] = [
    ("Crane{H<:Hook, J<:Joint{H}, B}", "Machine{B, H, ~A}",
     "((Crane{H, J, B} where B) where J <: Joint{H}) where H <: Hook", "((Machine{B, H, ~A} where B) where J) where H", (3, 0, 1, 1, 1, 1)),
    ("Bolt", "~A", "Bolt", "~A", (0, 1, 1, 1, 1, 1)),
    ("Rack{U}", "Frame{~A}", "Rack{U} where U", "Frame{~A} where U", (1, 1, 1, 1, 1, 1)),
    ("Duct{Int <: D <: ~A}", "Any", "Duct{D} where Int <: D <: ~A", "Any where D", (1, 1, 1, 1, 1, 0)),
    ("Pipe{F}", "Flow{Vector{F}, ~A}", "Pipe{F} where F", "Flow{Vector{F}, ~A} where F", (1, 1, 0, 1, 1, 1)),
    ("Valve{P}", "Part{Vector{Slot{Q, Q} where Q<:~A}}", "Valve{P} where P",
     "Part{Vector{Slot{Q, Q} where Q <: ~A}} where P", (1, 1, 0, 1, 0, 1)),
    ("Gear{", "Any", None, None, None),
]

FLAGS = ["VarCnt", "VarsUsedOnce", "UseSiteVariance", "ImprUseSiteVariance", "RestrictedScope",
         "ClosedLowerBound", "ExistInInv", "TrivConsistBounds"]
DECL_FLAGS = ["VarCnt", "TyDeclUseSiteVariance", "SuperUseSiteVariance", "TyDeclImpUseSiteVariance",
              "SuperImpUseSiteVariance", "TrivConsistBounds"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: programs of a file: one more than its number, by this
REPEATS = 3


def _pick(shapes: list[str], number: Column, fill: Column, repeated: list[bool] | None = None) -> Column:
    """The shape a row's number selects, filled with the row's type name;
    ``repeated`` shapes stand there one to REPEATS times."""
    at = (F.pmod(number, F.lit(len(shapes))) + 1).cast("int")
    chosen = F.replace(F.element_at(F.array(*[F.lit(s) for s in shapes]), at), F.lit(FILL), fill)
    if repeated is None:
        return chosen
    times = F.when(F.element_at(F.array(*[F.lit(r) for r in repeated]), at), F.pmod(number, F.lit(REPEATS)) + 1).otherwise(1)
    return F.repeat(chosen, times.cast("int"))


def _name(prefix: str, number: Column, modulus: int) -> Column:
    return F.concat(F.lit(prefix), F.pmod(number, F.lit(modulus)).cast("string"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per line item."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        _name("Pkg", F.col("l_partkey"), 50).alias("Package"),
        F.concat(F.lit("src/f"), F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
                 F.lit(".jl")).alias("File"),
        _pick([a for a, _ in ANNOTATIONS], F.col("l_orderkey") * 7 + F.col("l_linenumber"),
              F.concat(F.lit("N"), F.col("l_orderkey").cast("string"))).alias("TypeAnnotation"))


def summary_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), _pick(
        [a for a, _, _ in SUMMARIES], F.col("p_partkey"), F.concat(F.lit("N"), F.col("p_partkey").cast("string"))).alias("TypeAnnotation"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        _name("Pkg", F.col("o_custkey"), 50).alias("Package"),
        F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), F.lit(".jl")).alias("File"),
        _pick([c[0] for c in CODE], F.col("o_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
              [c[3] != "error" for c in CODE]).alias("text"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part."""
    p = read(spark, sf_dir, "part")
    return p.select(
        _name("Pkg", F.col("p_size"), 50).alias("Package"),
        F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".jl")).alias("File"),
        _pick([c[0] for c in SOURCES], F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("text"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration per customer."""
    c = read(spark, sf_dir, "customer")
    fill = F.concat(F.lit("D"), F.col("c_custkey").cast("string"))
    return c.select(
        _name("Pkg", F.col("c_custkey") * 7, 40).alias("Package"), F.col("c_custkey").alias("id"),
        _pick([d[0] for d in DECLARATIONS], F.col("c_custkey"), fill).alias("TypeDeclaration"),
        _pick([d[1] for d in DECLARATIONS], F.col("c_custkey"), fill).alias("Supertype"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed package per supplier; most have no file."""
    return read(spark, sf_dir, "supplier").select(_name("Pkg", F.col("s_suppkey"), 1 << 40).alias("Package"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per order: marked, marked late, marked twice or noise."""
    o = read(spark, sf_dir, "orders")
    body = F.concat(F.lit("Tuple{"), _name("C", F.col("o_custkey"), 97), F.lit("} where T"))
    mark, n = F.lit("JLSUBTYPELOG: "), F.pmod(F.col("o_orderkey"), F.lit(4))
    return o.select(
        F.when(n == 0, F.concat(mark, body)).when(n == 1, F.concat(F.lit("x "), mark, body))
        .when(n == 2, F.concat(mark, F.lit("y "), mark, body)).otherwise(F.concat(F.lit("noise "), body)).alias("value"))
