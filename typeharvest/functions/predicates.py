"""Predicates over the nested type-variable summary, as a registry.

Every predicate is a Column builder over ``array<struct<name, lb, ub, occurrs,
context>>`` with outermost-first stacks. Registering one adds its column, its
summary row and its filtered table to the analysis job.
"""

from __future__ import annotations

import operator
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

# Constructor labels by the way a variable may cross them
COVARIANT = ["Tuple", "Union", "Where", "UpBnd", "UBVar1"]
LOWER = ["LoBnd", "LBVar1"]
INVARIANT_LIKE = ["Invar", "LoBnd", "LBVar1"]
SCOPE_BREAKING = ["Where", "UpBnd", "Union"]


def _one_of(label: Column, values: list[str]) -> Column:
    # not isin, which throws to return where Spark interprets it, as it does inside of lambdas
    return reduce(operator.or_, [label == v for v in values])


def _covariant(stack: Column) -> Column:
    return F.forall(stack, lambda label: F.coalesce(_one_of(label, COVARIANT), F.lit(False)))


def var_count(tv: Column) -> Column:
    return F.size(tv)


def has_where(tv: Column) -> Column:
    return F.size(tv) > 0


def vars_used_once(tv: Column) -> Column:
    return F.forall(tv, lambda v: F.size(v["occurrs"]) == 1)


def _use_site(v: Column) -> Column:
    only = F.get(v["occurrs"], F.lit(0))
    return (F.size(v["occurrs"]) == 0) | (
        (F.size(v["occurrs"]) == 1)
        & ((F.size(only) == 0) | _covariant(F.slice(only, 1, F.greatest(F.size(only) - 1, F.lit(0)))))
    )


def use_site_variance(tv: Column) -> Column:
    """Each variable is unused, or used once and bound immediately outside an
    invariant constructor (or used covariantly)."""
    return F.forall(tv, _use_site)


def impredicative_use_site_variance(tv: Column) -> Column:
    return F.forall(tv, lambda v: _use_site(v) | _covariant(v["context"]))


def exists_in_invariant(tv: Column) -> Column:
    return F.exists(tv, lambda v: F.exists(v["context"], lambda label: label == "Invar"))


def restricted_scope(tv: Column) -> Column:
    """No occurrence crosses an invariant-like label *directly* followed by a
    scope-breaking one; labels in between reset the test."""

    def crossing(stack: Column) -> Column:
        pairs = F.zip_with(
            stack,
            F.slice(stack, 2, F.greatest(F.size(stack), F.lit(1))),
            lambda a, b: F.coalesce(_one_of(a, INVARIANT_LIKE) & _one_of(b, SCOPE_BREAKING), F.lit(False)),
        )
        return (F.size(stack) > 1) & F.exists(pairs, lambda p: p)

    return F.forall(tv, lambda v: F.forall(v["occurrs"], lambda s: ~crossing(s)))


def closed_lower_bound(tv: Column) -> Column:
    return F.forall(
        tv, lambda v: F.forall(v["occurrs"], lambda s: ~F.exists(s, lambda label: _one_of(label, LOWER)))
    )


def trivially_consistent_bounds(tv: Column) -> Column:
    return F.forall(tv, lambda v: (v["lb"] == "Union{}") | (v["ub"] == "Any"))


@dataclass(frozen=True)
class Predicate:
    """``keep`` says which rows its filtered table holds: where the column is
    that value. ``None`` means the predicate has no table of its own. ``whole``
    is false if it reads occurrs and context only, and in no order."""

    column: str
    build: Callable[[Column], Column]
    keep: bool | None = None
    table: str | None = None
    whole: bool = True


_BUILT_IN = [
    Predicate("VarCnt", var_count, whole=False),
    Predicate("HasWhere", has_where, whole=False),
    Predicate("VarsUsedOnce", vars_used_once, whole=False),
    Predicate("UseSiteVariance", use_site_variance, False, "non-use-site", whole=False),
    Predicate("ImprUseSiteVariance", impredicative_use_site_variance, False, "non-imp-use-site", whole=False),
    Predicate("ExistInInv", exists_in_invariant, True, "exist-in-inv", whole=False),
    Predicate("RestrictedScope", restricted_scope, whole=False),
    Predicate("ClosedLowerBound", closed_lower_bound, whole=False),
    Predicate("TrivConsistBounds", trivially_consistent_bounds, False, "non-triv-consist-bnds"),
]


def attempt(value: Column) -> Column:
    """The value, or null in the rows where working it out is an error.

    Spark has this expression for its own try_ functions only; a session without
    a JVM of its own (Spark Connect) does not offer it.
    """
    jvm = SparkSession.active()._jvm
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return ClassicColumn(columns.column(jvm.org.apache.spark.sql.catalyst.expressions.TryEval(columns.expression(value._jc))))


class PredicateRegistry:
    """The ordered predicates an analysis evaluates.

    What is registered beyond the built-in ones cannot harm the others: where it
    fails in a row, that row's column is null, and where its expression cannot
    be built or resolved, its column is null throughout, with a warning.
    """

    def __init__(self) -> None:
        self._items: dict[str, Predicate] = {p.column: p for p in _BUILT_IN}

    def register(self, predicate: Predicate) -> PredicateRegistry:
        self._items[predicate.column] = predicate
        return self

    @property
    def predicates(self) -> list[Predicate]:
        return list(self._items.values())

    @property
    def columns(self) -> list[str]:
        return list(self._items)

    def built_in(self, tv: str, scopes: str) -> dict[str, Column]:
        """The columns of the built-in predicates over the summaries ``tv``, or
        over ``scopes``, occurrs and context of the same variables, where they
        read no more; null where the summary is null (rows that could not be read)."""
        return {p.column: F.when(F.col(c).isNotNull(), p.build(F.col(c)))
                for p in self.predicates if p in _BUILT_IN for c in [tv if p.whole else scopes]}

    def registered(self, summarized: DataFrame, tv: str = "TypeVarsSummary") -> dict[str, Column]:
        """The columns of the other predicates over the summaries ``tv``."""
        found = F.col(tv)
        return {p.column: F.when(found.isNotNull(), _isolated(p, summarized, found)) for p in self.predicates if p not in _BUILT_IN}


def _isolated(predicate: Predicate, summarized: DataFrame, tv: Column) -> Column:
    try:
        value = predicate.build(tv)
        summarized.select(value)  # resolves, or says why not
    except (AnalysisException, ArithmeticError, AttributeError, LookupError, NameError, TypeError, ValueError) as e:
        warnings.warn(f"predicate {predicate.column} is null throughout: {type(e).__name__}: {e}", stacklevel=2)
        return F.lit(None).cast("boolean")
    return attempt(value)


DEFAULT_REGISTRY = PredicateRegistry()
