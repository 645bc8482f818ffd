"""Annotation and declaration analysis: predicate columns over summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeharvest.functions import predicates as P
from typeharvest.operators import declarations, typevars


def analyze_annotations(
    annotations: DataFrame,
    registry: P.PredicateRegistry = P.DEFAULT_REGISTRY,
    text: str = "TypeAnnotation",
    dedupe: bool = False,
) -> DataFrame:
    """Summary columns plus one column per registered predicate.

    The built-in ones are worked out where the summary is, with ``dedupe`` once
    for each distinct text.
    """
    summarized = typevars.summarize(annotations, text, dedupe=dedupe, derive=registry.built_in)
    out = summarized.withColumns(registry.registered(summarized))
    return out.select(*[c for c in out.columns if c not in registry.columns or c in annotations.columns],
                      *[c for c in registry.columns if c not in annotations.columns])


def analyze_declarations(decls: DataFrame) -> DataFrame:
    """Full types of a declaration and its supertype, and their predicates."""
    full = declarations.full_types(decls)
    keep = full.columns
    left = typevars.summarize(full, "_DeclFull").withColumnsRenamed(
        {"UnrolledTypeAnnotation": "_DeclText", "TypeVarsSummary": "_DeclTv",
         "Error": "_DeclError", "Warning": "_DeclWarning"}
    )
    both = typevars.summarize(left, "_SuperFull").withColumnsRenamed(
        {"UnrolledTypeAnnotation": "_SuperText", "TypeVarsSummary": "_SuperTv",
         "Error": "_SuperError", "Warning": "_SuperWarning"}
    )
    bad = F.coalesce(F.col("_DeclError") | F.col("_SuperError") | F.col("_VarCnt").isNull(), F.lit(True))
    d, s = F.col("_DeclTv"), F.col("_SuperTv")
    ok = ~F.col("Error")
    return (
        both.withColumn("Error", bad)
        .withColumns({
            "Warning": F.col("Error") | F.col("_DeclWarning") | F.col("_SuperWarning"),
            "VarCnt": F.when(ok, F.col("_VarCnt")),
            "ProcessedTypeDecl": F.when(ok, F.col("_DeclText")),
            "ProcessedSuper": F.when(ok, F.col("_SuperText")),
            "TyDeclUseSiteVariance": F.when(ok, P.use_site_variance(d)),
            "SuperUseSiteVariance": F.when(ok, P.use_site_variance(s)),
            "TyDeclImpUseSiteVariance": F.when(ok, P.impredicative_use_site_variance(d)),
            "SuperImpUseSiteVariance": F.when(ok, P.impredicative_use_site_variance(s)),
            "TrivConsistBounds": F.when(
                ok, P.trivially_consistent_bounds(d) & P.trivially_consistent_bounds(s)
            ),
        })
        .drop(*[c for c in both.columns if c.startswith("_") and c not in decls.columns])
        .select(*decls.columns, "Error", "Warning", "VarCnt", "ProcessedTypeDecl", "ProcessedSuper",
                "TyDeclUseSiteVariance", "SuperUseSiteVariance", "TyDeclImpUseSiteVariance",
                "SuperImpUseSiteVariance", "TrivConsistBounds")
    )
