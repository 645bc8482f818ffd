"""Schemas of the stored tables: declared, never inferred."""

from pyspark.sql.types import StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


TYPE_ANNOTATIONS = _strings("File", "Function", "Kind", "TypeAnnotation")
TYPE_DECLARATIONS = _strings("File", "Name", "Kind", "TypeDeclaration", "Supertype")
PACKAGE_LIST = _strings("name", "uuid", "version")
