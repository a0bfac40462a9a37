"""Flatten nested structs into top-level columns joined by a delimiter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _walk(dtype: T.StructType, path: list[str], delimiter: str, out: list):
    for field in dtype.fields:
        p = path + [field.name]
        if isinstance(field.dataType, T.StructType):
            _walk(field.dataType, p, delimiter, out)
        else:
            ref = F.col(".".join(f"`{x}`" for x in p))
            out.append(ref.alias(delimiter.join(p)))


def flatten(df: DataFrame, delimiter: str = "_") -> DataFrame:
    """Every nested struct field becomes ``parent<delim>child``.

    A NULL struct yields NULL in each of its flattened columns, and a NULL
    inside the struct stays NULL.  The walk reads only the schema, so the
    result is a single projection that Catalyst prunes like any other.
    """
    cols: list = []
    _walk(df.schema, [], delimiter, cols)
    return df.select(*cols)
