"""Query documents reduced to shapes: keys in order, literals by type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship

#: First keys of extended-JSON objects, and their placeholders (fixed values).
EXTENDED = {
    "$oid": "{oid}", "$date": "{date}", "$regex": "{regex}", "$numberDecimal": "{num}", "$numberDouble": "{num}",
    "$numberLong": "{num}", "$numberInt": "{num}", "$binary": "{bin}", "$timestamp": "{ts}",
}


class _Object(list):
    """Key-value pairs in document order, duplicates included."""


def _shape(value: object) -> str:
    if isinstance(value, _Object):
        if 1 <= len(value) <= 2 and value[0][0] in EXTENDED:
            return EXTENDED[value[0][0]]
        ranked = sorted(value, key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
        return "{" + ",".join(f"{k}:{_shape(v)}" for k, v in ranked) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_shape, value)) + "]"
    if isinstance(value, str):
        return "{str}"
    if isinstance(value, bool):
        return "{bool}"
    if value is None:
        return "{null}"
    return "{int}" if isinstance(value, int) else "{num}"


def _reject(name: str) -> None:
    raise ValueError(name)


def query_shape(text: str | None) -> str | None:
    """The shape of one JSON document; what is not JSON comes back as it is."""
    if not text:
        return text
    try:
        value = json.loads(text, object_pairs_hook=_Object, parse_constant=_reject)
    except (ValueError, RecursionError):
        return text
    return _shape(value)


def _shapes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield column.map(query_shape, na_action="ignore")


def with_shape(df: DataFrame, filter_col: str, shape_col: str = "shape") -> DataFrame:
    """``df`` with the shape of ``filter_col`` added.

    Documents are parsed in Arrow batches next to the scan; lines differ in their
    literals, so there is little to gain from a join with the distinct ones.  Rows
    without a document skip Python's work as nulls.
    """
    ship(df.sparkSession)
    return df.withColumn(shape_col, F.nullif(F.pandas_udf(_shapes, StringType())(F.col(filter_col)), F.lit("")))
