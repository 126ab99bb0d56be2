"""JSON lines flattened to (path, type, value) rows, and labels for their keys."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

DATA = Path(__file__).resolve().parent.parent / "data"


def data_rows(name: str) -> list[dict[str, str]]:
    """Rows of one of the package's tables of fixed values; lines starting with # are comments."""
    with open(DATA / name, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(line for line in f if not line.startswith("#")))


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(dotted path, type, value) of every leaf; elements of arrays share their array's path with ``[]``."""
    if isinstance(value, dict):
        if not value:
            yield path, "object", "{}"
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        if not value:
            yield path, "array", "[]"
        for inner in value:
            yield from leaves(inner, f"{path}[]")
    elif isinstance(value, bool):
        yield path, "bool", "true" if value else "false"
    elif value is None:
        yield path, "null", None
    elif isinstance(value, str):
        yield path, "string", value
    else:
        yield path, "int" if isinstance(value, int) else "double", str(value)


def flatten_json(df: DataFrame, raw_col: str = "raw", id_col: str = "idx") -> DataFrame:
    """(id_col, path, type, value) for every leaf of every row's document; what is not JSON gives no rows."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, raw in zip(batch[id_col], batch[raw_col], strict=True):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    continue
                if isinstance(value, (dict, list)):
                    out += [(key, *leaf) for leaf in leaves(value)]
            yield pd.DataFrame(out, columns=[id_col, "path", "type", "value"])

    return df.select(id_col, raw_col).mapInPandas(run, f"{id_col} {kind}, path string, type string, value string")


def key_rules(spark) -> DataFrame:
    """(priority, rule, context, key, label): labels for keys below certain ancestors."""
    rows = [(int(r["priority"]), r["rule"], r["context"] or "", r["key"], r["label"]) for r in data_rows("key_labels.csv")]
    return spark.createDataFrame(rows, "priority int, rule string, context string, key string, label string")


def with_key_labels(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """``paths`` with ``label``: that of the first rule whose context fits the key's ancestors, else the key.

    A context is one whole ancestor's key: the nearest one for ``ends``, any for
    ``contains``, any but the nearest for ``below``.  The ancestor of top-level keys is
    ``document``.  A path's rules are met through its key, by an equi-join with the
    rule table (a fixed table of some hundred rows).
    """
    parts = F.split(F.concat(F.lit("document."), F.regexp_replace(path_col, r"\[\]", "")), r"\.")
    key = F.element_at(parts, -1)
    keyed = paths.select(path_col).distinct().select(path_col, key.alias("key"), F.slice(parts, 1, F.size(parts) - 1).alias("above"))
    nearest, anywhere = F.element_at("above", -1) == F.col("context"), F.array_contains("above", F.col("context"))
    fits = F.when(F.col("rule") == "ends", nearest).when(F.col("rule") == "contains", anywhere).when(F.col("rule") == "below", anywhere & ~nearest).otherwise(F.col("rule") == "any")
    best = keyed.join(F.broadcast(rules), "key").where(fits).groupBy(path_col).agg(F.min_by("label", "priority").alias("label"))
    return paths.join(best, path_col, "left").withColumn("label", F.coalesce("label", key))
