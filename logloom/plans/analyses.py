"""The six named analyses and their dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logtext as lt
from ..operators import breakdowns as b
from ..operators.filters import EntryFilter
from ..sources.logs import places
from ..store import keep


ORDER = ("ts_ms", "file_idx", "line_no")
#: What searches and error reports read of an entry.
READ = (*ORDER, "idx", "severity", "severity_rank", "component", "ns", "msg", "conn_id", "duration_ms", "node_idx")


def _parsed_once(entries: DataFrame) -> DataFrame:
    """The columns that a report reads, written unless they have an idx already: it reads them more than once."""
    if "idx" in entries.columns:
        return entries
    return keep(entries.select(*[c for c in READ if c in entries.columns]), "parsed")


def analysis_summary(entries: DataFrame, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """``totals``; ``top``: 30 labels of each dimension, 20 of shapes; ``nodes``: the node table, or the nodes seen."""
    counts = b.breakdowns(entries)
    listed = entries.select("node_idx").distinct() if nodes is None else nodes
    return {"totals": b.summary(entries), "nodes": listed.orderBy("node_idx"), "top": b.top(counts, 30, "dimension").where("dimension <> 'shape'").union(b.top(counts.where("dimension = 'shape'"), 20, "dimension"))}


def search_logs(
    entries: DataFrame, severity: str | None = None, component: str | None = None, namespace: str | None = None, text: str | None = None,
    time_start_ms: int | None = None, time_end_ms: int | None = None, min_duration_ms: int | None = None, limit: int = 50,
) -> dict[str, DataFrame]:
    """``entries``: the first matches in time order, at most 200; ``counts``: how many there are and how many came."""
    entries = _parsed_once(entries)
    found = EntryFilter(severity=severity, components=[component] if component is not None else (), ns=namespace, text=text, time_start_ms=time_start_ms, time_end_ms=time_end_ms, min_duration_ms=min_duration_ms).apply(entries)
    limit = max(0, min(limit, 200))
    if "idx" in entries.columns:
        first = found.orderBy("idx").limit(limit)
    else:  # only what is shown gets its place in the order
        first = keep(found.orderBy(*ORDER).limit(limit), "found")
        first = first.join(F.broadcast(places(entries, first)), [*ORDER])
    shown = first.orderBy("idx").select("idx", lt.iso_text(F.col("ts_ms")).alias("timestamp"), "severity", "component", "ns", lt.shortened(F.col("msg"), 300).alias("msg"), "conn_id", "duration_ms", "node_idx")
    counts = found.agg(F.count("*").alias("total")).withColumn("returned", F.least("total", F.lit(limit).cast("long")))
    return {"entries": shown, "counts": counts}


def entry_detail(entries: DataFrame, entry_index: int | None) -> dict[str, DataFrame]:
    """``entry``: the raw line of one entry; an index out of range is an error."""
    if entry_index is None:
        raise ValueError("entry_index is required")
    found = entries.where(F.col("idx") == entry_index).select("idx", "raw")
    if entry_index < 0 or found.limit(1).count() == 0:
        raise IndexError(f"entry_index {entry_index} is out of range")
    return {"entry": found}


def slow_queries(entries: DataFrame, limit: int = 20, min_duration_ms: int = 0) -> dict[str, DataFrame]:
    limit = max(0, min(limit, 100))
    return {
        "totals": b.slow_totals(entries, min_duration_ms),
        "shapes": b.top(b.slow_by_shape(entries, min_duration_ms), limit, label="shape"),
        "namespaces": b.top(b.slow_by_namespace(entries, min_duration_ms), limit, label="ns"),
    }


def connections(entries: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    drivers = b.breakdowns(entries, ("driver",)).select("label", "count").orderBy(F.desc("count"), "label")
    return {"drivers": drivers, "connections": b.top(b.by_connection(entries), max(0, min(limit, 100)), label="conn_id"), "totals": b.distinct_connections(entries)}


def error_details(entries: DataFrame, limit: int = 20, severity: str = "BOTH") -> dict[str, DataFrame]:
    entries = _parsed_once(entries)
    groups = b.top(b.error_groups(entries, severity), max(0, min(limit, 100)), label="msg")
    if "idx" not in entries.columns:  # only what is shown gets its place in the order
        groups = keep(groups, "groups")
        samples = groups.select("msg", F.explode("samples").alias("_o")).select("msg", "_o.*")
        found = samples.join(F.broadcast(places(entries, samples)), [*ORDER])
        found = found.groupBy("msg").agg(F.min("idx").alias("first_idx"), F.array_sort(F.collect_list("idx")).alias("samples"))
        groups = groups.drop("first_idx", "samples").join(found, "msg").orderBy(F.desc("count"), "msg")
    return {"groups": b.shorten(groups, 200), "totals": b.error_totals(entries)}


ANALYSES: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "analysis_summary": analysis_summary, "search_logs": search_logs, "entry_detail": entry_detail, "slow_queries": slow_queries, "connections": connections, "error_details": error_details,
}


def analyse(name: str, entries: DataFrame | None, **parameters) -> dict[str, DataFrame]:
    """One of ANALYSES by name; an unknown name and missing data are errors."""
    if entries is None:
        raise ValueError("no data")
    if name not in ANALYSES:
        raise KeyError(f"unknown analysis: {name}")
    return ANALYSES[name](entries, **parameters)


def as_json(answer: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: b.as_json(df) for name, df in answer.items()}
