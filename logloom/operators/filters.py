"""Predicates over log entries, and an indexed text search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logtext as lt


def text_contains(column: str, query: str) -> Column:
    """Substring in any case; an empty or null value never matches."""
    value = F.col(column)
    return F.coalesce((value != "") & F.contains(F.lower(value), F.lit(query.lower())), F.lit(False))


@dataclass(frozen=True)
class EntryFilter:
    """Fields that are set must all hold; of ``drivers`` and ``driver`` one is enough."""

    severity: str | None = None
    components: Sequence[str] = ()
    op_type: str | None = None
    ns: str | None = None
    shape: str | None = None
    slow_only: bool = False
    conn_ids: Sequence[int] = ()
    drivers: Sequence[str] = ()
    driver: str | None = None
    min_duration_ms: int | None = None
    nodes: Sequence[int] = ()
    stacked_nodes: bool = False
    time_start_ms: int | None = None
    time_end_ms: int | None = None
    text: str | None = None

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) not in (None, (), [], False) for f in fields(self))

    def predicates(self) -> list[Column]:
        c = F.col
        out: list[Column] = []
        if self.severity is not None:
            out.append(c("severity_rank") == lt.rank_of_label(self.severity))
        if self.components:
            out.append(c("component").isin(list(self.components)))
        out += [c(name) == getattr(self, name) for name in ("op_type", "ns", "shape") if getattr(self, name) is not None]
        if self.slow_only:
            out.append(lt.is_slow(c("msg")))
        if self.conn_ids:
            out.append(c("conn_id").isin(list(self.conn_ids)))
        either = ([c("driver").isin(list(self.drivers))] if self.drivers else []) + ([c("driver") == self.driver] if self.driver else [])
        if either:
            out.append(reduce(lambda a, b: a | b, either))
        if self.min_duration_ms is not None:
            out.append(c("duration_ms") >= self.min_duration_ms)
        if self.nodes:
            own = c("node_idx").isin(list(self.nodes))
            out.append(F.arrays_overlap("node_set", F.array(*[F.lit(n) for n in self.nodes])) if self.stacked_nodes else own)
        if self.time_start_ms is not None:
            out.append(c("ts_ms") >= self.time_start_ms)
        if self.time_end_ms is not None:
            out.append(c("ts_ms") <= self.time_end_ms)
        if self.text:
            out.append(text_contains("msg", self.text))
        return out

    def apply(self, entries: DataFrame) -> DataFrame:
        found = self.predicates()
        return entries.where(reduce(and_, found)) if found else entries


def error_selection(which: str) -> Column:
    """ERROR, WARN or BOTH; fatal is in none, any other word selects nothing."""
    names = {"ERROR": ["ERROR"], "WARN": ["WARN"], "BOTH": ["ERROR", "WARN"]}.get(which.upper(), [])
    return F.col("severity").isin(names) if names else F.lit(False)


def annotations(entries: DataFrame) -> DataFrame:
    """Fatal, error and warning entries with their annotation class."""
    return entries.where(F.col("severity_rank") <= 2).withColumn("annotation", lt.annotation_class(F.col("severity_rank")))


def connection_matches(query: str) -> Column:
    return F.contains(F.lower(F.concat(F.lit("conn"), F.col("conn_id").cast("string"))), F.lit(query.lower()))


def label_matches(column: str, query: str) -> Column:
    return F.contains(F.lower(column), F.lit(query.lower()))


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def trigram_index(entries: DataFrame, column: str = "msg") -> DataFrame:
    """(column, trigram): postings over the distinct values, for many searches."""
    values = entries.select(column).where(F.length(column) >= 3).distinct()
    return values.select(column, F.explode(_trigrams(F.col(column))).alias("trigram"))


def indexed_search(entries: DataFrame, index: DataFrame, query: str, column: str = "msg") -> DataFrame:
    """Entries whose ``column`` contains ``query`` in any case; shorter queries than three characters scan."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return entries.where(text_contains(column, query))
    hits = index.where(F.col("trigram").isin(grams)).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return entries.join(hits.where(text_contains(column, query)).select(column), column, "left_semi")
