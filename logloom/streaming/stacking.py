"""Stacking of equal entries in a stream, with the entries of open islands as its only state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.nodes import ALT, KEY
from ..session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An entry that waits: undecided, or a leader whose window is open.
_WAITING = "ts_ms long, file_idx int, line_no long, node_idx int, nodes string, alts string, entry string, leads boolean"
_MADE = "entry string, nodes string, alts string"


def settle(waiting: list[dict], until: int, window_ms: int) -> tuple[list[dict], list[dict]]:
    """(leaders whose window has closed, what still waits) when all entries up to ``until`` are there.

    In order of time, file and line, an entry goes to the first leader of another file
    at most ``window_ms`` before it, and leads itself if there is none.
    """
    leaders, later = [r for r in waiting if r["leads"]], [r for r in waiting if not r["leads"] and r["ts_ms"] > until]
    leaders.sort(key=lambda r: (r["ts_ms"], r["file_idx"], r["line_no"]))
    done: list[dict] = []
    for r in sorted((r for r in waiting if not r["leads"] and r["ts_ms"] <= until), key=lambda r: (r["ts_ms"], r["file_idx"], r["line_no"])):
        while leaders and r["ts_ms"] - leaders[0]["ts_ms"] > window_ms:
            done.append(leaders.pop(0))
        to = next((x for x in leaders if x["file_idx"] != r["file_idx"]), None)
        if to is None:
            leaders.append(r | {"leads": True})
        else:
            to["nodes"] = json.dumps(sorted({*json.loads(to["nodes"]), *json.loads(r["nodes"])}))
            alt = {"node_idx": r["node_idx"], "file_idx": r["file_idx"], "line_no": r["line_no"], "raw": json.loads(r["entry"]).get("raw")}
            to["alts"] = json.dumps([*json.loads(to["alts"] or "[]"), alt])
    while leaders and leaders[0]["ts_ms"] + window_ms <= until:
        done.append(leaders.pop(0))
    return done, leaders + later


class Stacker(StatefulProcessor):
    """One key's entries, kept until the watermark has passed the window of their leader."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["ts_ms"], r["file_idx"], r["line_no"], r["node_idx"], r["nodes"], None, r["entry"], False) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new) + self.window_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        names = ("ts_ms", "file_idx", "line_no", "node_idx", "nodes", "alts", "entry", "leads")
        until = timerValues.getCurrentWatermarkInMs()
        done, left = settle([dict(zip(names, r, strict=True)) for r in self.waiting.get()], until, self.window_ms)
        if left:
            self.waiting.put([tuple(r[c] for c in names) for r in left])
            # an undecided entry is looked at again when its own window has passed, like a leader
            self.handle.registerTimer(max(until + 1, min(r["ts_ms"] for r in left) + self.window_ms))
        else:
            self.waiting.clear()
        return iter([Row(entry=r["entry"], nodes=r["nodes"], alts=r["alts"]) for r in done])

    def close(self) -> None:
        pass


def stack_stream(entries: DataFrame, window_ms: int = 1, delay: str = "10 minutes") -> DataFrame:
    """What ``stacked`` makes of a stream of entries, each island once the watermark has passed it.

    State is keyed by message, severity, component and namespace and holds entries of
    islands that the watermark, ``delay`` behind the latest time, has not passed; a
    timer in event time settles and drops them, so that no batch reads old entries.
    Entries more than ``delay`` late are dropped by Spark, and the last islands
    come out when a later entry moves the watermark on.  Entries without a readable
    time pass through as they are (new files are read for both kinds).
    """
    spark = ship(entries.sparkSession)
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKS)  # the only one that keeps lists and timers
    base = entries.drop("alts").withColumn("alts", F.lit(None).cast(ALT))
    plain = [f for f in base.schema.fields if f.name not in ("node_set", "alts")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    timed = base.where("ts_ms >= 0").withColumn("_time", F.timestamp_millis("ts_ms")).withWatermark("_time", delay)
    packed = timed.select(*KEY, "_time", "ts_ms", "file_idx", "line_no", "node_idx", F.to_json("node_set").alias("nodes"), F.to_json(F.struct(*[f.name for f in plain])).alias("entry"))
    made = packed.groupBy(*KEY).transformWithState(statefulProcessor=Stacker(window_ms), outputStructType=_MADE, outputMode="Append", timeMode="EventTime")
    found = made.select(F.from_json("entry", schema).alias("e"), F.from_json("nodes", "array<int>").alias("node_set"), F.from_json("alts", ALT).alias("alts"))
    return found.select("e.*", "node_set", "alts").select(*base.columns).unionByName(base.where("ts_ms < 0"))
