"""Log lines and metric samples derived from an ``events`` table."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .captures import CHUNKS, DATA
from .logs import parse_log_lines, with_index

OPCOUNTERS = {"click": "query", "error": "delete", "purchase": "insert", "signup": "update", "view": "command"}
#: First usable key of an event's command.
COMMANDS = {"click": "find", "error": "isMaster", "purchase": "insert", "signup": "findandmodify", "view": "aggregate"}
TEMPLATES = ('{"a":1}', '{"user":{"$gt":5},"b":"x"}', '{"_id":{"$oid":"0"}}', '{"tags":[1,"y"]}')


def log_lines(events: DataFrame) -> DataFrame:
    """(file_path, file_idx, node_idx, line_no, raw): one JSON log line for each event."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    severity = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").when(F.col("event_type") == "signup", "D").otherwise("I")
    absent = lambda every: F.col("event_id") % every == 0
    commands = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    query = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("event_id") % 4).cast("int"))
    attr = F.concat_ws(
        ",",
        F.when(~absent(5), F.concat(F.lit('"ns":"shop.'), "event_type", F.lit('"'))),
        F.when(~absent(3), F.concat(F.lit('"durationMillis":'), F.floor("value").cast("string"))),
        F.concat(F.lit('"command":{"$db":"shop","'), F.element_at(commands, F.col("event_type")), F.lit('":"'), "event_type", F.lit('","filter":'), query, F.lit("}")),
        F.concat(F.lit('"client":{"driver":{"name":"drv'), (F.col("user_id") % 3).cast("string"), F.lit('","version":"'), (F.col("user_id") % 2).cast("string"), F.lit('.0"}}')),
    )
    raw = F.concat(
        F.lit('{"t":{"$date":"'), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('+00:00"},"s":"'), severity, F.lit('","c":"'), F.upper("event_type"),
        F.lit('","id":51803,"ctx":"'), F.when(absent(7), "main").otherwise(F.concat(F.lit("conn"), F.col("user_id").cast("string"))), F.lit('","msg":"'),
        F.when(F.col("value") >= 100, "Slow query").otherwise(F.concat("event_type", F.lit(" handled"))), F.lit('","attr":{'), attr, F.lit("}}"),
    )
    file = (F.col("user_id") % 3).cast("int")
    return events.select(F.concat(F.lit("/logs/node"), file.cast("string"), F.lit("/mongod.log")).alias("file_path"), file.alias("file_idx"), file.alias("node_idx"), F.col("event_id").cast("long").alias("line_no"), raw.alias("raw"))


def entries(events: DataFrame, indexed: bool = False) -> DataFrame:
    """Entries parsed from the derived lines, with idx if ``indexed``."""
    made = parse_log_lines(log_lines(events)).withColumn("node_set", F.array("node_idx"))
    return with_index(made) if indexed else made


def metric_samples(events: DataFrame) -> DataFrame:
    """(path, path_ord, ts_ms, seq, value): a running count for each event type, and connections from values."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    names = F.create_map(*[F.lit(x) for kv in OPCOUNTERS.items() for x in kv])
    order = F.create_map(*[F.lit(x) for k, i in zip(OPCOUNTERS, range(len(OPCOUNTERS)), strict=True) for x in (k, i)])
    counted = events.select(
        F.concat(F.lit("serverStatus.opcounters."), F.element_at(names, F.col("event_type"))).alias("path"), F.element_at(order, F.col("event_type")).alias("path_ord"),
        ms.alias("ts_ms"), F.col("event_id").alias("seq"), (F.col("event_id") + F.floor("value")).cast("double").alias("value"),
    )
    gauge = events.select(F.lit("serverStatus.connections.current").alias("path"), F.lit(len(OPCOUNTERS)).alias("path_ord"), ms.alias("ts_ms"), F.col("event_id").alias("seq"), (F.col("value") * 20).alias("value"))
    disk = events.where("event_id % 2 = 0").select(F.concat(F.lit("systemMetrics.disks.dev"), (F.col("user_id") % 2).cast("string"), F.lit(".io_queued_ms")).alias("path"), F.lit(len(OPCOUNTERS) + 1).alias("path_ord"), ms.alias("ts_ms"), F.col("event_id").alias("seq"), F.floor("value").cast("double").alias("value"))
    return counted.union(gauge).union(disk)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode_chunk(columns: dict[str, list[int]]) -> bytes:
    """The compressed block of a capture chunk: whole numbers by name, as many of each."""
    fields = b"".join(bytes([0x09 if name == "start" else 0x12]) + name.encode() + b"\0" + struct.pack("<q", values[0]) for name, values in columns.items())
    count = len(columns["start"]) - 1
    body = b""
    for values in columns.values():
        steps = [b - a for a, b in zip(values, values[1:], strict=False)]
        zeros = next((i for i, d in enumerate(steps) if d), count)
        body += _varint(zeros) + b"".join(_varint((d << 1) ^ (d >> 63)) for d in steps[zeros:])
    block = struct.pack("<i", len(fields) + 5) + fields + b"\0" + struct.pack("<ii", len(columns), count) + body
    return struct.pack("<i", len(block)) + zlib.compress(block)


def capture_chunks(events: DataFrame, size: int = 300) -> DataFrame:
    """Chunk rows of captures, one source for each event type: value and user of each event at its time."""
    ship(events.sparkSession)
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "event_id"])
        whole = {"start": pdf["ts_ms"].tolist(), "value": pdf["value"].tolist(), "user": pdf["user_id"].tolist()}
        return pd.DataFrame([(pdf["source"].iloc[0], int(pdf["chunk_no"].iloc[0]), DATA, whole["start"][0], encode_chunk(whole), None)], columns=names)

    rows = events.select(
        F.col("event_type").alias("source"), F.floor(F.col("event_id") / size).cast("int").alias("chunk_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", F.floor("value").alias("value"), F.col("user_id").cast("long")
    )
    return rows.groupBy("source", "chunk_no").applyInPandas(run, CHUNKS)
