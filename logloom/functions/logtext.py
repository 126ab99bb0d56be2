"""Column functions over log fields, file names and metric paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "?")
LETTERS = "FEWID"
#: Command names that are reported under another name.
ALIASES = {"findandmodify": "findAndModify", "isMaster": "hello", "ismaster": "hello"}
#: Suffixes of disk metrics, whatever the device.
DISK_SUFFIXES = ("reads", "writes", "read_time_ms", "write_time_ms", "io_queued_ms", "io_time_ms", "sectors_read", "sectors_written")
DISK_PATTERN = rf"^systemMetrics\.disks\..+\.({'|'.join(DISK_SUFFIXES)})$"


def epoch_ms(text: Column, honour_offset: bool = False) -> Column:
    """Milliseconds since 1970 of an ISO-8601 text, -1 if it can't be read.

    The offset is ignored and the time taken as UTC, unless ``honour_offset``.
    """
    naive = F.unix_millis(F.try_to_timestamp(F.concat(F.substring(text, 1, 23), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    if honour_offset:
        offset = F.regexp_extract(text, r"^.{23}([+-]\d{2}):?(\d{2})$", 1)
        minutes = F.regexp_extract(text, r"^.{23}([+-]\d{2}):?(\d{2})$", 2)
        shift = offset.try_cast("int") * 60 + F.when(offset.startswith("-"), -minutes.try_cast("int")).otherwise(minutes.try_cast("int"))
        naive = naive - F.coalesce(shift, F.lit(0)) * 60_000
    return F.coalesce(F.when(F.length(text) >= 23, naive), F.lit(-1)).cast("long")


def iso_text(ms: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ, for a session in UTC; null for negative times."""
    return F.when(ms >= 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def severity_rank(letter: Column) -> Column:
    """0 (fatal) to 4 (debug) by the first letter, 5 for anything else."""
    at = F.instr(F.lit(LETTERS), F.substring(F.coalesce(letter, F.lit("")), 1, 1))
    return F.when((F.length(F.coalesce(letter, F.lit(""))) > 0) & (at > 0), at - 1).otherwise(5).cast("int")


def severity_label(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def rank_of_label(label: str) -> int:
    """The rank that a label's first letter names, in any case."""
    at = LETTERS.find(label[:1].upper()) if label else -1
    return at if at >= 0 else 5


def connection_id(ctx: Column) -> Column:
    """The number right after the first ``conn``, modulo 2**32; 0 without one."""
    digits = F.regexp_extract(F.coalesce(ctx, F.lit("")), r"^(?s:(?:(?!conn).)*)conn(\d*)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("decimal(38,0)") % F.lit(4294967296).cast("decimal(38,0)"), F.lit(0)).cast("long")


def op_type(command: Column) -> Column:
    """The first key of a command object that is neither empty nor starts with ``$``, by its usual name."""
    keys = F.filter(F.json_object_keys(command), lambda k: (k != "") & ~k.startswith("$"))
    name = F.get(keys, F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def driver_label(name: Column, version: Column) -> Column:
    """``name version``, or the name alone; null without a name."""
    name = F.nullif(name, F.lit(""))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, F.nullif(version, F.lit(""))))


def is_slow(msg: Column) -> Column:
    return F.coalesce(msg.rlike("^[Ss]low"), F.lit(False))


def shortened(msg: Column, most: int) -> Column:
    return F.when(F.length(msg) > most, F.concat(F.substring(msg, 1, most), F.lit("..."))).otherwise(msg)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name before its last dot."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def without_rotation(name: Column) -> Column:
    """A file name without a rotation suffix: 19 characters or more after the last dot, shaped like a date and time."""
    return F.regexp_replace(name, r"\.[^.]{4}-[^.]{2}-[^.]{2}T[^.]{8,}$", "")


def file_group(path: Column) -> Column:
    """struct(directory, base name without its rotation suffix)."""
    return F.struct(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("directory"), without_rotation(base_name(path)).alias("base"))


def host_and_port(host: Column) -> Column:
    """struct(hostname, port); the port only if the part after the last colon is all digits, else 0."""
    port = F.nullif(F.regexp_extract(host, r"^(.*):([0-9]+)$", 2), F.lit("")).try_cast("int")
    return F.struct(F.when(port.isNotNull(), F.regexp_extract(host, r"^(.*):([0-9]+)$", 1)).otherwise(host).alias("hostname"), F.coalesce(port, F.lit(0)).alias("port"))


def is_capture_path(path: Column) -> Column:
    """Whether a path is a metric capture: ``diagnostic.data`` in it, or a file name starting with ``metrics``."""
    return F.contains(path, F.lit("diagnostic.data")) | base_name(path).startswith("metrics")


def is_disk_metric(path: Column) -> Column:
    return path.rlike(DISK_PATTERN)


def short_metric_name(path: Column) -> Column:
    """The last two dotted parts of a path."""
    return F.substring_index(path, ".", -2)


def threshold_band(value: Column, threshold: Column) -> Column:
    """none, green (below 75 %), yellow (to 100 %) or red of a threshold; of 0, red above 0."""
    share = value / F.nullif(threshold, F.lit(0.0))
    zero = F.when(value > 0, "red").otherwise("green")
    return F.when(threshold.isNull(), "none").when(threshold == 0, zero).when(share > 1, "red").when(share >= 0.75, "yellow").otherwise("green")


def annotation_class(rank: Column) -> Column:
    """err for fatal and error, warn for warnings, null for the rest."""
    return F.when(rank <= 1, "err").when(rank == 2, "warn")
