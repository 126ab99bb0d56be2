"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import keep

#: Bytes of text of a whole sample.
SAMPLE_BYTES = 32_000_000


def labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str, rows: int, size: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text): at most ``rows`` labelled rows for which ``may_learn`` holds, of at most ``size`` bytes of text together.

    Rows come in the order of a hash of their id, so that the sample does not depend on
    how the tables are laid out.  Texts are whole: one that does not fit into what is
    left of ``size`` is passed over.  A null text is empty, the largest label of an id
    and the largest text of rows with one id count; null ids and labels are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & may_learn)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))  # at most `rows` ids
    found = keep(found.withColumn("turn", F.xxhash64("id")), "sample")
    left, out = size, []
    for r in found.select("turn", "id", F.octet_length("text").alias("n")).orderBy("turn", "id").collect():  # at most `rows` rows
        if r.n <= left:
            left -= r.n
        else:
            out.append((r.id,))
    found = found.drop("turn")
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(out, "id long")), "id", "left_anti") if out else found
