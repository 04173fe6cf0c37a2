"""A bounded sample of labelled texts, for fitting a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int, longest: int | None = None) -> tuple[pd.DataFrame, float]:
    """At most `rows` labelled texts of each class and `chars` characters of each class, in the order of a hash of the
    id, and the share of label 1 among all labelled rows that may be learned from.

    Only ids and labels are ordered over the whole table; texts are read for the chosen ids alone. Rows without a
    label, an id or a text are left out; of a text the first `longest` characters count (a tenth of chars, so that no text
    takes the place of its class); an id that is labelled twice counts once, with its larger label. The bound on
    what reaches the driver is 2 * chars characters.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).withColumn("at", order).orderBy("at", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
    texts = texts.withColumn("text", F.substring("text", 1, chars // 10 if longest is None else longest))
    so_far = Window.partitionBy("label").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("so_far", F.sum(F.length("text")).over(so_far)).where(F.col("so_far") <= chars)
    share = known.agg(F.avg("label")).first()[0]
    frame = texts.select("label", "text", "at", "doc_id").toPandas().sort_values(["label", "at", "doc_id"], ignore_index=True)
    return frame[["label", "text"]], 0.0 if share is None else float(share)
