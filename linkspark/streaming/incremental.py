"""Incremental intake: files that arrive in a folder, each batch applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.sources.readers import write_new


def append_files(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, key: list[str]) -> None:
    """Take every new Parquet file of a folder into target, as a set by key. The stream's checkpoint remembers files; a
    batch that is replayed adds nothing."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, _: write_new(df, target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows: the same content has the same digest."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).cast("string").alias("digest"))


def batch_sizes(df: DataFrame, batch: str) -> DataFrame:
    """(batch, rows) of an intake."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"))


def ledger(lines: DataFrame, schema: str, since: str | None = None, until: str | None = None, at: str = "ts") -> DataFrame:
    """Events of JSON lines (value), by time; lines that do not parse or have no time are passed over. since and until are
    compared as ISO text, both included."""
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where(F.col(at).isNotNull())
    if since is not None:
        rows = rows.where(F.col(at) >= since)
    if until is not None:
        rows = rows.where(F.col(at) <= until)
    return rows.orderBy(at)


def quarantined(rows: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and those set aside with the time of their batch; a null condition fails."""
    ok = F.coalesce(good, F.lit(False))
    return rows.where(ok), rows.where(~ok).withColumn("quarantined_at", F.current_timestamp())


def drop_dir(spark: SparkSession, root: str, schema: str, each, checkpoint: str, suffix: str = "parquet", kind: str = "parquet") -> None:
    """Hand every new file below a folder to each(rows, batch_id), with the column dataset, the first folder below root (null
    for files in root itself). Only files of the suffix; parts of the path that start with a dot or underscore are hidden.
    Writers rename whole files into place. The checkpoint remembers files, so each() has to bear a batch sent again."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").format(kind).load(root)
    below = F.split_part(F.col("_metadata.file_path"), F.lit("/" + root.strip("/") + "/"), F.lit(2))
    rows = stream.withColumn("__below", below).where(~F.col("__below").rlike(r"(^|/)[._]"))
    rows = rows.withColumn("dataset", F.when(F.col("__below").contains("/"), F.substring_index("__below", "/", 1))).drop("__below")
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rechecked(target: str, findings: str, key: list[str], check):
    """A batch's function for drop_dir(): append its quads to target as a set, then write check(all quads, classes of the
    batch) as this batch's findings. A batch sent again writes the same folder over."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_new(batch, target, key)
        classes = batch.where("p = 'rdf:type'").select(F.col("o").alias("class")).distinct()
        check(batch.sparkSession.read.parquet(target), classes).write.mode("overwrite").parquet(f"{findings}/batch={batch_id}")

    return each


def refreshed(target: str, hubs: str, key: list[str], build):
    """A batch's function: append its rows to target as a set and build the hub anew from all of them, once a batch however
    many files it holds. Each build has its own folder; readers take the one of the greatest number."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_new(batch, target, key)
        build(batch.sparkSession.read.parquet(target)).write.mode("overwrite").parquet(f"{hubs}/build={batch_id}")

    return each
