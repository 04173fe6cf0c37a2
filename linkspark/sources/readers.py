"""Sources and sinks as Spark readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame) -> DataFrame:
    """Text cells: nested objects as dotted columns, arrays and maps as JSON, null as "" """

    def walk(schema: T.StructType, at: str):
        for f in schema.fields:
            name = f"{at}.{f.name}" if at else f.name
            path = ".".join(f"`{p}`" for p in name.split("."))
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, name)
            elif isinstance(f.dataType, T.ArrayType | T.MapType):
                yield F.coalesce(F.to_json(F.col(path)), F.lit("")).alias(name)
            else:
                yield F.coalesce(F.col(path).cast("string"), F.lit("")).alias(name)

    return df.select(*walk(df.schema, ""))


_NODE = r"<([^<>\x22{}|^`\x00-\x20]*)>|(_:[\p{L}\p{N}_][\p{L}\p{N}_.:\u00B7-]*)"
_LINE = rf'^\s*(?:{_NODE})\s*<([^<>]*)>\s*(?:{_NODE}|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>]*)>)?)\s*\.\s*(?:#.*)?$'


def _unescaped(c):
    """A literal or IRI with its escapes undone, a doubled backslash first set aside."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"), F.lit(0)))
    point = lambda r: F.conv(F.substring(r, F.lit(3), F.length(r)), 16, 10).cast("long")
    sound = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    spelled = lambda r: F.decode(F.unhex(F.lpad(F.hex(F.when(sound(point(r)), point(r)).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    out = F.when(F.size(numbers) > 0, F.aggregate(numbers, out, lambda done, r: F.replace(done, r, spelled(r)))).otherwise(out)
    for a, b in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def ntriples_of(lines: DataFrame) -> DataFrame:
    """Quads without a graph of lines (value) of N-Triples. Subjects and objects may be blank nodes, named _: and their
    label (kind blank as objects); a comment may follow a triple. Blank lines and comments are passed over; lines that do
    not parse are in error_lines()."""
    get = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.where(F.col("value").rlike(_LINE))
    subject = F.when(get(2) != "", get(2)).otherwise(_unescaped(get(1)))
    literal = F.col("value").rlike(rf"^\s*(?:{_NODE})\s*<[^<>]*>\s*\x22")
    kind = F.when(literal, "literal").when(get(5) != "", "blank").otherwise("iri")
    o = F.when(literal, _unescaped(get(6))).when(get(5) != "", get(5)).otherwise(_unescaped(get(4)))
    return rows.select(subject.alias("s"), _unescaped(get(3)).alias("p"), o.alias("o"), kind.alias("kind"), _unescaped(get(8)).alias("dt"), get(7).alias("lang"))


def error_lines(lines: DataFrame) -> DataFrame:
    """Lines that ntriples_of() leaves out, with the reason, for an error table beside the good rows."""
    bad = lines.where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))
    return bad.select("value", F.lit("not an N-Triples line").alias("error"))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """ntriples_of() the lines of files."""
    return ntriples_of(spark.read.text(path))


def ingest_stats(rows: DataFrame, good, triples: int = 1) -> DataFrame:
    """(rows_in, rows_ok, rows_err, triples_out, status) of a run. good: condition that a row is mapped; triples: how
    many a good row gives. status is ok, partial or error. Null conditions count as errors."""
    out = rows.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.coalesce(good, F.lit(False))).alias("rows_ok"))
    err = F.col("rows_in") - F.col("rows_ok")
    status = F.when(err == 0, "ok").when(F.col("rows_ok") > 0, "partial").otherwise("error")
    return out.select("rows_in", "rows_ok", err.alias("rows_err"), (F.col("rows_ok") * triples).alias("triples_out"), status.alias("status"))


def observed_write(rows: DataFrame, good, write) -> dict:
    """What a run did: rows_in, rows_ok, rows_err, status, started and ended (UTC). write(good rows) has to write them;
    rows are counted as they pass, so the source is read once. Null conditions count as errors; a run without any row is
    ok. Counts are those of the writing job, which repeats no row of tasks that were lost."""
    from datetime import UTC, datetime

    started, seen = datetime.now(UTC), Observation()
    passed = F.coalesce(good, F.lit(False))
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(passed).alias("rows_ok")).where(passed))
    n, ok = seen.get["rows_in"], seen.get["rows_ok"]
    status = "ok" if n == ok else "partial" if ok else "error"
    return {"rows_in": n, "rows_ok": ok, "rows_err": n - ok, "status": status, "started": started, "ended": datetime.now(UTC)}


def error_rows(rows: DataFrame, order: str, good, reason: str) -> DataFrame:
    """Rows that fail, with the column `order` that tells where they stand, their error and themselves as JSON."""
    bad = rows.where(~F.coalesce(good, F.lit(False)))
    return bad.select(F.col(order).alias("row"), F.lit(reason).alias("error"), F.to_json(F.struct(*rows.columns)).alias("record"))


def write_new(new: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows of new that the table at path does not hold: a set, so a batch sent again adds nothing."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(key)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.parquet(path).select(*key).alias("h")
        same = reduce(lambda a, b: a & b, [F.col(f"f.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in key])  # a null key part is a value
        fresh = fresh.alias("f").join(held, same, "left_anti")
    fresh.write.mode("append").parquet(path)


def write_graph(q: DataFrame, path: str, rows: int = 50_000) -> None:
    """Append quads, a folder a graph, in files of at most `rows` quads: a lost writer loses one such file's work."""
    q.write.mode("append").partitionBy("g").option("maxRecordsPerFile", rows).parquet(path)


def accumulate(batch: DataFrame, path: str, batch_id: str) -> None:
    """Grow a stored source by a batch: a folder a batch, written over if the batch is sent again, so it counts once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
