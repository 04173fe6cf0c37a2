"""A folder of sources of several kinds, each as a table of text cells."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.sources import delimited, dialects
from linkspark.sources.dialects import Dialect
from linkspark.sources.readers import flatten

# How a file's name tells its kind; all others are tables.
JSON, XML = (".json", ".geojson"), (".xml",)
#: Files above this many bytes are taken for UTF-8 with commas or tabs unless a dialect is given: no task holds them whole.
WHOLE = 64 << 20


@dataclass(frozen=True)
class Source:
    """kind: table, json or xml. rows: its records as text cells, for xml (file, xml)."""

    kind: str
    rows: DataFrame
    dialect: Dialect | None = None


def json_records(spark: SparkSession, path: str, record_path: str | None = None) -> DataFrame:
    """The records of a JSON document as text cells: nested objects are dotted columns, arrays JSON text, null and missing
    values "", columns by name.

    A top array's elements are the records. Of a top object, the array at record_path is, or else its longest array of
    objects (equally long ones: the first by name); an object without one is a record itself. Records that are no objects
    have the column `value`. An array inside one document is one row of the scan and is parted after it.
    """
    start = spark.read.text(path).select(F.regexp_extract("value", r"\A[\s﻿]*(\S)", 1).alias("c")).where("c <> ''").head(1)
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    if start and start[0]["c"] == "[":
        if df.columns == ["_corrupt_record"]:
            whole = spark.read.text(path, wholetext=True)
            return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")).select(F.coalesce("value", F.lit("")).alias("value"))
        return flatten(df)
    arrays = {f.name: f.dataType.elementType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    chosen = record_path if record_path in arrays else None
    objects = [n for n, kind in arrays.items() if isinstance(kind, T.StructType)]
    if chosen is None and objects:
        sizes = df.select(*[F.size(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(objects)]).first()
        chosen = max(range(len(objects)), key=lambda i: (sizes[i] or 0, -i))
        chosen = objects[chosen] if (sizes[objects.index(objects[chosen])] or 0) > 0 else None
    if chosen is None:
        return flatten(df)
    rows = df.select(F.explode(F.col(f"`{chosen}`")).alias("value"))
    if isinstance(arrays[chosen], T.StructType):
        return flatten(rows.select("value.*"))
    return rows.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))


def _wide(cells: DataFrame) -> DataFrame | None:
    """Rows of one file's cells under its header's names; short rows end in "" cells."""
    head = cells.where("row = 1").first()
    if head is None:
        return None
    names = delimited.named(list(head["cells"]))
    return cells.where("row > 1").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def source_set(spark: SparkSession, folder: str, known: dict[str, Dialect] | None = None, record_path: str | None = None) -> dict[str, Source]:
    """The files right in a folder by name, each read by what its name says: .json and .geojson as records, .xml as an
    article, all else as a table in the dialect that `known` gives for its name, or that its bytes show.

    One job lists the files and one finds all dialects (a row a file; the number of files, not of rows, comes to the
    driver). Plain UTF-8 tables are read in ranges, others file by file in a task. A table without a header is left out.
    """
    known = known or {}
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(folder).select("path", "length").collect()
    paths = {unquote(r["path"].rsplit("/", 1)[1]): (r["path"], r["length"]) for r in sorted(listed)}
    tables = [n for n in paths if not n.lower().endswith((*JSON, *XML))]
    asked = [paths[n][0] for n in tables if n not in known and paths[n][1] <= WHOLE]
    found: dict[str, Dialect] = {}
    if asked:
        content = spark.read.format("binaryFile").load(asked).select(F.col("path").alias("file"), "content")
        for r in dialects.detected(content).collect():
            found[unquote(r["file"].rsplit("/", 1)[1])] = Dialect(r["encoding"], r["delimiter"], skip_rows=r["skip_rows"])
    out: dict[str, Source] = {}
    for name, (path, _) in paths.items():
        if name.lower().endswith(JSON):
            out[name] = Source("json", json_records(spark, path, record_path))
        elif name.lower().endswith(XML):
            out[name] = Source("xml", spark.read.text(path, wholetext=True).select(F.lit(name).alias("file"), F.col("value").alias("xml")))
        else:
            d = known.get(name) or found.get(name)
            plain = d is None or (d.encoding.lower() in ("utf-8", "utf8", "utf-8-sig") and len(d.delimiter) == 1 and not d.skip_rows and not d.collapse)
            if plain:
                # a comma that was not asked for is the default of a file too short to tell: its name says more
                rows = delimited.table(spark, path, d.delimiter if d and (name in known or d.delimiter != ",") else None)
                rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns]) if rows.columns else None
            else:
                content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
                rows = _wide(dialects.cells(content, d))
            if rows is not None:
                out[name] = Source("table", rows, d)
    return out


def inclusions(sources: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """(from_source, from_column, to_source, to_column, overlap, from_distinct, ratio): for every two sources and every name
    that is a column of both (or of `columns` alone), how many values they share, of how many of the earlier source.

    Values are trimmed texts; null and blank ones count for nothing, pairs that share no value give no row. Each value of
    a name becomes the set of the sources that have it, gathered on the map side, and equal sets are counted: one shuffle
    of distinct values for all pairs together, whatever the number of pairs, and a value in every row is no hot key.
    """
    names = list(sources)
    if not names:
        raise ValueError("no sources")
    times: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        for c in sources[n].columns:
            times.setdefault(c, []).append(i)
    shared = {c for c, at in times.items() if len(at) > 1 and (columns is None or c in columns)}
    spark = sources[names[0]].sparkSession
    cells = None
    for i, n in enumerate(names):
        own = [c for c in sources[n].columns if c in shared]
        if own:
            rows = sources[n].select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in own])))
            rows = rows.where("value <> ''").withColumn("source", F.lit(i))
            cells = rows if cells is None else cells.unionByName(rows)
    if cells is None:
        return spark.createDataFrame([], "from_source string, from_column string, to_source string, to_column string, overlap long, from_distinct long, ratio double")
    sets = cells.groupBy("column", "value").agg(F.sort_array(F.collect_set("source")).alias("set"))
    sets = sets.groupBy("column", "set").agg(F.count(F.lit(1)).alias("n"))  # as many rows as sets of sources occur
    pairs = F.flatten(F.transform("set", lambda a: F.transform(F.filter("set", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = sets.select("column", "n", F.inline(pairs)).groupBy("column", "a", "b").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("own", F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).over(Window.partitionBy("column", "a")))
    called = F.array(*[F.lit(n) for n in names])
    out = counts.where("a < b").select(F.get(called, "a").alias("from_source"), F.col("column").alias("from_column"), F.get(called, "b").alias("to_source"), F.col("column").alias("to_column"), F.col("n").alias("overlap"), F.col("own").alias("from_distinct"))
    return out.withColumn("ratio", F.col("overlap") / F.col("from_distinct"))
