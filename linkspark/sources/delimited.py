"""Delimited files cut into records in parallel, quoted line feeds included."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sign(sep: str) -> str:
    """A separator as part of a pattern."""
    return re.escape(sep) if sep != "\t" else r"\t"


def _ends_quoted(line: Column, s: str) -> Column:
    """Whether a line that begins outside of a quoted cell ends inside of one."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    closed = rf'(?:{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s}'
    return line.rlike(rf"\A(?:{closed})*+{quoted}\z")


def _goes_on_quoted(line: Column, s: str) -> Column:
    """Whether a line that begins inside of a quoted cell ends inside of one."""
    inner = r'\A[^"]*+(?:""[^"]*+)*+'
    rest = F.regexp_replace(line, rf'{inner}"[^{s}]*+', "")
    return F.when(~line.rlike(f'{inner}"'), True).when(rest == "", False).otherwise(_ends_quoted(F.substring(rest, F.lit(2), F.length(rest)), s))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, line): lines of files, a task a range of a file; place orders the lines of a block."""
    rows = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    line = F.regexp_replace(F.regexp_replace("value", r"\r\z", ""), r"\A﻿", "")
    return rows.select("file", "block", F.monotonically_increasing_id().alias("place"), line.alias("line"))


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, block, place, record): the records of delimited files as text, in order of file, block and place; line feeds
    stay in cells that are quoted.

    A line says what it makes of either state before it, inside or outside of a quoted cell: it keeps it, turns it, or sets
    it. Such steps combine, so each range of a file is summed up for itself, a scan over the ranges' sums (a row a range)
    gives the state that each begins with, and all lines know theirs. Lines that are records alone stay as they are;
    the others are gathered by the line that their record began with. Files without quoted line feeds, which a first scan
    tells, are not shuffled at all. A quote that is never closed makes the rest of its file one record.
    """
    s = _sign(sep)
    lines = _lines(spark, path)
    if not lines.where(_ends_quoted(F.col("line"), s)).head(1):
        return lines.select("file", "block", "place", F.col("line").alias("record"))
    after_out, after_in = _ends_quoted(F.col("line"), s), _goes_on_quoted(F.col("line"), s)
    # a step that sets the state is its value; one that turns it counts as one turn
    lines = lines.withColumn("fixed", F.when(after_out == after_in, after_out)).withColumn("turn", (after_out & ~after_in).cast("int"))
    own = Window.partitionBy("file", "block").orderBy("place")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("turns", F.sum("turn").over(so_far))
    set_by = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    lines = lines.withColumn("set_by", F.last(set_by, ignorenulls=True).over(before)).withColumn("had", F.coalesce(F.lag("turns").over(own), F.lit(0)))

    def state(first: Column, last: Column, turns: Column) -> Column:
        begun = F.when(last.isNotNull(), last["fixed"]).otherwise(first)
        return begun != ((turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)

    blocks = lines.groupBy("file", "block").agg(F.max_by(F.struct("set_by", "fixed", "turn", "turns", "had"), "place").alias("z"))
    # what a block makes of either state: the same two answers as for a line
    ends = lambda first: F.when(F.col("z.fixed").isNotNull(), F.col("z.fixed")).otherwise(state(first, F.col("z.set_by"), F.col("z.turns")))
    blocks = blocks.select("file", "block", ends(F.lit(False)).alias("out"), ends(F.lit(True)).alias("in"))
    blocks = blocks.withColumn("fixed", F.when(F.col("out") == F.col("in"), F.col("out"))).withColumn("turn", (F.col("out") & ~F.col("in")).cast("int"))
    by_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("turns", F.sum("turn").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("earlier", earlier).withColumn("had", F.coalesce(F.lag("turns").over(by_file), F.lit(0)))
    begins = state(F.lit(False), F.col("earlier"), F.col("had"))
    lines = lines.join(blocks.select("file", "block", begins.alias("first")), ["file", "block"])
    inside = state(F.col("first"), F.col("set_by"), F.col("had"))
    lines = lines.withColumn("inside", inside).withColumn("left", F.when(F.col("inside"), after_in).otherwise(after_out))
    alone = lines.where(~F.col("inside") & ~F.col("left")).select("file", "block", "place", F.col("line").alias("record"))
    # the others know the last line that began a record: of their block, or else of an earlier one
    parts = lines.where(F.col("inside") | F.col("left")).select("file", "block", "place", "line", F.when(~F.col("inside"), F.struct("block", "place")).alias("begun"))
    parts = parts.withColumn("begun", F.last("begun", ignorenulls=True).over(so_far))
    lasts = parts.groupBy("file", "block").agg(F.max("begun").alias("last"))
    lasts = lasts.select("file", "block", F.last("last", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    parts = parts.join(lasts, ["file", "block"]).withColumn("begun", F.coalesce("begun", "carried"))
    whole = parts.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("block", "place", "line"))).alias("all"))
    whole = whole.select("file", "begun.block", "begun.place", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("record"))
    return alone.unionByName(whole)


def table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file, or a folder of such files with the same header: all cells text, a missing cell "".

    sep: tab for names that end in .tsv or .tab, else comma. A byte order mark is dropped, doubled quotes are one, quoted
    line feeds stay in their cell (as one line feed each); cells beyond the header are dropped, blank lines passed over. A
    large file is read in many tasks. Names that the header repeats get _2, _3. A file without a line gives no columns.
    """
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    rows = records(spark, path, sep).where(F.trim("record") != "")
    # the first record of a file begins with its first line that isn't blank, and is that line unless a quote goes on
    begun = _lines(spark, path).where(F.trim("line") != "").groupBy("file").agg(F.min(F.struct("block", "place", "line")).alias("h"))
    first = begun.select("file", "h.block", "h.place", F.col("h.line").alias("record"), _ends_quoted(F.col("h.line"), _sign(sep)).alias("on"))
    header = first.agg(F.min_by("record", "file").alias("record"), F.bool_or("on").alias("on")).first()
    if header["record"] is None:
        return spark.createDataFrame([], T.StructType([]))
    if header["on"]:
        first = rows.groupBy("file").agg(F.min(F.struct("block", "place", "record")).alias("h")).select("file", "h.*")
        header = first.orderBy("file").select("record").first()
    names = _names(header["record"], sep)
    options = {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    body = rows.join(first.select("file", F.col("block").alias("hb"), F.col("place").alias("hp")), "file").where("block <> hb or place <> hp")
    cells = body.select(F.from_csv("record", schema, options).alias("r"))
    return cells.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def _names(header: str, sep: str) -> list[str]:
    import csv
    import io

    return named(next(csv.reader(io.StringIO(header, newline=""), delimiter=sep)))


def named(cells: list[str]) -> list[str]:
    """Names of a header's cells; an empty one is _cN, a repeated one gets _2, _3."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = cell or f"_c{i}"
        k = 1
        while (name if k == 1 else f"{name}_{k}") in out:
            k += 1
        out.append(name if k == 1 else f"{name}_{k}")
    return out
