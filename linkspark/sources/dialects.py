"""Text files of old instruments: their encoding and signs told apart, lines above the header, cells."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WHITESPACE = "whitespace"
# Encodings in the order of trial, single signs in order of preference, how much of a file is looked at, how
# many rows of one width make a table, and from how many columns on.
ENCODINGS = ("utf-8-sig", "cp932")
SIGNS = (",", "\t", ";", "|")
SAMPLE_BYTES, SAMPLE_LINES, LEAST_RUN, LEAST_COLUMNS = 1 << 20, 200, 5, 2
# Lines of heads, files and bytes that a task has at most, about.
LINES, FILES, BYTES = 250_000, 10_000, 1 << 26


@dataclass(frozen=True)
class Dialect:
    """How to read a file. preamble: drop, lines, keyvalue or keyvalue_cells."""

    encoding: str = "utf-8"
    delimiter: str = ","
    collapse: bool = False
    skip_rows: int = 0
    preamble: str = "drop"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, content) of the files under a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), "content")


def decoded(content: Column, encoding: str) -> Column:
    """Text of bytes, strictly: bytes that the encoding does not have are an error. Null stays null."""
    if encoding.lower() in ("utf-8", "utf8"):
        return F.decode(content, "utf-8")

    @pandas_udf(T.StringType())
    def of(values):
        return values.map(lambda b: bytes(b).decode(encoding), na_action="ignore")

    return of(content)


def _parts(content: DataFrame, *most: int) -> int:
    """As many parts as the session has cores, or as the largest of these needs."""
    return max(content.sparkSession.sparkContext.defaultParallelism, *most)


def _heads(content: DataFrame, dialect: Dialect) -> int:
    """Parts of files with at most LINES lines of heads each; files are counted first, their content isn't read."""
    return _parts(content, -(-content.select("file").count() * max(dialect.skip_rows, 1) // LINES))


def _lines(c: Column) -> Column:
    return F.split(c, "\r\n|\r|\n")


def _records(delimiter: str):
    """Cells of the records of a text; a quoted line feed stays in its cell."""

    @pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def of(values):
        import csv
        import io

        return values.map(lambda v: [[c.strip() for c in row] for row in csv.reader(io.StringIO(v, newline=""), delimiter=delimiter)], na_action="ignore")

    return of


def cells(content: DataFrame, dialect: Dialect) -> DataFrame:
    """(file, row, cells array<string>): the rows below the first skip_rows lines, the header's row 1. Cells are trimmed,
    rows without any text left out, with collapse empty cells too; rows may differ in width. content: file, content.
    A file without rows, or null, gives none. A file is read by one task, as its quoted cells may span lines."""
    rows = _tables(content, dialect).select("file", F.posexplode("rows").alias("at", "cells"))
    return rows.select("file", (F.col("at") + 1).alias("row"), "cells")


def _tables(content: DataFrame, dialect: Dialect) -> DataFrame:
    """(file, rows array<array<string>>): cells(), a row a file, which is where they are numbered."""
    whole = content.select("file", decoded(F.col("content"), dialect.encoding).alias("text"))
    if dialect.delimiter == WHITESPACE:
        lines = F.filter(_lines(F.col("text")), lambda line, at: at >= dialect.skip_rows)
        rows = F.transform(lines, lambda line: F.filter(F.split(line, r"\s+"), lambda c: c != ""))
    else:
        line = r"(?:[^\r\n]*+(?:\r\n|\r|\n|\z))"
        body = F.regexp_replace("text", rf"\A{line}{{{dialect.skip_rows}}}", "") if dialect.skip_rows else F.col("text")
        whole = whole.select("file", _records(dialect.delimiter)(body).alias("records"))
        rows = F.col("records")
        if dialect.collapse:
            rows = F.transform(rows, lambda r: F.filter(r, lambda c: c != ""))
    return whole.select("file", F.filter(rows, lambda r: F.exists(r, lambda c: c != "")).alias("rows"))


def preamble(content: DataFrame, dialect: Dialect) -> DataFrame:
    """(file, place, name, value, line, text, named) of what the first skip_rows lines say.

    lines: each line that is not blank. keyvalue: "key: value" parted at the first colon; lines without one go on with the
    value before; headings of three hyphens are passed over. keyvalue_cells: "key=value" cells. What has no key is called
    preamble_N (N: its line; for cells its number among such), named tells whether the file gave the name; a key that
    comes again in a file gets _2, _3. line counts from 1. A file's head is moved as one row, its lines stay there; a task
    has about LINES of them, for which the files are counted first.
    """
    return _preamble(content, dialect, _heads(content, dialect))


def _preamble(content: DataFrame, dialect: Dialect, parts: int) -> DataFrame:
    text = content.select("file", decoded(F.col("content"), dialect.encoding).alias("text"))
    head = text.select("file", F.slice(_lines(F.col("text")), 1, max(dialect.skip_rows, 1)).alias("raw")).repartition(parts, "file")
    head = head.select("file", F.posexplode("raw").alias("at", "raw")).where(F.col("at") < dialect.skip_rows)
    head = head.select("file", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"))
    if dialect.preamble == "lines":
        rows = head.where("text <> ''").select("file", F.col("line").cast("long").alias("at"), "line", "text", F.lit("").alias("key"), F.col("text").alias("value"), F.col("line").alias("number"))
    elif dialect.preamble == "keyvalue_cells":
        parts = F.split("text", r"\s+") if dialect.delimiter == WHITESPACE else F.element_at(_records(dialect.delimiter)(F.col("text")), 1)
        rows = head.where("text <> ''").select("file", "line", F.posexplode(parts).alias("cell", "text")).where("text <> ''")
        rows = rows.select("file", (F.col("line").cast("long") * (1 << 31) + F.col("cell")).alias("at"), "line", "text", F.trim(F.regexp_extract("text", r"(?s)^([^=]*)=", 1)).alias("key"))
        bare = F.sum(F.when(F.col("key") == "", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("at"))
        rows = rows.withColumn("value", F.when(F.col("key") != "", F.trim(F.regexp_replace("text", r"(?s)^[^=]*=", ""))).otherwise(F.col("text"))).withColumn("number", bare)
    elif dialect.preamble == "keyvalue":
        kv = r"(?s)^([^:]+?)\s*:\s*(.*)$"
        rows = head.where((F.col("text") != "") & ~F.col("text").rlike(r"^-{3,}")).withColumn("has", F.col("text").rlike(kv))
        by = Window.partitionBy("file").orderBy("line")
        rows = rows.withColumn("part", F.sum(F.when(F.col("has") | (F.row_number().over(by) == 1), 1).otherwise(0)).over(by))
        said = F.when(F.col("has"), F.regexp_extract("text", kv, 2)).otherwise(F.col("text"))
        rows = rows.groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("line", "text", "has", said.alias("said")))).alias("all"))
        one = F.col("all")[0]
        rows = rows.select("file", one["line"].cast("long").alias("at"), one["line"].alias("line"), one["text"].alias("text"), F.when(one["has"], F.regexp_extract(one["text"], kv, 1)).otherwise("").alias("key"), F.trim(F.array_join(F.transform("all", lambda x: x["said"]), " ")).alias("value"), one["line"].alias("number"))
    else:
        rows = head.where("false").select("file", F.lit(0).cast("long").alias("at"), "line", "text", F.lit("").alias("key"), F.lit("").alias("value"), F.lit(0).alias("number"))
    again = F.row_number().over(Window.partitionBy("file", "key").orderBy("at"))
    name = F.when(F.col("key") == "", F.concat(F.lit("preamble_"), "number")).otherwise(F.concat("key", F.when(F.col("again") > 1, F.concat(F.lit("_"), "again")).otherwise("")))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("again", again).select("file", place.alias("place"), name.alias("name"), "value", "line", "text", (F.col("key") != "").alias("named"))


def broadcast_rows(content: DataFrame, dialect: Dialect) -> DataFrame:
    """(file, row, cells, meta map<string,string>): rows cut or filled with "" to the header's width, and what the file's
    preamble says, under names that no column of the header has (_2, _3 are added). Files without a preamble have an
    empty map. Files and heads meet as one row each; their bytes are counted first, so that a task has about BYTES."""
    size = content.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = _parts(content, _heads(content, dialect), -(-size // BYTES))
    head = _tables(content, dialect).where(F.size("rows") > 0).repartition(parts, "file").withColumn("header", F.col("rows")[0])
    said = _preamble(content, dialect, parts).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "name", "value"))).alias("said"))
    names = F.array_union("header", F.transform("said", lambda x: x["name"]))
    free = lambda n: F.filter(F.sequence(F.lit(2), F.size(names) + 2), lambda i: ~F.array_contains(names, F.concat(n, F.lit("_"), i.cast("string"))))[0]
    safe = lambda n: F.when(F.array_contains("header", n), F.concat(n, F.lit("_"), free(n).cast("string"))).otherwise(n)
    meta = F.map_from_entries(F.transform("said", lambda x: F.struct(safe(x["name"]), x["value"])))
    about = head.join(said, "file", "left").select("file", "rows", F.size("header").alias("width"), F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("meta"))
    fitted = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), 1, F.col("width"))
    rows = about.select("file", "width", "meta", F.posexplode("rows").alias("at", "cells"))
    return rows.select("file", (F.col("at") + 1).alias("row"), fitted.alias("cells"), "meta")


@pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("sample", T.StringType())]))
def _foreign(values: pd.Series) -> pd.DataFrame:
    """Encoding and first bytes of files that are not UTF-8, decoded; Spark has no decoder for most of these."""

    def one(raw: bytes) -> tuple[str, str]:
        raw = bytes(raw)
        name = "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "cp932"
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            name = name if name == "utf-16" else "latin-1"
        return name, raw[:SAMPLE_BYTES].decode(name, "replace")

    return pd.DataFrame([one(v) for v in values], columns=["encoding", "sample"])


def _shape(body: Column, sign: str) -> Column:
    """(first, width) of each record of a text that has any cell with text: its first line, from 0, and how many cells it
    has under a sign. A cell that begins with a quote goes on to the quote that ends it, across signs and lines."""
    if sign == WHITESPACE:
        lines = F.transform(F.split(body, "\n"), lambda line, i: F.struct(i.alias("first"), F.regexp_count(line, F.lit(r"\S+")).alias("width")))
        return F.filter(lines, lambda r: r["width"] > 0)
    s = "\\" + sign if sign == "|" else sign
    quoted = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
    cell = rf"(?:{quoted})?+[^{s}\n]*+"
    records = F.regexp_extract_all(body, F.lit(rf"{cell}(?:{s}{cell})*+(?:\n|\z)"), F.lit(0))
    # a quoted cell counts as one letter: what signs are left part cells
    signs = lambda r: F.regexp_count(F.regexp_replace(r, rf"(^|{s}){quoted}", "$1q"), F.lit(s))
    begun = F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<first:int,width:int>>").alias("rows"))

    def add(done: Column, r: Column) -> Column:
        row = F.struct(done["line"].alias("first"), (signs(r) + 1).alias("width"))
        rows = F.when(F.regexp_replace(r, rf'[{s}"\s]+', "") == "", done["rows"]).otherwise(F.concat(done["rows"], F.array(row)))
        return F.struct((done["line"] + F.regexp_count(r, F.lit("\n"))).alias("line"), rows.alias("rows"))

    return F.aggregate(records, begun, add, lambda done: done["rows"])


def _run(rows: Column) -> Column:
    """(same, width, first) of the records of one width at the end; null where they make no table."""
    width = F.element_at(rows, -1)["width"]
    # rows before the run: up to the last one of another width
    before = F.coalesce(F.array_max(F.transform(rows, lambda r, i: F.when(r["width"] != width, i + 1))), F.lit(0))
    same = F.size(rows) - before
    made = F.struct(same.alias("same"), width.alias("width"), F.get(rows, before)["first"].alias("first"))
    return F.when((F.size(rows) > 0) & (same >= LEAST_RUN) & (width >= LEAST_COLUMNS), made)


def detected(content: DataFrame) -> DataFrame:
    """(file, encoding, delimiter, skip_rows), a row a file, from its first 1 MiB and 200 lines; the encoding has to fit
    the whole file. Rows of one width at the file's end are its table; blanks part cells only where that gives a longer
    table of another width. Files without a table, empty or null ones have the default, comma and no line skipped.

    All counting is expressions over one row a file; Python decodes those files alone that are not UTF-8.
    """
    raw = F.coalesce("content", F.lit("").cast("binary"))
    plain = F.is_valid_utf8(raw.cast("string")) & ~F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF")
    rows = content.select("file", raw.alias("content"), plain.alias("plain"), (F.octet_length(raw) > SAMPLE_BYTES).alias("more"))
    # what is looked at is dealt by the number of files: many small ones lie in few parts
    looked = F.when(F.col("plain"), F.substring("content", 1, SAMPLE_BYTES)).otherwise(F.col("content"))
    rows = rows.withColumn("content", looked).repartition(_parts(content, -(-content.select("file").count() // FILES)))
    ours = rows.where("plain").select("file", "more", F.lit(ENCODINGS[0]).alias("encoding"), F.make_valid_utf8(F.substring("content", 1, SAMPLE_BYTES).cast("string")).alias("sample"))
    theirs = rows.where("not plain").select("file", "more", _foreign("content").alias("f")).select("file", "more", "f.*")
    lines = _lines(F.regexp_replace("sample", "^\ufeff", ""))
    lines = F.slice(F.when(F.col("more"), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), 1, SAMPLE_LINES)
    body = F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", "")
    rows = ours.unionByName(theirs).select("file", "encoding", body.alias("body"))
    rows = rows.select("*", *[_shape(F.col("body"), s).alias(f"s{i}") for i, s in enumerate((*SIGNS, WHITESPACE))])
    runs = [F.struct(_run(F.col(f"s{i}"))["same"].alias("same"), _run(F.col(f"s{i}"))["width"].alias("width"), F.lit(-i).alias("i"), F.lit(s).alias("sign"), _run(F.col(f"s{i}"))["first"].alias("first")) for i, s in enumerate(SIGNS)]
    rows = rows.select("*", F.array_max(F.filter(F.array(*runs), lambda r: r["same"].isNotNull())).alias("best"), _run(F.col(f"s{len(SIGNS)}")).alias("blank"))
    commas = F.array_distinct(F.transform("s0", lambda r: r["width"]))
    settled = (F.col("body") == "") | ((F.size(commas) == 1) & (F.get(commas, F.lit(0)) >= LEAST_COLUMNS))
    longer = F.when(F.col("best").isNotNull(), (F.col("blank.same") > F.col("best.same")) & (F.col("blank.width") != F.col("best.width"))).otherwise((F.col("blank.first") == 0) | (F.size(commas) > 1))
    by_blanks = F.col("blank").isNotNull() & longer
    sign = F.when(settled, ",").when(by_blanks, WHITESPACE).otherwise(F.coalesce("best.sign", F.lit(",")))
    first = F.when(settled, 0).when(by_blanks, F.col("blank.first")).otherwise(F.coalesce("best.first", F.lit(0)))
    return rows.select("file", "encoding", sign.alias("delimiter"), first.cast("int").alias("skip_rows"))
