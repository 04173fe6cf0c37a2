"""Articles in XML as trees: one stream of tags and texts per document, its nesting found by running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.values import structural_slug, trim_collapse

# The role that a top section has if its title holds the word, in order of trial.
ROLES = (
    ("introduction", "Introduction"),
    ("method", "Methods"),
    ("material", "Materials"),
    ("result", "Results"),
    ("discussion", "Discussion"),
    ("conclusion", "Conclusion"),
)
BODY = "_body"
# Characters of articles that one task takes apart; its events need about a hundred times as many bytes.
CHARS = 1 << 21
_TAG = r"""</?[^\s<>/!?"'][^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>"""
_TOKEN = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*+(?:\[[^\]]*+\])?+\s*+>|{_TAG}|[^<]++"
_ATTRIBUTE = r"""[^\s=/<>"']+\s*=\s*(?:"[^"]*"|'[^']*')"""
_REFERENCE = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});"


def _attribute(tag: Column, name: str) -> Column:
    """Value of one attribute of a tag, wherever it stands; "" without it."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"^{name}\s*="))
    return F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), r"""(?s)=\s*["'](.*)["']$""", 1), F.lit(""))


def unescaped(text: Column) -> Column:
    """A text with its character references undone: the five named ones and numbers."""

    def point(ref: Column) -> Column:
        number = F.when(ref.startswith("&#x"), F.conv(F.regexp_extract(ref, "&#x(.*);", 1), 16, 10)).otherwise(F.regexp_extract(ref, "&#(.*);", 1)).cast("int")
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(sound, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#x?[0-9A-Fa-f]+;"), F.lit(0)))
    plain = F.when(F.size(numbers) > 0, F.aggregate(numbers, text, lambda done, ref: F.replace(done, ref, point(ref)))).otherwise(text)
    named = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), named, plain)


def _parts(docs: DataFrame, xml: str) -> int:
    """How many tasks take the articles apart, by their characters, which are counted first."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{xml}`")))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS))


def _events(docs: DataFrame, key: str, xml: str, parts: int) -> DataFrame:
    """(key, run, problem, at, kind, name, id, text): opening (1) and closing (-1) tags and texts (0) of each document, in
    order; an empty element is both tags. Documents that are refused have one row without a kind. A document is moved
    once, as its text; its events stay where they are made."""
    body = F.col("xml")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{xml}`").alias("xml")).withColumn("run", F.sha2(F.coalesce(body, F.lit("")), 256))
    rows = rows.repartition(parts, "key", "run").dropDuplicates(["key", "run"])
    pieces = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    refused = F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "no document").when(body.contains("<!ENTITY"), "entities are refused")
    rows = rows.withColumn("problem", refused).withColumn("pieces", F.when(F.col("problem").isNull(), pieces))
    whole = F.aggregate(F.transform("pieces", lambda p: F.length(p)), F.lit(0), lambda a, n: a + n) == F.length(body)
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(~whole, "stray < or >")))
    rows = rows.select("key", "run", "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("pieces"))).alias("at", "piece"))
    piece = F.col("piece")
    data = piece.startswith("<![CDATA[")
    skipped = (piece.startswith("<!") & ~data) | piece.startswith("<?")
    rows = rows.where(F.coalesce(~skipped, F.lit(True)))
    tag = piece.startswith("<") & ~data
    name = F.when(tag, F.regexp_extract(piece, r"^</?([^\s/>]+)", 1))
    kinds = F.when(~tag, F.array(F.lit(0))).when(piece.startswith("</"), F.array(F.lit(-1))).when(piece.endswith("/>"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    text = F.when(data, F.substring(piece, F.lit(10), F.length(piece) - 12)).when(~tag, unescaped(piece))
    bad = F.when(~tag & ~data & F.regexp_replace(piece, _REFERENCE, "").contains("&"), "unknown entity")
    rows = rows.select("key", "run", F.coalesce("problem", bad).alias("problem"), F.col("at").cast("long"), name.alias("name"), F.when(tag & ~piece.startswith("</"), _attribute(piece, "id")).alias("id"), text.alias("text"), F.posexplode_outer(kinds).alias("half", "kind"))
    return rows.withColumn("at", F.coalesce(F.col("at") * 2 + F.col("half"), F.lit(0))).drop("half")


def _tree(docs: DataFrame, key: str, xml: str, parts: int | None = None) -> DataFrame:
    """Events with depth, the document's problem (null: none) and, within its body, what they stand in.

    A wall is any element of the body that is no section with an id: sections behind walls are not reached. walls: those
    around an event, itself included; outer, second: the first two of them; level: sections around an event; section: the
    innermost of them. All windows are over one document, in one order, so its events are sorted once.
    """
    doc = Window.partitionBy("key", "run")
    so_far = doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kind, name = F.col("kind"), F.col("name")
    opens, closes = kind == 1, kind == -1
    e = _events(docs, key, xml, parts or _parts(docs, xml)).withColumn("after", F.sum("kind").over(so_far))
    e = e.withColumn("depth", F.col("after") + F.when(closes, 1).otherwise(0))
    tags = Window.partitionBy("key", "run", "depth", F.col("kind") != 0).orderBy("at")
    e = e.withColumn("pair", F.lag(F.struct("kind", "name", "id")).over(tags))
    e = e.withColumn("id", F.when(closes, F.col("pair.id")).otherwise(F.col("id")))
    unpaired = closes & ~F.coalesce((F.col("pair.kind") == 1) & (F.col("pair.name") == name), F.lit(False))
    outside = (F.col("depth") < 1) & (F.coalesce(F.trim(F.regexp_replace("text", r"[\s﻿]+", "")), F.lit("")) != "")
    e = e.withColumn("problem", F.coalesce("problem", F.when(unpaired, "tags do not match"), F.when(outside, "text outside of the root")))
    roots = F.sum(F.when(opens & (F.col("depth") == 1), 1).otherwise(0)).over(doc)
    e = e.withColumn("problem", F.coalesce(F.min("problem").over(doc), F.when(F.sum("kind").over(doc) != 0, "tags do not match"), F.when(roots != 1, "not one root")))
    root = F.max(F.when(opens & (F.col("depth") == 1), name)).over(doc)
    e = e.withColumn("root", root)
    is_body = opens & (name == "body") & F.when(F.col("root") == "article", F.col("depth") == 2).otherwise(F.col("depth") >= 2)
    e = e.withColumn("body", F.min(F.when(is_body, F.struct("at", "depth"))).over(doc))
    e = e.withColumn("end", F.min(F.when(closes & (F.col("depth") == F.col("body.depth")) & (F.col("at") > F.col("body.at")), F.col("at"))).over(doc))
    e = e.withColumn("problem", F.coalesce("problem", F.when(F.col("body").isNull(), "no body")))
    inside = F.col("problem").isNull() & (F.col("at") > F.col("body.at")) & (F.col("at") < F.col("end"))
    passable = (name == "sec") & (F.coalesce("id", F.lit("")) != "")
    e = e.withColumn("inside", inside).withColumn("wall", inside & (kind != 0) & ~passable)
    e = e.withColumn("walls", F.sum(F.when(F.col("wall"), kind).otherwise(0)).over(so_far))
    alone = F.col("walls") - F.when(opens & F.col("wall"), 1).otherwise(0)
    e = e.withColumn("reached", inside & passable & (kind != 0) & (F.col("walls") == 0))
    e = e.withColumn("level", F.sum(F.when(F.col("reached"), kind).otherwise(0)).over(so_far))
    wall_at = lambda n: F.last(F.when(opens & F.col("wall") & (alone == n), F.struct("at", "name", "id")), ignorenulls=True).over(so_far)
    e = e.withColumn("outer", wall_at(0)).withColumn("second", wall_at(1))
    level = Window.partitionBy("key", "run", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("section", F.last(F.when(opens & F.col("reached"), F.struct("at", "id")), ignorenulls=True).over(level))


def _blocks(tree: DataFrame) -> DataFrame:
    """(key, run, section_at, section, fig, part, at, text): titles, paragraphs, list items, labels and captions with all of
    their text, blanks collapsed. One shuffle row a text, gathered by block."""
    outer, second = F.col("outer"), F.col("second")
    held = F.col("walls") >= 2
    in_section = F.col("level") > 0
    part = F.when(outer["name"] == "p", "paragraph").when((outer["name"] == "title") & in_section, "title").when((outer["name"] == "list") & held & (second["name"] == "list-item"), "paragraph")
    part = part.when((outer["name"] == "fig") & in_section & (F.coalesce(outer["id"], F.lit("")) != "") & held & second["name"].isin("label", "caption"), second["name"])
    begin = F.when(outer["name"].isin("p", "title"), outer["at"]).otherwise(second["at"])
    rows = tree.where("inside and kind >= 0 and walls >= 1").withColumn("part", part).where("part is not null")
    own = F.when(in_section, F.col("section.at"))
    rows = rows.select("key", "run", own.alias("section_at"), F.when(in_section, F.col("section.id")).alias("section"), F.when(outer["name"] == "fig", outer["at"]).alias("fig"), "part", begin.alias("begin"), "at", "text")
    rows = rows.groupBy("key", "run", "section_at", "section", "fig", "part", F.col("begin").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), F.coalesce("text", F.lit("")).alias("t")))).alias("all"))
    return rows.withColumn("text", trim_collapse(F.array_join(F.transform("all", lambda x: x["t"]), ""))).drop("all")


def errors(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, error) of documents that give nothing: null or blank, with entities of their own, not well-formed, or
    without a body. One such document never fails the others."""
    return _tree(docs, key, xml).where("problem is not null").select(F.col("key").alias(key), F.col("problem").alias("error")).distinct()


def sections(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, section, parent, level, begin, end, title, path, roles) of every section with an id, reached from the body
    through such sections alone; one without id is passed over with all that it holds.

    parent: the section around it (null: the body); begin, end: its place among the document's events, so that a section
    holds those whose begin lies between. title: text of its first title, "" without one. path: the title's leading number.
    roles: of top sections, what the title's words say. Paragraphs that stand in the body itself make one more section,
    BODY. Rows that repeat key and text are one document; documents that `errors` lists give no rows.
    """
    return _sections(_tree(docs, key, xml), key)


def _sections(tree: DataFrame, key: str) -> DataFrame:
    level = F.col("level") + F.when(F.col("kind") == -1, 1).otherwise(0)
    marks = tree.where("reached").select("key", "run", "at", "id", "kind", level.alias("own"))
    roles = F.when(F.col("kind") == 1, F.array(F.struct(F.col("own").alias("p"), F.lit(True).alias("self")), F.struct((F.col("own") - 1).alias("p"), F.lit(False).alias("self")))).otherwise(F.array(F.struct(F.col("own").alias("p"), F.lit(True).alias("self"))))
    marks = marks.select("*", F.inline(roles))
    by = Window.partitionBy("key", "run", "p").orderBy("at")
    opened = F.col("self") & (F.col("kind") == 1)
    end = F.first(F.when(F.col("self") & (F.col("kind") == -1), F.col("at")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    parent = F.last(F.when(opened, F.col("id")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.select("key", "run", "at", "id", "own", "kind", F.when(opened, end).alias("end"), F.when(~F.col("self") & (F.col("p") > 0), parent).alias("parent")).where("kind = 1")
    found = marks.groupBy("key", "run", "at", "id", "own").agg(F.max("end").alias("end"), F.max("parent").alias("parent"))
    blocks = _blocks(tree)
    titles = blocks.where("part = 'title'").groupBy("key", "run", F.col("section_at").alias("at")).agg(F.min_by("text", "at").alias("title"))
    found = found.join(titles, ["key", "run", "at"], "left").withColumn("title", F.coalesce("title", F.lit("")))
    said = [F.when(F.lower("title").contains(word), F.lit(role)) for word, role in ROLES]
    roles = F.when(F.col("own") == 1, F.array_compact(F.array(*said))).otherwise(F.array().cast("array<string>"))
    found = found.select(F.col("key").alias(key), F.col("id").alias("section"), "parent", F.col("own").cast("int").alias("level"), F.col("at").alias("begin"), "end", "title", structural_slug(F.col("title")).alias("path"), roles.alias("roles"))
    flat = blocks.where("part = 'paragraph' and section_at is null and text <> ''").select("key", "run").distinct()
    none = F.lit(None)
    flat = flat.select(F.col("key").alias(key), F.lit(BODY).alias("section"), none.cast("string").alias("parent"), F.lit(1).alias("level"), none.cast("long").alias("begin"), none.cast("long").alias("end"), F.lit("").alias("title"), F.lit("").alias("path"), F.array().cast("array<string>").alias("roles"))
    return found.unionByName(flat)


def paragraphs(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, section, section_begin, n, position, paragraph): paragraphs and list items that stand directly in a section or
    the body, blank ones left out; n counts from 0 in its section, position in the document: sections as they begin, the
    body's own paragraphs (section BODY) last. A list item is one paragraph with all that it holds."""
    return _paragraphs(_tree(docs, key, xml), key)


def _paragraphs(tree: DataFrame, key: str) -> DataFrame:
    rows = _blocks(tree).where("part = 'paragraph' and text <> ''")
    own = Window.partitionBy("key", "run", "section_at").orderBy("at")
    all_ = Window.partitionBy("key", "run").orderBy(F.col("section_at").asc_nulls_last(), "at")
    rows = rows.select("*", (F.row_number().over(own) - 1).cast("long").alias("n"), (F.row_number().over(all_) - 1).cast("long").alias("position"))
    return rows.select(F.col("key").alias(key), F.coalesce("section", F.lit(BODY)).alias("section"), F.col("section_at").alias("section_begin"), "n", "position", F.col("text").alias("paragraph"))


def figures(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, figure, section, label, caption) of figures with an id that stand directly in a section; label and caption
    are the figure's own first ones, null without."""
    tree = _tree(docs, key, xml)
    found = tree.where("inside and kind = 1 and name = 'fig' and walls = 1 and level > 0 and coalesce(id, '') <> ''").select("key", "run", F.col("at").alias("fig"), F.col("id").alias("figure"), F.col("section.id").alias("section"))
    said = _blocks(tree).where("fig is not null").groupBy("key", "run", "fig").agg(F.min_by(F.when(F.col("part") == "label", F.col("text")), F.when(F.col("part") == "label", F.col("at"))).alias("label"), F.min_by(F.when(F.col("part") == "caption", F.col("text")), F.when(F.col("part") == "caption", F.col("at"))).alias("caption"))
    return found.join(said, ["key", "run", "fig"], "left").select(F.col("key").alias(key), "figure", "section", "label", "caption")


def passages(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, section, paragraphs, passage): text of each section with all sections that it holds, a line a paragraph. Holding
    is nesting of intervals, so nothing is walked level by level; a paragraph is a row for each section around it."""
    parts = _parts(docs, xml)
    tree = _tree(docs, key, xml, parts)
    # keys in a struct, as null is a key too; dealt like the articles
    around = _sections(tree, key).select(F.struct(F.col(key)).alias("of"), F.col("section").alias("holds"), "begin", "end").repartition(parts, "of")
    rows = _paragraphs(tree, key).select(F.struct(F.col(key)).alias("by"), "section_begin", "position", "paragraph").repartition(parts, "by")
    held = (F.col("section_begin") >= F.col("begin")) & (F.col("section_begin") < F.col("end"))
    met = around.join(rows, (F.col("of") == F.col("by")) & (held | (F.col("begin").isNull() & F.col("section_begin").isNull())))
    met = met.groupBy("of", "holds", "begin").agg(F.array_sort(F.collect_list(F.struct("position", "paragraph"))).alias("all"))
    return met.select(F.col(f"of.`{key}`").alias(key), F.col("holds").alias("section"), F.size("all").cast("long").alias("paragraphs"), F.array_join(F.transform("all", lambda p: p["paragraph"]), "\n").alias("passage"))


def inventory(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, element, count, with_id) of the top sections, sections right below those, and all figures, tables and
    paragraphs of each body; elements that a document lacks give no row."""
    at = F.col("depth") - F.col("body.depth")
    path = Window.partitionBy("key", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    tree = _tree(docs, key, xml).withColumn("top", F.last(F.when((F.col("kind") == 1) & (at == 1), F.col("name")), ignorenulls=True).over(path))
    what = F.when((F.col("name") == "sec") & (at == 1), "section").when((F.col("name") == "sec") & (at == 2) & (F.col("top") == "sec"), "subsection")
    what = what.when(F.col("name") == "fig", "figure").when(F.col("name") == "table-wrap", "table").when(F.col("name") == "p", "paragraph")
    rows = tree.where("inside and kind = 1").select("key", what.alias("element"), F.coalesce(F.col("id") != "", F.lit(False)).alias("has")).where("element is not null")
    return rows.groupBy(F.col("key").alias(key), "element").agg(F.count(F.lit(1)).alias("count"), F.count_if("has").alias("with_id"))
