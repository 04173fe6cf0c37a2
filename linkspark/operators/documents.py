"""Sentences of running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words whose closing point ends no sentence.
ABBREVIATIONS = "fig figs eq eqs ref refs no vs etc al e.g i.e cf approx ca wt vol mol min max resp calc exp temp ed eds pp vols nos dr prof".split()
_WORDS = "|".join(w.replace(".", r"\.") for w in ABBREVIATIONS)
_END = rf"(?<=[.!?])(?<!\p{{Nd}}[.!?])(?<!(?:^|\s)\p{{L}}[.!?]{{1,9}})(?<!(?:^|\s)(?i:{_WORDS})[.!?]{{1,9}})"
#: As little as reaches a boundary with the blanks behind it, or the end of the text.
SENTENCE = rf"""(?s).+?(?:{_END}\x20+(?=[\p{{Lu}}(\[“‘"']|\z)|\z)"""


def sentences_in(text: Column) -> Column:
    """Pieces that make up the text, each a sentence with the blanks behind it.

    A sentence ends at . ! or ? before blanks and a capital, an opening bracket or a quote, but not behind a digit, a
    single letter or an abbreviation.
    """
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n from 1, begin_at, end_at, sentence): offsets in code points, blanks at both ends left out. Null, empty and
    blank texts give no rows. `key` tells documents apart: the pieces of one are counted through in one window."""
    pieces = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(sentences_in(F.col(f"`{text}`"))).alias("n", "piece"))
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)))
    begin = F.col("at") + F.length("piece") - F.length(F.ltrim("piece"))
    sentence = F.trim("piece")
    out = pieces.where(F.col("piece").rlike(r"(?U)\S"))
    return out.select(key, (F.col("n") + 1).cast("long").alias("n"), begin.cast("long").alias("begin_at"), (begin + F.length(sentence)).cast("long").alias("end_at"), sentence.alias("sentence"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position from 0, paragraph): lines of a text that are not blank, trimmed of blanks, in order. Null and blank
    texts give none. No shuffle: a document's lines are numbered where they stand."""
    kept = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return docs.select(F.col(f"`{key}`").alias(key), F.posexplode(kept).alias("position", "paragraph")).withColumn("position", F.col("position").cast("long"))


def fulltext(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, context, paragraphs): the paragraphs of each document as one text."""
    rows = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "paragraph"))).alias("all"))
    return rows.select(key, F.array_join(F.transform("all", lambda p: p["paragraph"]), "\n").alias("context"), F.size("all").cast("long").alias("paragraphs"))


def provenance(docs: DataFrame, base: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, activity): the parse of each document, named by a hash of its content; equal texts share one."""
    return docs.select(key, F.concat(F.lit(base), F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 12)).alias("activity"))
