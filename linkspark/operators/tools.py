"""Named questions with typed parameters, and the report shapes that they are made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.values import text
from linkspark.operators.graph import truncated

# The relations that two terms may be asserted to have.
RELATIONS = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


@dataclass(frozen=True)
class Param:
    """A parameter of a tool: kind is string, number, integer, iri or enum; low and high clamp numbers."""

    name: str
    kind: str = "string"
    required: bool = False
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    """A question: its parameters, and a function from a table and bound arguments to rows. Optional sections are for the
    function to leave out where an argument is None."""

    name: str
    params: tuple[Param, ...]
    ask: Callable[[DataFrame, dict], DataFrame]
    order: tuple[str, ...]
    columns: tuple[str, ...]


def bind(tool: Tool, args: dict) -> dict:
    """Arguments by their kinds, with defaults and clamps. Unknown, missing and ill-typed ones are errors."""
    known = {p.name: p for p in tool.params}
    if unknown := sorted(set(args) - set(known)):
        raise ValueError(f"{tool.name}: unknown {', '.join(unknown)}")
    out = {}
    for name, p in known.items():
        value = args.get(name, p.default)
        if value is None or value == "":
            if p.required:
                raise ValueError(f"{tool.name}: {name} is required")
            out[name] = None
            continue
        if p.kind in ("number", "integer"):
            if isinstance(value, bool):
                raise ValueError(f"{tool.name}: {name} is not a number")
            try:
                value = float(value) if p.kind == "number" else int(str(value))
            except ValueError:
                raise ValueError(f"{tool.name}: {name} is not a number") from None
            value = value if p.low is None else max(value, p.low)
            value = value if p.high is None else min(value, p.high)
        elif p.kind == "enum" and value not in p.choices:
            raise ValueError(f"{tool.name}: {name} is none of {', '.join(p.choices)}")
        elif p.kind == "iri" and ("://" not in str(value) and not str(value).startswith("urn:") or any(c in str(value) for c in '<>"{}|\\^` ')):
            raise ValueError(f"{tool.name}: {name} is no IRI")
        elif not isinstance(value, str | int | float):
            raise ValueError(f"{tool.name}: {name} is not text")
        out[name] = value
    return out


def run(tool: Tool, table: DataFrame, args: dict, most: int = 200) -> DataFrame:
    """The tool's columns of its first `most` rows in its order, with a flag whether there are more. Arguments reach the
    plan as literals, never as text of a query."""
    rows = tool.ask(table, bind(tool, args))
    return truncated(rows, most, *tool.order).select(*tool.columns, "truncated")


def flat_rows(table: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of any table as texts, with the whole number of rows and a flag whether there are more."""
    n = table.agg(F.count(F.lit(1)).alias("row_count"))
    head = truncated(table.select(*[text(F.col(f"`{c}`")).alias(c) for c in table.columns]), most, *order)
    return head.crossJoin(F.broadcast(n))  # n is one row


def contains_ci(c: Column, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def cross_group(rows: DataFrame, group: str, value: str, entity: str, example: str, most: int) -> DataFrame:
    """(group, top, entities, example) of joined rows: the largest value, distinct entities and the smallest example of each
    group; the `most` groups with the largest tops."""
    out = rows.groupBy(F.col(group).alias("group")).agg(F.max(value).alias("top"), F.count_distinct(entity).alias("entities"), F.min(example).alias("example"))
    return out.orderBy(F.desc("top"), "group").limit(most)


def activity_summary(rows: DataFrame, run: str, at: str) -> DataFrame:
    """(run, entities, started, ended) of what each run made."""
    return rows.groupBy(F.col(run).alias("run")).agg(F.count(F.lit(1)).alias("entities"), F.min(at).alias("started"), F.max(at).alias("ended"))


def iri_filter(q: DataFrame, prefix: str, pattern: str) -> DataFrame:
    """Quads whose subject starts with a prefix and whose object matches a pattern."""
    return q.where(F.col("s").startswith(prefix) & F.col("o").rlike(pattern))


def length_filter(rows: DataFrame, group: str, value: str, most: int) -> DataFrame:
    """(group, kept, dropped): values of at most `most` characters, and longer ones."""
    return rows.groupBy(group).agg(F.count_if(F.length(value) <= most).alias("kept"), F.count_if(F.length(value) > most).alias("dropped"))


def first_match(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(entity, candidate, match): for each entity the first of its candidates, in order, that a reference table has. rows:
    entity, candidates (an array); table: candidate, match. Entities without a hit are left out; of several matches of a
    candidate the smallest counts."""
    each = rows.select("entity", F.posexplode("candidates").alias("place", "candidate"))
    met = each.join(table.groupBy("candidate").agg(F.min("match").alias("match")), "candidate")
    best = met.groupBy("entity").agg(F.min(F.struct("place", "candidate", "match")).alias("b"))
    return best.select("entity", "b.candidate", "b.match")


def most_stable(rows: DataFrame, key: str, value: str, entity: str) -> DataFrame:
    """(key, least, entity): the entry with the smallest value of each key, of equal ones the smallest entity; null values
    do not count."""
    best = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(value, entity)).alias("b"))
    return best.select("key", F.col(f"b.{value}").alias("least"), F.col(f"b.{entity}").alias("entity"))


def alignments(rows: DataFrame) -> DataFrame:
    """(id, source, relation, target) of asserted term relations, as a set; the id is a hash of the three. A relation out of
    the closed set is an error when the rows are made."""
    known = F.when(F.col("relation").isin(*RELATIONS), F.col("relation")).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce("relation", F.lit("null")))))
    rows = rows.select("source", known.alias("relation"), "target").distinct()
    return rows.select(F.substring(F.sha1(F.concat_ws("\n", "source", "relation", "target")), 1, 16).alias("id"), "source", "relation", "target")


def keep_payload(rows: DataFrame, payload: str, n: int, *order) -> DataFrame:
    """All rows, with the payload of the first `n` by `order` only. The first ones are found without their payloads."""
    keys = [c for c in rows.columns if c != payload]
    top = rows.select(*keys).orderBy(*order).limit(n).withColumn("linkspark_top", F.lit(True))
    out = rows.join(F.broadcast(top), keys, "left")  # n rows
    return out.select(*[F.when(F.col("linkspark_top"), F.col(c)).alias(c) if c == payload else F.col(c) for c in rows.columns])


def placed(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows by several keys, numbered from 1; name a total order."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def positional(rows: DataFrame, base: str, parent: str, kind: str, *order) -> DataFrame:
    """rows with an iri made of the parent's and the row's position among its parent's, from 0."""
    at = F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1
    return rows.withColumn("iri", F.concat(F.lit(base), F.col(parent).cast("string"), F.lit(f"/{kind}/"), at.cast("string")))


def dup_suffix(rows: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """rows with name suffixed _2, _3, ... where a scope repeats it, in order."""
    n = F.row_number().over(Window.partitionBy(scope, name).orderBy(order))
    return rows.withColumn("name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def representative(rows: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """(key, shown, n): the largest group of each key's rows, of equally large ones the one whose first row comes first."""
    sizes = rows.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = sizes.groupBy(F.col(key).alias("key")).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", F.col(group).alias("shown"), "n")).alias("b"))
    return best.select("key", "b.shown", "b.n")


def quote(sentences: DataFrame, docs: DataFrame, part: str, most: int) -> DataFrame:
    """(doc_id, n, begin_at, sentence, source, truncated): sentences that hold a text, whatever its case, with where they
    stand and what they are cited from; ordered by document and offset."""
    found = sentences.where(contains_ci(F.col("sentence"), part)).join(docs, "doc_id")
    return truncated(found, most, "doc_id", "begin_at").select("doc_id", "n", "begin_at", "sentence", "source", "truncated")


def passage(paragraphs: DataFrame, doc: int, section: str | None = None) -> DataFrame:
    """Paragraphs of one document, of one section if it is named, in order."""
    rows = paragraphs.where(F.col("doc_id") == doc)
    return rows if section is None else rows.where(F.col("section") == section)


def draft_stats(q: DataFrame, sources: dict[str, DataFrame], class_of: dict[str, str]) -> DataFrame:
    """(source, class, rows, entities): entities of a draft by class beside the rows of the table that they come from."""
    from linkspark.operators.graph import class_counts

    counts = class_counts(q)
    out = None
    for name, df in sources.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), F.lit(class_of[name]).alias("class"), "rows")
        out = row if out is None else out.unionByName(row)
    return out.join(counts, "class", "left").select("source", "class", "rows", F.coalesce("n", F.lit(0)).alias("entities"))


def trial_queries(q: DataFrame, most: int = 3) -> DataFrame:
    """(kind, predicate, detail) of questions worth asking first: the classes with most instances, and the numeric predicates
    with most values and a spread."""
    from linkspark.operators.graph import class_counts, numeric_range

    counts = class_counts(q).orderBy(F.desc("n"), "class").limit(most).select(F.lit("count").alias("kind"), F.col("class").alias("predicate"), F.col("n").alias("detail"))
    ranges = numeric_range(q).orderBy(F.desc("n"), "predicate").limit(most).select(F.lit("range").alias("kind"), "predicate", F.col("n").alias("detail"))
    return counts.unionByName(ranges)
