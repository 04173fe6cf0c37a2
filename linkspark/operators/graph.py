"""Questions over quads: patterns, closure, counts, summaries, description."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.mapping import TYPE, Map, all_quads, repeated, several, subject_of


def pattern(q: DataFrame, *triples: tuple[str, str, str]) -> DataFrame:
    """Basic graph pattern. Terms that begin with ? are variables; shared variables join, others are filters."""
    out = None
    for s, p, o in triples:
        part = q
        names: dict[str, str] = {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term in names:
                    part = part.where(F.col(column) == F.col(names[term]))
                else:
                    names[term] = column
            else:
                part = part.where(F.col(column) == term)
        part = part.select(*[F.col(c).alias(n[1:]) for n, c in names.items()])
        if out is None:
            out = part
        else:
            shared = [c for c in part.columns if c in out.columns]
            if not shared:
                raise ValueError(f"pattern {(s, p, o)} shares no variable with those before it")
            out = out.join(part, shared)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's shared folder (a temporary one where the session names none), so that what
    follows is planned from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="linkspark-"))
    return df.checkpoint()


def closure(edges: DataFrame, depth: int = 100, least: int = 1) -> DataFrame:
    """(a, b): every pair that edges (a, b) reach in one or more steps, with least=0 also each node with itself; cycles
    end. The pairs are the result, so their number is the caller's choice of edges. Each round joins what the last one
    found only; rounds are cut by checkpoints. Null ends reach nothing; more than `depth` rounds is an error."""
    if least == 0:
        edges = edges.select("a", "b")
        nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).where("a is not null").distinct()
        return closure(edges, depth).unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
    steps = edges.select("a", "b").distinct()
    known = fresh = cut(steps)
    for _ in range(depth):
        found = fresh.select("a", F.col("b").alias("via")).join(steps.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        fresh = found.join(known, ["a", "b"], "left_anti")
        fresh = cut(fresh)
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"closure deeper than {depth}")


def class_counts(q: DataFrame) -> DataFrame:
    """Instances of each class (class, n); a subject counts once. Null objects are a class of null."""
    return q.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.count_distinct("s").alias("n"))


def predicate_counts(q: DataFrame) -> DataFrame:
    """Quads of each predicate (predicate, n)."""
    return q.groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def class_shapes(q: DataFrame) -> DataFrame:
    """For each class the predicates on its instances, with counts: one join for all classes."""
    types = q.where(F.col("p") == TYPE).select("s", F.col("o").alias("class")).distinct()
    return q.where(F.col("p") != TYPE).join(types, "s").groupBy("class", F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def class_shapes_of(sources: list[tuple[DataFrame, Map, str]]) -> DataFrame:
    """As class_shapes(), of the quads that maps say as one set, each map with its table and graph, without a table of
    quads. A subject that one row of all tables has alone is counted by this row: what moves of it is a hash. Quads of
    subjects that come again, in one map or in several, are made a set and joined, and so are all quads of a map whose
    classes are in its columns."""
    rows = [(source.withColumn("__key", F.xxhash64(subject_of(source, spec))).where(subject_of(source, spec).isNotNull()), spec, graph) for source, spec, graph in sources]
    again = repeated(reduce(DataFrame.unionByName, [source.select("__key") for source, _, _ in rows]))
    counts, often = [], []
    for source, spec, graph in rows:
        if any(p.predicate == TYPE for p in spec.properties):
            often.append(several(source, (spec,), graph))
            continue
        once = source if again is None else source.join(again, "__key", "left_anti")
        uses = several(once, (spec,), graph, tuple(p.predicate for p in spec.properties)).groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))
        classes = F.array(*[F.lit(c) for c in dict.fromkeys(spec.classes) if c]).cast("array<string>")
        counts.append(uses.select(F.explode(classes).alias("class"), "predicate", "n"))
        if again is not None:
            often.append(several(source.join(again, "__key", "left_semi"), (spec,), graph))
    if often:
        counts.append(class_shapes(all_quads(*often)))
    return reduce(DataFrame.unionByName, counts).groupBy("class", "predicate").agg(F.sum("n").alias("n"))


def literal_profile(q: DataFrame) -> DataFrame:
    """Literals of each graph and predicate (g, predicate, n, sample): the sample is the smallest text."""
    return q.where("kind = 'literal'").groupBy("g", F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("sample"))


def numeric_range(q: DataFrame) -> DataFrame:
    """Predicates with a spread of numbers."""
    return q.where("o_num is not null").groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n"), F.min("o_num").alias("low"), F.max("o_num").alias("high")).where("low < high")


def range_with_evidence(q: DataFrame, predicate: str) -> DataFrame:
    rows = q.where((F.col("p") == predicate) & F.col("o_num").isNotNull())
    return rows.agg(F.min("o_num").alias("low"), F.min(F.struct("o_num", "s"))["s"].alias("low_subject"), F.max("o_num").alias("high"), F.min(F.struct((-F.col("o_num")).alias("n"), "s"))["s"].alias("high_subject"))


def union_branches(q: DataFrame, *triples: tuple[str, str, str]) -> DataFrame:
    """Alternatives that bind the same variables, as a set."""
    return reduce(DataFrame.unionByName, [pattern(q, t) for t in triples]).distinct()


def count_all(q: DataFrame) -> DataFrame:
    """Quads of each graph, and of all graphs together under a null graph (g, n)."""
    return q.rollup("g").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(q: DataFrame, predicate: str, most: int = 2000) -> DataFrame:
    """(value, datatypes, truncated): the distinct literals of a predicate in order, `most` of them (a report's limit), the
    datatypes seen with each, and whether there are more."""
    rows = q.where((F.col("p") == predicate) & (F.col("kind") == "literal")).groupBy(F.col("o").alias("value")).agg(F.array_sort(F.collect_set("dt")).alias("datatypes"))
    return truncated(rows, most, "value")


def truncated(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first `most` rows by `order` with a flag: whether there are more. One row more is asked for."""
    head, all_ = rows.orderBy(*order).limit(most + 1), Window.partitionBy(F.lit(0))  # most + 1 rows
    head = head.withColumns({"linkspark_place": F.row_number().over(all_.orderBy(*order)), "linkspark_n": F.count(F.lit(1)).over(all_)})
    return head.where(F.col("linkspark_place") <= most).withColumn("truncated", F.col("linkspark_n") > most).drop("linkspark_place", "linkspark_n")


def exists(rows: DataFrame) -> DataFrame:
    """One row (found): is there any row?"""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def top_record(q: DataFrame, predicate: str) -> DataFrame:
    """(s, p, o) of all literals of the subject with the largest number of a predicate; of equal ones the smallest subject."""
    best = q.where((F.col("p") == predicate) & F.col("o_num").isNotNull()).agg(F.min(F.struct((-F.col("o_num")).alias("n"), "s"))["s"].alias("s"))
    return q.where("kind = 'literal'").join(F.broadcast(best), "s").select("s", "p", "o")  # best is one row


def entity_count(q: DataFrame) -> DataFrame:
    """Number of distinct subjects."""
    return q.agg(F.count_distinct("s").alias("n"))


def per_parent(q: DataFrame, link: str, title: str, most: int) -> DataFrame:
    """(parent, title, n): children by parent over a link, with the parent's smallest title; the `most` largest, ties by
    parent. Parents are added up before titles are joined."""
    counts = q.where(F.col("p") == link).groupBy(F.col("o").alias("parent")).agg(F.count_distinct("s").alias("n"))
    names = q.where(F.col("p") == title).groupBy(F.col("s").alias("parent")).agg(F.min("o").alias("title"))
    return counts.orderBy(F.desc("n"), "parent").limit(most).join(names, "parent", "left").select("parent", "title", "n")


def class_pivot(q: DataFrame, classes: list[str]) -> DataFrame:
    """One row with the number of instances of each class (columns by local name)."""
    import re

    types = q.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("s", "o").distinct()
    return types.agg(*[F.count_if(F.col("o") == c).alias(re.split("[/#:]", c)[-1]) for c in classes])


def labels(q: DataFrame, terms: DataFrame, predicate: str) -> DataFrame:
    """terms (term) with one label each: the smallest text; null for none."""
    named = q.where((F.col("p") == predicate) & (F.col("kind") == "literal")).groupBy(F.col("s").alias("term")).agg(F.min("o").alias("label"))
    return terms.join(named, "term", "left")


def compound(values: DataFrame, parts: list[str], most: int = 256) -> DataFrame:
    """(entity, key, dropped): for entities that have every part all combinations of its values, in order, `most` of them
    for each entity (the operator's limit); dropped counts the rest. values: entity, part, value. Nulls are no values."""
    sets = values.where("value is not null").groupBy("entity").agg(*[F.array_sort(F.collect_set(F.when(F.col("part") == p, F.col("value")))).alias(f"v{i}") for i, p in enumerate(parts)])
    total = F.lit(1).cast("long")
    for i in range(len(parts)):
        sets, total = sets.where(F.size(f"v{i}") > 0), total * F.size(f"v{i}")
    # the n-th combination by mixed base, so that no combination beyond the limit is made
    rows = sets.withColumn("total", total).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(most)) - 1)))
    rest, picked = F.col("nth"), []
    for i in reversed(range(len(parts))):
        size = F.size(f"v{i}")
        picked.insert(0, F.get(F.col(f"v{i}"), (rest % size).cast("int")))
        rest = F.floor(rest / size)
    return rows.select("entity", F.array(*picked).alias("key"), F.greatest(F.lit(0), F.col("total") - most).alias("dropped"))


def reused(draft: DataFrame, canonical: DataFrame) -> DataFrame:
    """(kind, term, status): classes and predicates of a draft that the canonical graphs have (reused) or lack (new)."""

    def terms(q: DataFrame) -> DataFrame:
        classes = q.where(F.col("p") == TYPE).select(F.lit("class").alias("kind"), F.col("o").alias("term"))
        return classes.unionByName(q.where(F.col("p") != TYPE).select(F.lit("predicate").alias("kind"), F.col("p").alias("term"))).distinct()

    known = terms(canonical).withColumn("held", F.lit(True))
    return terms(draft).join(known, ["kind", "term"], "left").select("kind", "term", F.when(F.col("held"), "reused").otherwise("new").alias("status"))


def describe(q: DataFrame, subject: str) -> DataFrame:
    """Triples about one subject, outgoing and incoming; one it does not know has no rows."""
    out = q.where(F.col("s") == subject).select(F.lit("out").alias("direction"), "g", "p", F.col("o").alias("term"))
    back = q.where((F.col("o") == subject) & (F.col("kind") == "iri")).select(F.lit("in").alias("direction"), "g", "p", F.col("s").alias("term"))
    return out.unionByName(back)


def ranking(rows: DataFrame, entity: str, value: str, n: int, ceiling: float | None = None) -> DataFrame:
    """Entities by value, descending, ties by entity, n clamped to 1..100. Values over the ceiling are left out."""
    if ceiling is not None:
        rows = rows.where(F.col(value) <= ceiling)
    return rows.orderBy(F.desc(value), entity).limit(min(max(n, 1), 100))


def top_per_group(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group by `order`, with their rank; null is a group. Name a total order, ties are cut as they
    come. Spark keeps n rows of each group on the map side."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def schema_summary(q: DataFrame, classes: int = 50, predicates: int = 100, shape: int = 25, labels: DataFrame | None = None) -> DataFrame:
    """(kind, class, predicate, n, place, truncated, label) of the terms in use: kind class (instances of each class),
    predicate (quads of each) and shape (quads of each predicate on a class's instances).

    The most used ones, at most as many as the three limits say, shapes of the listed classes alone; truncated tells that
    there were more. Equal counts go by name. labels (term, label): of a term's labels the smallest is shown.

    The quads are read once: each learns the classes of its subject, and is counted by its predicate and that set of
    classes; what follows is as large as the vocabulary. Quads stored in buckets of subjects move only for that.
    """
    subject = Window.partitionBy("s")
    rows = q.select("s", "p", F.when(F.col("p") == TYPE, F.col("o")).alias("class")).withColumn("first", F.row_number().over(subject.orderBy("p")) == 1)
    rows = rows.withColumn("cs", F.sort_array(F.collect_set("class").over(subject))).groupBy("p", "cs", "first").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    entry = lambda kind, c, p: F.struct(F.lit(kind).alias("kind"), c.alias("class"), p.alias("predicate"))
    own = F.transform("cs", lambda c: entry("class", c, none))
    used = F.array(entry("predicate", none, F.col("p")))
    pairs = F.transform("cs", lambda c: entry("shape", c, F.col("p")))
    rows = rows.select("n", F.inline(F.concat(F.when(F.col("first"), own).otherwise(F.filter(own, lambda x: F.lit(False))), used, pairs))).groupBy("kind", "class", "predicate").agg(F.sum("n").alias("n"))
    group = F.when(F.col("kind") == "shape", F.col("class"))
    by = Window.partitionBy("kind", group)
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "class", "predicate"))).withColumn("all", F.count(F.lit(1)).over(by))
    most = F.when(F.col("kind") == "class", classes).when(F.col("kind") == "predicate", predicates).otherwise(shape)
    listed = rows.where((F.col("kind") == "class") & (F.col("place") <= classes)).select("class")
    kept = rows.where(F.col("kind") != "shape").unionByName(rows.where("kind = 'shape'").join(listed, "class", "left_semi").select(*rows.columns))
    kept = kept.where(F.col("place") <= most).select("kind", "class", "predicate", "n", "place", (F.col("all") > most).alias("truncated"))
    if labels is None:
        return kept.withColumn("label", F.lit(None).cast("string"))
    said = labels.groupBy("term").agg(F.min("label").alias("label"))
    term = F.when(F.col("kind") == "class", F.col("class")).otherwise(F.col("predicate"))
    return kept.withColumn("term", term).join(said, "term", "left").drop("term")
