"""Declarative mappings: tables to entities and quads."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions.values import function, percent_encode, text, to_double

TYPE = "rdf:type"
QUAD = ["g", "s", "p", "o", "kind", "dt", "lang", "o_num"]
#: Keys (8 bytes each) that are sent to all tasks at most; more are joined by a shuffle.
FEW = 200_000
#: Quads of one bucket of subjects.
ROWS = 500_000


@dataclass(frozen=True)
class Property:
    """One property of a map: exactly one of column, constant, template (an IRI) or function over columns."""

    predicate: str
    column: str | None = None
    constant: str | None = None
    template: str | None = None
    function: str | None = None
    columns: tuple[str, ...] = ()
    args: tuple = ()
    datatype: str | None = None
    language: str | None = None
    iri: bool = False


@dataclass(frozen=True)
class Map:
    subject: str
    classes: tuple[str, ...] = ()
    properties: tuple[Property, ...] = field(default_factory=tuple)


def iri(template: str, whole: frozenset[str] = frozenset()) -> Column:
    """Subject or link: {column} parts percent-encoded; null where any part is empty. whole: columns of whole numbers,
    which need no encoding and are empty only where they are null."""
    parts = re.split(r"\{([^{}]+)\}", template)
    names = [n for n in parts[1::2] if n not in whole]
    cell = lambda p: F.col(f"`{p}`").cast("string") if p in whole else percent_encode(F.col(f"`{p}`"))
    made = F.concat(*[cell(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return reduce(lambda out, n: F.when(text(F.col(f"`{n}`")) != "", out), names, made)


def subject_of(source: DataFrame, spec: Map) -> Column:
    """The subject that a map gives to each row, null for none."""
    return iri(spec.subject, _whole(source))


def _whole(df: DataFrame) -> frozenset[str]:
    return frozenset(n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint"))


#: Functions that give an array of objects.
LISTS = ("json_array", "json_pluck", "split", "tokens", "projects")


def _object(p: Property, whole: frozenset[str]) -> Column:
    """Object text, null or empty for none; of a list function an array of different ones."""
    if p.constant is not None:
        return F.lit(p.constant)
    if p.template is not None:
        return iri(p.template, whole)
    if p.function is None:
        return text(F.col(f"`{p.column}`"))
    value = function(p.function)(*[F.col(f"`{c}`") for c in (p.columns or (p.column,))], *p.args)
    # a list function has null for no values; null here would take the other properties of the row with it
    return F.coalesce(F.array_distinct(value), F.array().cast("array<string>")) if p.function in LISTS else value


def quads(source: DataFrame, spec: Map, graph: str, only: tuple[str, ...] | None = None, distinct: bool = True) -> DataFrame:
    """Quads of one map, as a set. One explode per row: the source is read once whatever the number of properties.

    only: predicates that are asked for; others are not made and their columns not read (a filter behind the explode
    cannot reach the scan). distinct=False leaves repeated quads in, for a caller who makes a set of several maps.
    """
    rows = several(source, (spec,), graph, only)
    return rows.dropDuplicates(QUAD[:-1]) if distinct else rows


def several(source: DataFrame, specs: tuple[Map, ...], graph: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Quads of several maps over one source, of one explode a row; no row gives a quad of one map twice."""
    whole = _whole(source)
    subjects = [f"__s{i}" for i in range(len(specs))]
    single: list[Column] = []
    lists: list[Column] = []
    for spec, name in zip(specs, subjects):
        constants = [Property(TYPE, constant=c, iri=True) for c in dict.fromkeys(spec.classes)]
        by: dict[str, list[tuple[Property, Column]]] = {}
        for p in (*constants, *spec.properties):
            if only is None or p.predicate in only:
                by.setdefault(p.predicate, []).append((p, _entries(p, name, whole)))
        for made in by.values():
            if len(made) == 1 or all(p in constants for p, _ in made):
                for p, e in made:
                    (lists if p.function in LISTS else single).append(e)
            else:  # properties of one predicate can say the same
                lists.append(F.array_distinct(F.concat(*[e if p.function in LISTS else F.array(e) for p, e in made])))
    none = F.array().cast("array<struct<s:string,p:string,o:string,kind:string,dt:string,lang:string>>")
    made = F.concat(*([F.array(*single)] if single else []), *lists) if single or lists else none
    # the array is a column of its own, so that what its parts share is computed once; the explode is an outer one, for
    # which Spark adds no filter that would make every array twice
    rows = source.select("*", *[iri(spec.subject, whole).alias(n) for spec, n in zip(specs, subjects)]).select(made.alias("e")).select(F.explode_outer("e").alias("e"))
    rows = rows.where("e.s is not null and e.o <> ''").select(F.lit(graph).alias("g"), "e.*")
    return rows.withColumn("o_num", F.when((F.col("kind") == "literal") & F.col("dt").isin("xsd:integer", "xsd:double", "xsd:decimal"), to_double(F.col("o")))).select(*QUAD)


def _entries(p: Property, subject: str, whole: frozenset[str]) -> Column:
    """Entry of a property; of a list function an array of entries."""
    kind = "iri" if p.template is not None or p.iri else "literal"

    def entry(o: Column) -> Column:
        return F.struct(F.col(subject).alias("s"), F.lit(p.predicate).alias("p"), o.alias("o"), F.lit(kind).alias("kind"), F.lit(p.datatype or "").alias("dt"), F.lit(p.language or "").alias("lang"))

    made = _object(p, whole)
    return F.transform(made, entry) if p.function in LISTS else entry(made)


def keyed_quads(source: DataFrame, key: Column, graph: str, *specs: Map) -> DataFrame:
    """Quads of maps over one source as one set, where rows of different keys have no subject in common, and the maps no
    quad. As quads(), but what is shuffled is a hash of each key; quads themselves are for the rows alone whose hash comes
    again."""
    return keyed_set(source, key, lambda rows: several(rows, specs, graph))


def keyed_set(source: DataFrame, key: Column, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(source) as a set. make gives quads of each row, none twice, and rows of different keys none in common."""
    return keyed_parts(source, key, make, lambda rows: make(rows).dropDuplicates(QUAD[:-1]))


def keyed_parts(source: DataFrame, key: Column, once: Callable[[DataFrame], DataFrame], often: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """once(rows whose key no other row has) and often(the others). Hashes of keys are compared, so that often may get a
    few rows more; where no hash comes again, once gets the source as it is."""
    again = repeated(source.select(F.xxhash64(key).alias("__key")))
    if again is None:
        return once(source)
    rows = source.withColumn("__key", F.xxhash64(key))
    part = lambda how: rows.join(again, "__key", how).drop("__key")
    return once(part("left_anti")).unionByName(often(part("left_semi")))


def repeated(keys: DataFrame) -> DataFrame | None:
    """Hashes (__key) that several rows have, each once, to be joined with; None where there are none."""
    from linkspark.operators.graph import cut

    again = cut(keys.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"))
    n = again.count()
    return None if n == 0 else F.broadcast(again) if n <= FEW else again.hint("merge")


def by_predicate(*sources: tuple[DataFrame, Map, int | None]) -> Callable[[str], DataFrame]:
    """A function that gives (s, p, o) of one predicate as a set, made by the maps alone that have it, of its columns alone.
    sources: a table, its map and into how many parts its rows are dealt by subject, where subjects are many (None: they
    are few, and made a set before they move). What one map alone says with a predicate lies by subject then."""

    def ask(predicate: str) -> DataFrame:
        made = []
        for source, spec, parts in sources:
            if predicate in {p.predicate for p in spec.properties} or (predicate == TYPE and spec.classes):
                rows = quads(source, spec, "", (predicate,), distinct=False).select("s", "o")
                made.append((rows.repartition(parts, "s") if parts else rows).distinct())
        if not made:
            source, spec, _ = sources[0]
            made = [quads(source, spec, "", (), distinct=False).select("s", "o").where(F.lit(False))]
        return (made[0] if len(made) == 1 else reduce(DataFrame.unionByName, made).distinct()).select("s", F.lit(predicate).alias("p"), "o")

    return ask


def all_quads(*parts: DataFrame) -> DataFrame:
    """Union of several maps' quads as one set: maps may mint the same subject. Parts may hold repeated quads."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["g", "s", "p", "o", "kind", "dt", "lang"])


def stored(q: DataFrame, name: str, path: str, buckets: int | None = None, rows: int = 0) -> DataFrame:
    """Quads as a table of the session's catalog, with its files at path: a folder a predicate, so that questions about
    some predicates read those alone, and buckets of subjects (as many as shuffle partitions unless given), so that
    grouping and joining by subject move nothing. q is made a set on the way, in its bucket; it is written once, then
    asked often. rows: about how many there are, so that a bucket, which one task sorts, has at most ROWS of them."""
    buckets = buckets or _buckets(q.sparkSession, rows)
    return _saved(_bucket_set(q, buckets), name, path, buckets)


def stored_maps(sources: list[tuple[DataFrame, Map, str]], name: str, path: str, rows: int = 0) -> DataFrame:
    """As stored(), of the quads of maps, each with its table and a graph of its own. Rows move to the bucket of their
    subject before their quads are made, in its order; quads move, and are compared, of those subjects alone that come
    again."""
    graphs = [g for _, _, g in sources]
    if len(set(graphs)) < len(graphs):
        raise ValueError("maps of one graph can give the same quads")
    buckets = _buckets(sources[0][0].sparkSession, rows)
    held = []
    for source, spec, graph in sources:
        subject = subject_of(source, spec)
        made = lambda rows: quads(rows, spec, graph, distinct=False)  # noqa: B023, E731
        placed = lambda rows: rows.repartition(buckets, subject).withColumn("__at", subject).sortWithinPartitions("__at")  # noqa: B023, E731
        held.append(keyed_parts(source, subject, lambda rows: made(placed(rows)), lambda rows: _bucket_set(made(rows), buckets)))  # noqa: B023
    return _saved(reduce(DataFrame.unionByName, held), name, path, buckets)


def _buckets(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _bucket_set(q: DataFrame, buckets: int) -> DataFrame:
    return q.repartition(buckets, "s").dropDuplicates(QUAD[:-1])  # a task writes one bucket of each predicate


def _saved(q: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    q.write.partitionBy("p").bucketBy(buckets, "s").sortBy("s").option("path", path).saveAsTable(name)
    return q.sparkSession.table(name)


def parent_links(child: DataFrame, spec: Map, predicate: str, parent: DataFrame, parent_spec: Map, on: list[tuple[str, str]]) -> DataFrame:
    """(s, p, o): links from a map's subjects to another map's, where columns of the two sources are equal. Rows without a
    partner or a subject give none; repeated links are one."""
    left = child.select(iri(spec.subject).alias("s"), *[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(on)])
    right = parent.select(iri(parent_spec.subject).alias("o"), *[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)])
    return left.join(right, [f"k{i}" for i in range(len(on))]).where("s is not null and o is not null").select("s", F.lit(predicate).alias("p"), "o").distinct()


def expand_curie(token: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local as an IRI; <iri> unwrapped; null for an unknown prefix."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    base = F.try_element_at(table, F.substring_index(token, ":", 1))
    return F.when(token.rlike("^<.*>$"), F.regexp_extract(token, "^<(.*)>$", 1)).when(token.contains(":"), F.concat(base, F.regexp_extract(token, "^[^:]*:(.*)$", 1)))


def compress_iri(value: Column, prefixes: dict[str, str]) -> Column:
    """CURIE by the longest namespace whose remainder is one clean segment; else null."""
    out = F.lit(None).cast("string")
    for prefix, base in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        rest = F.substr(value, F.lit(len(base) + 1))
        out = F.when(value.startswith(base) & rest.rlike(r"^[A-Za-z0-9_.-]+$"), F.concat(F.lit(prefix + ":"), rest)).otherwise(out)
    return out


def infer_terms(q: DataFrame) -> DataFrame:
    """(predicate, domain, range): the class of the subjects and of the targets where there is exactly one."""
    types = q.where(F.col("p") == TYPE).select(F.col("s").alias("who"), F.col("o").alias("class"))
    uses = q.where(F.col("p") != TYPE)
    one = lambda df, name: df.groupBy("p").agg(F.min("class").alias("a"), F.max("class").alias("b")).select(F.col("p").alias("predicate"), F.when(F.col("a") == F.col("b"), F.col("a")).alias(name))
    domain = one(uses.join(types, uses.s == types.who), "domain")
    reach = one(uses.where("kind = 'iri'").join(types, F.col("o") == types.who), "range")
    return domain.join(reach, "predicate", "full_outer")


def to_ntriples(q: DataFrame) -> DataFrame:
    """Lines of N-Triples; subjects that begin with _: and objects of the kind blank are blank nodes."""
    from linkspark.functions.values import nt_escape

    literal = F.concat(F.lit('"'), nt_escape(F.col("o")), F.lit('"'), F.when(F.col("lang") != "", F.concat(F.lit("@"), F.col("lang"))).when(F.col("dt") != "", F.concat(F.lit("^^<"), F.col("dt"), F.lit(">"))).otherwise(""))
    o = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).when(F.col("kind") == "blank", F.col("o")).otherwise(literal)
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return q.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))
