"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import drop, save, shingle_hashes, slices, word_hashes
from linkspark.llm.components import components

#: Shingles that are counted exactly and put last in every prefix order: a bound on what is broadcast (4 MB).
HEAVY = 262_144
#: Sets whose prefixes may hold a token that was taken for a rare one; and that share of all prefix rows, 1 in HEAVY.
CROWD = 1000
#: Shingles that a task counts at once.
TALLY = 4_000_000
#: A document may ask for so many shared prefix tokens.
MATCHES = 8
#: What verifying a candidate costs, in prefix rows.
VERIFY = 50
#: Longs of a node's token signature.
SIGNATURE = 4
SALTS = 61


def _sets(batches, column: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the input with the sorted distinct shingle hashes of each text."""
    for batch in slices(batches, column):
        words, firsts, _, _ = word_hashes(batch[column])
        yield batch, [np.unique(s) for s in shingle_hashes(words, firsts, n)]


def _node(shingles: np.ndarray) -> bytes:
    """128-bit hash of a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _repeated(nodes: list[bytes], counts: list[int]) -> pa.Array:
    """Each node as often as its count says."""
    data = np.repeat(np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 16), counts, axis=0)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 16 * (len(data) + 1), 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _digest(n: int, tally: int):
    """Size and hash of each document's set; and, with how many documents of a stretch hold them, its frequent shingles."""

    def out(ids, sizes, nodes, tokens, seen) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, sizes, nodes, tokens, seen), kinds, strict=True)], ["doc_id", "n_shingles", "node", "token", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, docs = [], 0, 0

        def frequent() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= max(4, docs // 2048)
            k = int(often.sum())
            none = pa.nulls(k, pa.int64())
            return out(none, none, [None] * k, tokens[often].view(np.int64), seen[often].astype(np.int64))

        for batch, sets in _sets(batches, "text", n):
            none = pa.nulls(len(sets), pa.int64())
            yield out(batch["doc_id"], [len(s) for s in sets], [_node(s) if len(s) else None for s in sets], none, none)
            held += sets
            total, docs = total + sum(map(len, sets)), docs + len(sets)
            if total > tally:
                yield frequent()
                held, total, docs = [], 0, 0
        if total:
            yield frequent()

    return run


def _need(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set that it links to."""
    return (percent * n + 99) // 100


def _prefixes(n: int, percent: int, heavy):
    """Rows (token, salt, node, n, matches, central) of each distinct set: its prefix, as long as its matches ask for, and
    how many documents hold one of its shingles on the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = heavy.value
        done: set[bytes] = set()
        for _, sets in _sets(batches, "text", n):
            cols, nodes, lengths = [[], [], [], [], []], [], []
            for s in sets:
                if not len(s) or (node := _node(s)) in done:
                    continue
                done.add(node)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    count = np.where(tokens[at] == s, seen[at], 0)
                    order = np.argsort(count, kind="stable")  # rare first, then by hash: one order for all documents
                    s, count = s[order], count[order]
                else:
                    count = np.zeros(len(s), np.int64)
                need = _need(len(s), percent)
                spare = len(s) - need
                most = min(MATCHES, need)
                cost = np.cumsum(count)[spare : spare + most]  # documents met by the prefix for 1, 2, ... matches
                asked = np.arange(1, most + 1)
                matches = int(np.argmin(spare + asked + cost + VERIFY * cost / asked)) + 1
                k = spare + matches
                nodes.append(node)
                lengths.append(k)
                cols[0].append(s[:k].view(np.int64))
                cols[1].append(np.where(count[:k] > 0, node[0] % SALTS + 1, 0).astype(np.int32))
                cols[2].append(np.full(k, len(s), np.int32))
                cols[3].append(np.full(k, matches, np.int32))
                cols[4].append(np.full(k, count.sum() // len(s)))
            if nodes:
                token, salt, size, asked, central = (pa.array(np.concatenate(c)) for c in cols)
                yield pa.RecordBatch.from_arrays([token, salt, _repeated(nodes, lengths), size, asked, central], ["token", "salt", "node", "n", "matches", "central"])

    return run


def _texts(n: int):
    """Text of each node that is asked for: the texts of the chosen documents that have that node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, "text", n):
            right = [len(s) > 0 and _node(s) == k for s, k in zip(sets, batch["node"].to_pylist(), strict=True)]
            yield batch.select(["node", "text"]).filter(pa.array(right, pa.bool_()))

    return run


def _verify(n: int, percent: int):
    """The pairs of a batch whose whole shingle sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, mine = None, None
        for batch, sets in _sets(batches, "text", n):
            keep = []
            for a, text, s in zip(batch["pivot"].to_pylist(), batch["pivot_text"], sets, strict=True):
                if a != pivot:
                    words, firsts, _, _ = word_hashes(pa.array([text.as_py()]))
                    pivot, mine = a, np.unique(shingle_hashes(words, firsts, n)[0])
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                both = int((mine[at] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(mine) - both))
            found = batch.select(["pivot", "node"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, ["a", "b"])

    return run


def _links(pairs: DataFrame, reps: DataFrame, own: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (pivot, node) that link. Only the texts of nodes that stand in pairs are fetched, once each; a hot pivot is a
    skewed join, which Spark splits; no pair stands with another."""
    pairs, old = save(pairs.select("pivot", "node"))
    asked = pairs.select("node").union(pairs.select("pivot")).distinct().join(reps, "node")
    texts, gone = save(own.join(asked, "doc_id").mapInArrow(_texts(n), "node binary, text string").dropDuplicates(["node"]))
    pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    both = pairs.join(texts, "node").join(pivots, "pivot").select("pivot", "node", "pivot_text", "text")
    found, _ = save(both.mapInArrow(_verify(n, percent), "a binary, b binary"))
    drop(pairs.sparkSession, old)
    drop(pairs.sparkSession, gone)
    return found


def _may_link(shared, x: str, y: str, percent: int):
    """Exact filter on a pair's sizes, matches and shared prefix tokens.

    The pair shares at least the smaller number of matches, its sizes are near enough, and its shared prefix tokens
    with what stands behind the prefix of one of the two reach the overlap that their sizes ask for.
    """
    a, b, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.matches"), F.col(f"{y}.matches")
    overlap = F.ceil(percent * (a + b) / (100 + percent) - F.lit(1e-9))
    behind = [F.ceil(percent * size / 100 - F.lit(1e-9)) - m for size, m in ((a, i), (b, j))]
    return (shared >= F.least(i, j)) & (shared + F.greatest(*behind) >= overlap) & (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _relabel(rows: DataFrame, links: DataFrame, reps: DataFrame) -> DataFrame:
    """rows with the component of each node: the smallest document that links reach."""
    parts, _ = save(components(_numbered(links, reps)).join(reps.withColumnRenamed("doc_id", "id"), "id").select("node", F.col("component").alias("part")))
    return rows.join(parts, "node", "left").withColumn("component", F.coalesce("part", "component")).drop("part")


def _numbered(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between nodes as links between their smallest documents."""
    ends = lambda c: reps.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id"))
    return links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _crossing(rows: DataFrame, turn: int) -> DataFrame:
    """Rows of the tokens that stand in more than one component, with up to four of the token's nodes: the most central
    one of each of four classes, dealt by a hash that changes with the turn. Most near copies link to a central document
    if they link to any. Maxima are made on the map side, so a common token is a few rows."""
    ends = [F.min("component").alias("one"), F.max("component").alias("two")]
    node = F.struct("central", "node", "n", "matches", "component")
    ends += [F.max(F.when(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4)) == k, node)).alias(f"end{k}") for k in range(4)]
    ends = rows.groupBy("token").agg(*ends).where("one < two")
    ends = ends.select("token", F.array_compact(F.array(*[f"end{k}" for k in range(4)])).alias("ends"))
    return rows.join(ends, "token")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of two components with the number of prefix tokens that they share.

    Before its tokens are matched, a pair is passed over that cannot reach its overlap with the tokens left of each node:
    there are `alive` of them, and those whose bit in a signature of 256 bits the other node lacks are not shared."""
    node = Window.partitionBy("node")
    bit = F.pmod(F.xxhash64("token"), F.lit(64 * SIGNATURE))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    marks = {f"sig{k}": F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == k, one)).over(node), F.lit(0)) for k in range(SIGNATURE)}
    rows = rows.withColumns({"alive": F.count(F.lit(1)).over(node)} | marks)

    def held(x: str, y: str):
        lacking = [F.bit_count(F.col(f"{x}.sig{k}").bitwiseAND(F.bitwise_not(f"{y}.sig{k}"))) for k in range(SIGNATURE)]
        return F.col(f"{x}.alive") - sum(lacking[1:], lacking[0])

    a, b = rows.alias("a"), rows.alias("b")
    fits = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    fits = fits & _may_link(F.least("a.alive", "b.alive"), "a", "b", percent) & _may_link(F.least(held("a", "b"), held("b", "a")), "a", "b", percent)
    pairs = a.join(b, fits).groupBy(F.col("a.node").alias("pivot"), F.col("b.node").alias("node"))
    return pairs.agg(F.count(F.lit(1)).alias("shared"), F.first(F.struct("a.n", "a.matches")).alias("x"), F.first(F.struct("b.n", "b.matches")).alias("y"))


def _best(rows: DataFrame, percent: int, tries: int = 4) -> DataFrame:
    """For each node up to `tries` pivots of other components: those with which it shares most prefix tokens, of all that
    may link to it. (Which pivots are tried decides what is left for the last join, not what is found.)"""
    pivots = F.explode(F.array_distinct(F.filter("ends", lambda e: e["component"] != F.col("component"))))
    met = rows.select("node", F.struct("n", "matches").alias("own"), pivots.alias("pivot"))
    counted = met.groupBy("node", F.col("pivot.node").alias("to")).agg(F.count(F.lit(1)).alias("shared"), F.first("own").alias("own"), F.first("pivot").alias("pivot"))
    counted = counted.where(_may_link(F.col("shared"), "own", "pivot", percent))
    first = Window.partitionBy("node").orderBy(F.desc("shared"), "to")
    return counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= tries).select("node", F.col("to").alias("pivot"))


def _prefix_rows(own: DataFrame, heavy, n: int, percent: int, rounds: int = 4) -> DataFrame:
    """Prefix rows (token, salt, node, n, matches, central) of all sets, without tokens that one set alone has.

    heavy (token, seen) is what counting by stretches found, which misses a token that stands in a few documents of each
    stretch. Such a token comes first in its documents' prefixes, so it is seen there: tokens that more than CROWD sets,
    and more than one in HEAVY of all rows, have in their prefixes are added with that count, and prefixes are made anew.
    So no token keeps a larger share unsalted; any order gives the same links."""
    spark = own.sparkSession
    for left in range(rounds, 0, -1):
        tokens = heavy["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        shared = spark.sparkContext.broadcast((tokens[order], heavy["seen"].to_numpy(np.int64)[order]))
        rows = own.select("text").mapInArrow(_prefixes(n, percent, shared), "token long, salt int, node binary, n int, matches int, central long")
        here = Window.partitionBy("token", "salt")
        rows = rows.withColumns({"low": F.min("node").over(here), "high": F.max("node").over(here), "many": F.count(F.lit(1)).over(here)}).where("salt > 0 or low < high")
        rows, path = save(rows.drop("low", "high").dropDuplicates(["token", "salt", "node"]))
        share = max(CROWD, rows.count() // HEAVY)
        crowded = rows.where((F.col("salt") == 0) & (F.col("many") > share)).groupBy("token").agg(F.max("many").alias("seen"))
        found = crowded.orderBy(F.desc("seen"), "token").limit(HEAVY).toPandas()  # as heavy: 4 MB
        if found.empty or left == 1:
            return rows.drop("many")
        heavy = pd.concat([heavy, found]).nlargest(HEAVY, "seen")
        drop(spark, path)


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 75, turns: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links). members: a row for each row of docs (doc_id, n_shingles, node), node being the hash of its
    shingle set (null for none). nodes: each with its smallest document. links: (a, b), links between nodes that join all
    nodes which similar pairs join.

    Two sets link when 100 * shared >= percent * union. Shingles stand in one global order: those that many documents
    hold (counted over all documents, and again in the prefixes; HEAVY at most) last. Sets that link share at least m of the first
    size - ceil(percent * size / 100) + m shingles of each, so each document takes the m with the least estimated cost
    of candidates, and a pair has to share the smaller m of its two documents. Documents with equal sets are one node,
    met once.

    Pairs are never listed within a group. In each of a few turns every node is verified against a few nodes of other
    components, and only tokens that still stand in more than one component go on; what is left is joined pair by pair
    across components. A pair inside a component needs no link. Hot tokens are salted.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest, _ = save(own.mapInArrow(_digest(n, TALLY), "doc_id long, n_shingles long, node binary, token long, seen long"))
    members = digest.where("seen is null").select("doc_id", "n_shingles", "node")
    heavy = digest.where("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(HEAVY).toPandas()
    rows = _prefix_rows(own, heavy, n, percent)
    reps, _ = save(members.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    rows = rows.join(reps, "node").withColumnRenamed("doc_id", "component")
    links = None
    for turn in range(turns):
        found = _links(_best(_crossing(rows, turn), percent), reps, own, n, percent)
        links = found if links is None else links.unionByName(found)
        rows, _ = save(_crossing(_relabel(rows, links, reps), turn).drop("ends"))
    last = _links(_meeting(rows, percent).where(_may_link(F.col("shared"), "x", "y", percent)), reps, own, n, percent)
    return members, reps, links.unionByName(last)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (size of its set of n-word shingles), component_id (smallest
    doc_id that links reach), kept (it is that document).

    A-Z count as a-z; words are runs of other than blanks and the controls 9 to 13. A text of fewer than n words has
    its whole sequence as one shingle; null and empty texts have none and link with nothing. Shingles are compared by
    64-bit hashes, whole sets by 128-bit ones. Doc_ids are whole numbers. Rows that repeat a doc_id are one document with
    several sets: its components are one; the rows come back as often as they came. Rows with a null doc_id link with
    nothing and have a null component. An empty table gives no rows; other columns are left out.
    """
    members, nodes, links = jaccard_links(docs, n, percent)
    # sets that one document holds belong together; each node is named by its smallest document
    repeated = members.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("doc_id is not null and x <> y").select("doc_id")
    held = members.join(repeated, "doc_id", "left_semi").join(nodes.withColumnRenamed("doc_id", "first"), "node").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    parts = components(_numbered(links, nodes).unionByName(held))
    named, _ = save(nodes.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = members.join(named, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op4_ngram_jaccard(spark, sf_dir):
    """Set size and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d left join n on n.doc_id = d.doc_id join r on r.id = d.doc_id group by d.doc_id, n.n"""
