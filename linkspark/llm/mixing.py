"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over permuted blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import WORD, save, words_in

#: Bits of a document's key that name its block among its source's, and its part within the block.
BITS = 12
#: Bins of sources that the upper tree splits on the driver; each bin's tree is a task's.
BINS = 1024
MOST = 3
_KEY, _SIZE, _BLOCK, _DRAWS, _ROW = "linkspark_key", "linkspark_size", "linkspark_block", "linkspark_draws", "linkspark_row"


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _same(a: str, b: str, *more: str) -> Column:
    """Join condition: one source (null is one too), and equal columns."""
    on = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    return reduce(lambda x, c: x & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}")), more, on)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the place of each row in its source's permuted order (63 bits of a hash of the whole row) and its block:
    the upper bits of that place. Equal rows have one place."""
    cells = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    key = F.shiftrightunsigned(_hash(seed, *cells), 1)
    return docs.withColumn(_KEY, key).withColumn(_BLOCK, F.shiftright(_KEY, 63 - BITS))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    sized has source and size. Sources stand by code point, null last; weights repeat in that order. All words are
    shared by weight; a target stops at `most` times its source's size and the excess goes to the others by weight.
    The level that all open sources share rises until no further source stops: a sum over the table of sources for each
    step. Sources without words get 0. Sources are ranked by ranges, so they may be many.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered, _ = save(by_source.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(2**33 - 1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each range
    rank = ((F.col("before") + place) % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank)
    sources = ordered.withColumn("part", part).join(F.broadcast(ranges), "part").select("source", "source_size", weight.alias("weight"))
    cap = most * F.col("source_size")
    total, share = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / share if share else 0.0), None
    while level != before:
        full = cap < level * F.col("weight")
        used, taken = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(full, F.col("weight")))).first()
        before, level = level, ((total - (used or 0)) / (share - (taken or 0)) if share and share > (taken or 0) else level)
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))


def _draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` draws without return are good: hypergeometric; its normal limit beyond numpy's range."""
    if not good or not take:
        return 0
    if not bad:
        return take
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    n = good + bad
    mean = take * (good / n)
    spread = (mean * (bad / n) * ((n - take) / (n - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), take - bad, 0), good, take))


def split(quotas: np.ndarray, shards: int, seed: int | list[int], shares: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), from a binary tree over the shards.

    A node holds exact block counts by source and halves its shards; the left side takes its share of the blocks by a
    multivariate-hypergeometric draw, the right side the rest. Sums over the shards are the quotas; shard totals differ
    by one block at most, or are `shares` where a tree above has set them. The generator of a node depends on the seed
    and the node alone.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    seed = [seed] if isinstance(seed, int) else seed

    def node(first: int, n: int, counts: np.ndarray) -> None:
        if n == 1:
            out[first] = counts
            return
        half, total = n // 2, int(counts.sum())
        take = total * half // n if shares is None else int(shares[first : first + half].sum())
        rest, left = counts.copy(), np.zeros_like(counts)
        rng, others = np.random.default_rng([*seed, first, n]), total
        for i in np.flatnonzero(counts).tolist():  # conditional draws, source by source
            c = int(counts[i])
            others -= c
            got = _draw(rng, c, others, take)
            left[i], rest[i] = got, c - got
            take -= got
        node(first, half, left)
        node(first + half, n - half, rest)

    node(0, shards, quotas.astype(np.int64))
    return out


def _leaves(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, ends): where the draws of each shard end among a source's permuted draws. counts: source, n.

    Sources fall into BINS bins; the driver splits the bins' totals (BINS numbers), and a task for each bin splits its
    sources within what the bin gives each shard, which is the same distribution.
    """
    binned = counts.withColumn("bin", F.pmod(F.xxhash64("source"), F.lit(BINS)).cast("int"))
    totals = np.zeros(BINS, np.int64)
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        totals[r["bin"]] = r["n"]
    upper = split(totals, shards, seed)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("source", "ascending")]))
        own = table["bin"][0].as_py()
        lower = split(table["n"].to_numpy(), shards, [seed, own + 1], upper[:, own])
        return pa.table({"source": table["source"], "ends": pa.array(np.cumsum(lower, axis=0).T.tolist(), pa.list_(pa.int64()))})

    schema = T.StructType([counts.schema["source"], T.StructField("ends", T.ArrayType(T.LongType()))])
    return binned.groupBy("bin").applyInArrow(run, schema)


def _draws(sized: DataFrame, goal: DataFrame, shards: int, seed: int, most: int) -> DataFrame:
    """(source, block, draws): for each block that a shard draws, an array of (pass, shard, last, room), `most` at most.

    sized: source, key, block and size of every document. A source's quota is the number of permuted blocks, pass by
    pass, that reach its target; the tree deals them to the shards. Of the one block that the target cuts, documents
    before the key `last` are drawn whole, and `room` words are left for the document with that key (null: all are drawn).
    The cut is found through the parts of its block, so no task sorts a block.
    """
    sized = sized.where(F.col(_SIZE) > 0).select("source", F.col(_KEY).alias("key"), F.col(_BLOCK).alias("block"), F.col(_SIZE).alias("size"))
    upto = lambda order, *by: F.coalesce(F.sum("words").over(Window.partitionBy("source", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn("before", upto("block"))
    goal = goal.select("source", "source_size", F.round("target").cast("long").alias("goal"))
    quota = blocks.alias("b").join(goal.alias("g"), _same("b", "g")).select("b.*", "goal", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    quota = quota.withColumn("room", F.least("words", F.col("goal") - F.col("pass") * F.col("source_size") - F.col("before"))).where("room > 0")
    quota, _ = save(quota.select("source", "block", "pass", "words", "room"))
    ends = _leaves(quota.groupBy("source").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    turn = F.row_number().over(Window.partitionBy("source").orderBy(_hash(seed + 1, F.col("block"), F.col("pass")), "pass", "block"))
    dealt = quota.withColumn("turn", turn).alias("q").join(ends.alias("e"), _same("q", "e")).select("q.*", F.size(F.filter("ends", lambda e: e < F.col("turn"))).alias("shard")).where(F.col("shard") < shards)

    cut = quota.where("room < words").select("source", "block", "pass", "room")  # one for each source at most
    part = F.shiftright("key", 63 - 2 * BITS)
    inside = sized.alias("s").join(cut.alias("c"), _same("s", "c", "block")).select("s.*", "c.pass", "c.room").withColumn("part", part)
    parts = inside.groupBy("source", "block", "pass", "room", "part").agg(F.sum("size").alias("words")).withColumn("before", upto("part", "pass"))
    parts = parts.where("before < room and room <= before + words").select("source", "part", F.col("before").alias("passed"))
    edge = inside.alias("s").join(parts.alias("c"), _same("s", "c", "part")).groupBy("s.source", "s.block", "s.pass", "s.room", "passed", "key").agg(F.sum("size").alias("words"))
    edge = edge.withColumn("before", F.col("passed") + upto("key", "pass")).where("before < room and room <= before + words")
    edge = edge.select("source", "block", "pass", F.col("key").alias("last"), (F.col("room") - F.col("before")).alias("room"))

    dealt = dealt.drop("room").alias("d").join(edge.alias("e"), _same("d", "e", "block", "pass"), "left")
    one = F.struct("d.pass", F.col("shard").cast("int").alias("shard"), "e.last", "e.room")
    draws, _ = save(dealt.groupBy("d.source", "d.block").agg(F.sort_array(F.collect_list(one)).alias(_DRAWS)))
    return draws


def _drawn(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """rows with the array of their block's draws, null where there are none."""
    return rows.alias("r").join(draws.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col(f"r.{_BLOCK}") == F.col("d.block")), "left").select("r.*", _DRAWS)


def _whole() -> Column:
    """Draws that take all of a document."""
    return F.filter(_DRAWS, lambda d: d["last"].isNull() | (F.col(_KEY) < d["last"]))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows that a target cuts, with edge (their draw) and part (words taken). Rows that are equal in all are one row and
    its number of copies, told apart by counting: the room is filled copy by copy."""
    hit = rows.where(F.exists(_DRAWS, lambda d: d["last"] == F.col(_KEY)))
    own = [c for c in hit.columns if c not in ("source", _KEY)]
    hit = hit.groupBy("source", _KEY).agg(*[F.first(c).alias(c) for c in own], F.count(F.lit(1)).alias("copies"))
    step = 1_000_000
    hit = hit.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step))).alias("lot"))
    hit = hit.select("*", F.explode(F.sequence(F.col("lot") * step, F.least(F.col("lot") * step + step, F.col("copies")) - 1)).alias("nth"))
    hit = hit.withColumn("edge", F.filter(_DRAWS, lambda d: d["last"] == F.col(_KEY))[0])
    return hit.withColumn("part", F.greatest(F.lit(0), F.least(F.col(_SIZE), F.col("edge.room") - F.col("nth") * F.col(_SIZE))))


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, text: str = "text") -> DataFrame:
    """The mix: a row for each time that a document is drawn, with shard, place (order within the shard), the columns
    of docs, words (its size) and taken (the words of this drawing: all of them, or the first of them for the one
    document of a source at which its target ends).

    A source's documents are permuted by a hash of the row and fall into 2**BITS blocks. Its quota of blocks, in whole
    passes and then the first blocks of the permuted order, is split down the tree, and each shard draws the blocks that
    its leaf has of the source's permuted draws: every draw goes to one shard. Rows of a shard are shuffled by a hash,
    not collected.

    Null text has no words; documents without words are never drawn. A null source is a source. Null and repeated ids
    change nothing: ids are not used. Rows equal in every column are drawn alike and share the cut copy by copy. Columns
    of docs keep their names; where one is called shard, place, words or taken, the mix's own is linkspark_<name>. An empty
    table gives an empty mix. The same input gives the same mix.
    """
    keyed = _keyed(docs, seed)
    sized, _ = save(keyed.select("source", _KEY, _BLOCK, words_in(F.col(f"`{text}`")).alias(_SIZE)))
    draws = _draws(sized, targets(sized.select("source", F.col(_SIZE).alias("size")), weights, most), shards, seed, most)
    packed = keyed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW), "source", _KEY, _BLOCK)
    rows = _drawn(packed, draws).where(F.size(_DRAWS) > 0).withColumn(_SIZE, words_in(F.col(f"{_ROW}.`{text}`"))).where(F.col(_SIZE) > 0)
    place = _hash(seed + 2, F.col(_KEY), F.col("d.pass"))
    name = {n: f"linkspark_{n}" if n in docs.columns else n for n in ("shard", "place", "words", "taken")}
    shown = lambda taken: (F.col("d.shard").alias(name["shard"]), place.alias(name["place"]), F.col(_SIZE).alias(name["words"]), taken.alias(name["taken"]))
    whole = rows.select(_ROW, _KEY, _SIZE, F.explode(_whole()).alias("d")).select(*shown(F.col(_SIZE)), f"{_ROW}.*")
    cut = _cut(rows).where("part > 0").select(_ROW, _KEY, _SIZE, "part", F.col("edge").alias("d")).select(*shown(F.col("part")), f"{_ROW}.*")
    order = [name["shard"], name["place"], *[f"`{c}`" for c in docs.columns], name["words"], name["taken"]]
    return whole.unionByName(cut).select(*order)


def mixed_text(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of mix() with each text cut to its taken words; rows of a shard stand together, in shuffled order."""
    t = F.col(f"`{text}`")
    head = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    cut = mixed.withColumn(text, F.when(F.col("taken") == F.col("words"), t).otherwise(head))
    return cut.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place")


def op2_mix_to_targets(spark, sf_dir, shards: int = 16, seed: int = 7):
    """Words that the mix takes of each document, with its source's size and target and the shards that draw it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, _ = save(_keyed(docs, seed).select("doc_id", "source", _KEY, _BLOCK, words_in(F.col("text")).alias(_SIZE)))
    goal = targets(rows.select("source", F.col(_SIZE).alias("size")))
    rows = _drawn(rows, _draws(rows, goal, shards, seed, MOST))
    shards_of = lambda draws: F.transform(draws, lambda d: d["shard"])
    whole = F.when(F.col(_SIZE) > 0, F.coalesce(_whole(), F.array().cast(dict(rows.dtypes)[_DRAWS]))).otherwise(F.array().cast(dict(rows.dtypes)[_DRAWS]))
    at_edge = F.coalesce(F.exists(_DRAWS, lambda d: d["last"] == F.col(_KEY)), F.lit(False))
    plain = rows.where(~at_edge).select("doc_id", "source", _SIZE, (F.size(whole) * F.col(_SIZE)).alias("taken"), shards_of(whole).alias("shards"))
    with_part = F.when(F.col("part") > 0, F.concat(shards_of(whole), F.array("edge.shard"))).otherwise(shards_of(whole))
    cut = _cut(rows).select("doc_id", "source", _SIZE, (F.size(whole) * F.col(_SIZE) + F.col("part")).alias("taken"), with_part.alias("shards"))
    out = plain.unionByName(cut).alias("s").join(goal.alias("g"), _same("s", "g"))
    return out.select("doc_id", F.col(_SIZE).alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"), F.sort_array("shards").alias("shards"))
