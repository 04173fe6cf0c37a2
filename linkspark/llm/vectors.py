"""Embedding near-duplicates: a subspace pigeonhole join over rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import drop, save
from linkspark.llm.components import components, local_roots

#: Dimensions of a block, and points of a cell on each side of one comparison.
WIDTH = 8
CHUNK = 2048
#: Pairs that are looked at together: by a block's rounded numbers, and by whole vectors.
ROUGH, PAIRS = 500_000, 50_000
#: Steps to the unit of a block's rounded numbers, where a block has one unit of squared length on the mean.
STEPS = 16_384


def rotate(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Rows turned by two rounds of random signs and a Hadamard transform, padded with zeros to a power of two.

    Only sums and differences in a fixed order: a vector turns into the same numbers in every task.
    """
    n = max(WIDTH, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (2, n))
    for k in range(2):
        y = y * signs[k]
        step = 1
        while step < n:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), n)
            step *= 2
        y = y / np.sqrt(n)
    return y


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _budget(least: float, width: int, n: int) -> float:
    """A block's share of the squared distance that the cosine allows, with room for rounding."""
    return (2 - 2 * least) * width / n * (1 + 1e-9) + 1e-12


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance in each block, row by row, added in a fixed order."""
    d = (x - y).reshape(len(x), -1, WIDTH)
    out = d[:, :, 0] * d[:, :, 0]
    for k in range(1, WIDTH):
        out += d[:, :, k] * d[:, :, k]
    return out


def _spread(least: float, grid: int):
    """For each vector and block: the home cell, and a probe for every cell that the block's ball touches, with the
    block's numbers in 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                dims = pc.list_value_length(part["embedding"]).to_numpy(zero_copy_only=False)
                for d in np.unique(dims):
                    some = part.filter(pa.array(dims == d))
                    y = rotate(_unit(_matrix(some["embedding"], d)))
                    n, label = y.shape[1], some["label"].to_numpy().view(np.uint64)
                    radius = np.sqrt(_budget(least, WIDTH, n))
                    side = 2.5 * radius
                    short = np.clip(np.rint(y * (np.sqrt(n / WIDTH) * STEPS)), -32_767, 32_767).astype(np.int16)  # clipping brings no two farther apart
                    rows, cells, home, numbers = [], [], [], []
                    for block in range(n // WIDTH):
                        own = slice(block * WIDTH, (block + 1) * WIDTH)
                        z = y[:, block * WIDTH : block * WIDTH + grid]
                        cell = np.floor(z / side).astype(np.int64)
                        low, high = z / side - cell, 1 - (z / side - cell)
                        reach = [(np.zeros(grid, np.int64), np.arange(len(y)), np.zeros(len(y)))]
                        for g in range(grid):  # cells one step away, as long as the ball comes there
                            more = []
                            for step, who, gap in reach:
                                more.append((step, who, gap))
                                for sign, edge in ((-1, low), (1, high)):
                                    far = gap + (edge[who, g] * side) ** 2
                                    near = far <= radius * radius
                                    if near.any():
                                        moved = step.copy()
                                        moved[g] = sign
                                        more.append((moved, who[near], far[near]))
                            reach = more
                        for step, who, _ in reach:
                            rows.append(who)
                            cells.append(_cell_id(cell[who] + step, block, int(d), label[who]))
                            home.append(np.full(len(who), not step.any()))
                            numbers.append(short[who, own])
                    who = pa.array(np.concatenate(rows))
                    z = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.arange(0, 2 * WIDTH * (len(who) + 1), 2 * WIDTH, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(np.concatenate(numbers)))])
                    yield pa.RecordBatch.from_arrays([some["id"].take(who), some["class"].take(who), pa.array(np.concatenate(cells)), pa.array(np.concatenate(home)), z], ["id", "class", "cell", "home", "z"])

    return run


def _cell_id(cell: np.ndarray, block: int, dims: int, label: np.ndarray) -> np.ndarray:
    """A long for a cell: its block in the low byte, a hash of block, place, vector length and label above."""
    h = label ^ np.uint64(dims * 1_000_003 + block)
    for g in range(cell.shape[1]):
        h = (h ^ cell[:, g].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h << np.uint64(8)) | np.uint64(block)).view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins. Rows come in order of the columns `by`; a group is bounded."""
    held: list[pa.RecordBatch] = []

    def whole(rows: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(rows).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in by:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        begin = np.flatnonzero(new)
        if last:
            return table, begin, []
        return table.slice(0, begin[-1]), begin[:-1], table.slice(begin[-1]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * CHUNK:
                table, begin, held = whole(held, False)
                if len(begin):
                    yield table, begin
    if held:
        table, begin, _ = whole(held, True)
        yield table, begin


def _pairs(table: pa.Table, begin: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (near, far) of each group that meet, the smaller id first, about `most` pairs at once."""
    ids = table["id"].to_numpy()
    group = np.zeros(table.num_rows, np.int64)
    group[begin[1:]] = 1
    group = np.cumsum(group)
    near, far = np.flatnonzero(table["near"].to_numpy() == 1), np.flatnonzero(table["far"].to_numpy() == 1)
    first = np.searchsorted(group[far], np.arange(len(begin) + 1))
    n = np.diff(first)[group[near]]
    upto = np.cumsum(n)
    low = 0
    while low < len(near):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        k = n[low:high]
        u = np.repeat(near[low:high], k)
        v = far[np.repeat(first[group[near[low:high]]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        ok = ids[u] < ids[v]
        yield u[ok], v[ok]
        low = high


def _close(least: float):
    """The rows of each group that are within the budget of another by their block's rounded numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _groups(batches, ("cell", "i", "j")):
            z = np.frombuffer(table["z"].combine_chunks().cast(pa.large_binary()).buffers()[2], np.int16)
            offset = table["z"].combine_chunks().offset
            z = z[offset * WIDTH : (offset + table.num_rows) * WIDTH].reshape(-1, WIDTH).astype(np.int32)
            budget, error = _budget(least, 1, 1), 1 / STEPS  # error of a difference of two rounded numbers
            limit = (budget + 2 * np.sqrt(budget * WIDTH) * error + WIDTH * error * error) * STEPS * STEPS
            mark = np.zeros(table.num_rows, bool)
            for u, v in _pairs(table, begin, ROUGH):
                d = z[u] - z[v]
                ok = (d * d).sum(1) <= limit
                mark[u[ok]] = mark[v[ok]] = True
            yield from table.select(["id", "class", "cell", "i", "j", "near", "far"]).filter(pa.array(mark)).to_batches()

    return run


def _meet(least: float):
    """For each vector of a group its links found there and the smallest vector linked; on whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in _groups(batches, ("label", "cell", "i", "j")):
            dims = pc.list_value_length(whole["embedding"]).to_numpy()
            for d in np.unique(dims):
                table = whole.filter(pa.array(dims == d)).combine_chunks()
                new = np.zeros(table.num_rows, bool)
                new[:1] = True
                for c in ("label", "cell", "i", "j"):
                    v = table[c].to_numpy()
                    new[1:] |= v[1:] != v[:-1]
                x = _unit(_matrix(table["embedding"].combine_chunks(), d))
                y = rotate(x)
                budget, block = _budget(least, WIDTH, y.shape[1]), table["cell"].to_numpy() & 255
                ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
                links, ends = np.zeros(len(ids), np.int64), [[], []]
                for u, v in _pairs(table, np.flatnonzero(new), PAIRS):
                    inside = _gaps(y[u], y[v]) <= budget
                    ok = np.flatnonzero(inside[np.arange(len(u)), block[u]] & (inside.argmax(1) == block[u]))  # a pair counts in the first block that finds it
                    u, v = u[ok], v[ok]
                    same = (x[u] * x[v]).sum(1) >= least
                    u, v = u[same], v[same]
                    links += np.bincount(u, copies[v], len(ids)).astype(np.int64) + np.bincount(v, copies[u], len(ids)).astype(np.int64)
                    root = local_roots(len(ids), u, v)
                    some = np.flatnonzero(root != np.arange(len(ids)))
                    ends[0].append(some)
                    ends[1].append(root[some])
                if not links.any():
                    continue
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                root = local_roots(len(ids), place[np.concatenate(ends[0])], place[np.concatenate(ends[1])])
                found = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found]), pa.array(ids[order][root[place[found]]])], ["id", "links", "root"])

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98, by: str | None = "label", grid: int | None = None) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors of one label (column `by`; None compares all) link where their cosine, in double precision, is at least
    `least`. Unit vectors are turned by a random rotation and cut into blocks of 8 dimensions; of two vectors within the
    squared distance 2 - 2 * least, some block is within its proportional share. Each block is range-joined over a grid
    on its first dimensions: a vector stands in its home cell and is sent to each cell that the block's ball touches. A
    pair is verified on the whole vectors, once: in the first block whose budget it meets.

    Probes carry the block's numbers alone, rounded to 16 bits, and tell which vectors of a cell come within the budget
    of another, with room for the rounding; whole vectors travel for those only. Equal vectors of a label are one class
    and count as linked with each other; links are counted with class sizes and never listed, and a task hands on a
    spanning forest only. A crowded cell is cut into chunks of 2,048 vectors that meet chunk by chunk. The grid takes 2
    of a block's dimensions up to 18,432 vectors to a label, one more for every three times as many, 8 at most
    (grid=None), so that cells stay near one chunk where the data spread; results are the same on any grid. Null
    labels, null, empty or zero vectors, and vectors with null or non-finite components link with nothing; so do vectors
    of different lengths. Rows that repeat a vec_id are one vector with each of its embeddings; it comes back once for
    each row. Vec_ids are whole numbers; a null one is kept, unlinked.
    """
    spark = embeddings.sparkSession
    label = F.lit(0) if by is None else F.col(by)
    own = embeddings.select(F.col("vec_id"), label.cast("string").alias("label"), F.col("embedding"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = own.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # -0.0 and 0.0 are one value of a class
    tidy = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(_element(embeddings))).otherwise(v))
    own = own.withColumn("class", F.when(F.col("sound"), F.sha2(F.concat_ws(",", "label", F.array_join(F.transform(tidy, lambda v: v.cast("string")), ",")), 256)))
    members, _ = save(own.select("vec_id", "label", "class", F.when(F.col("sound"), F.col("embedding")).alias("embedding")))
    classes = members.where("class is not null").groupBy("class", "label").agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes, _ = save(classes)
    if grid is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        grid = int(np.clip(np.ceil(np.log(max(most, 1) / CHUNK) / np.log(3)), 2, WIDTH))
    # nodes are numbered by their class's smallest id; several classes may hold one vec_id, so probes name both
    short = F.conv(F.substring("class", 1, 15), 16, 10).cast("long")
    named = classes.withColumn("class", short)
    spread = named.select("id", "class", F.xxhash64("label").alias("label"), "embedding").mapInArrow(_spread(least, grid), "id long, class long, cell long, home boolean, z binary")
    spread, probes = save(spread)
    crowd = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    crowd = crowd.select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    met = spread.join(crowd, "cell")
    mine = F.pmod(F.xxhash64("id", "class"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # a home row meets every chunk of probes; each row is also a probe of its own chunk, against every chunk of homes
    as_home = F.when(F.col("home"), F.transform(every, lambda c: F.struct(mine.alias("i"), c.alias("j"), F.lit(1).alias("near"), F.lit(0).alias("far"))))
    as_probe = F.transform(every, lambda c: F.struct(c.alias("i"), mine.alias("j"), F.lit(0).alias("near"), F.lit(1).alias("far")))
    none = F.array().cast("array<struct<i:int,j:int,near:int,far:int>>")
    roles = F.explode(F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").cast("int").alias("near"), F.lit(1).alias("far")))).otherwise(F.concat(F.coalesce(as_home, none), as_probe)))
    met = met.select("id", "class", "cell", "z", roles.alias("r")).select("id", "class", "cell", "z", "r.*")
    close = met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_close(least), "id long, class long, cell long, i int, j int, near int, far int")
    close, _ = save(close)
    drop(spark, probes)
    met = close.join(named.select("id", "class", F.xxhash64("label").alias("label"), "copies", "embedding"), ["id", "class"])
    met = met.select("id", "label", "cell", "i", "j", "near", "far", "copies", "embedding").repartition("label", "cell", "i", "j").sortWithinPartitions("label", "cell", "i", "j")
    found = met.mapInArrow(_meet(least), "id long, links long, root long")
    found, _ = save(found.groupBy("id", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # one vec_id in several classes joins them
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(members.where("class is not null").join(classes.select("class", "id"), "class").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    named = classes.select("class", "id", "copies").join(links, "id", "left").join(parts, "id", "left")
    out = members.select("vec_id", "class").join(named, "class", "left")
    linked = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    out = out.select("vec_id", linked.cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _element(df: DataFrame) -> str:
    return dict(df.dtypes)["embedding"].removeprefix("array<").removesuffix(">")


def op1_embedding_near_dedup(spark, sf_dir):
    """Links, component and decision for every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
