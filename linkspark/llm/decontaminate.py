"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import _PLACE, mix, save, slices, word_hashes

#: Items in one index, a bound on what is broadcast; a larger benchmark is taken in slices of it.
ITEMS = 1024
#: Indexes that stand at once, and shingles of the benchmark that one pass over the texts looks for (32 MB).
WAVE, SHINGLES = 8, 4_000_000
#: Longest item text that an index takes, in characters of all its items.
CHARS = 8_000_000
#: Fingerprints within RADIUS are found for certain: of four 16-bit blocks one differs by RADIUS // 4 bits at most.
RADIUS, BLOCKS, WIDTH = 19, 4, 16
_BITS = np.arange(64, dtype=np.uint64)


def _runs(words: np.ndarray, n: int, size: int) -> np.ndarray:
    """Shingle hash at each word: of n words, or of the whole window where it has fewer."""
    k = min(n, size)
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        run += words[j : j + len(run)] * _PLACE[j]
    return mix(run) if size >= n else mix(run + np.uint64(size))


def _fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every `width` shingles in a row: each bit by the sign of its sum, repeats counted."""
    bits = ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    up = sums[width:] - sums[:-width] > 0
    return (up.astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def build(rows: list[tuple[int, str]], n: int = 5) -> dict:
    """Index of items (id, text): sizes, fingerprints, shingle counts, the set of all shingles, and for each block and
    value the items whose block is within RADIUS // BLOCKS bits. Items without words are left out."""
    ids, sizes, prints, counts = [], [], [], []
    for key, text in rows:
        words, _, _, _ = word_hashes(pa.array([text or ""]))
        if not len(words):
            continue
        run = _runs(words, n, len(words))
        ids.append(key)
        sizes.append(len(words))
        prints.append(_fingerprints(run, len(run))[0])
        counts.append(Counter(run.tolist()))
    near = [0]
    for k in range(1, RADIUS // BLOCKS + 1):
        near += [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), k)]
    near = np.array(near, np.uint64)
    prints = np.array(prints, np.uint64)
    tables = []
    for b in range(BLOCKS):
        own = (prints >> np.uint64(b * WIDTH)) & np.uint64(0xFFFF)
        value = (own[:, None] ^ near[None, :]).ravel().astype(np.int64)
        item = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
        order = np.argsort(value, kind="stable")
        tables.append((np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)), item[order]))
    shingles = np.unique(np.array([s for c in counts for s in c], np.uint64))
    by_size = {k: np.unique(np.array([s for c, size in zip(counts, sizes, strict=True) if size == k for s in c], np.uint64)) for k in set(sizes)}
    return {"by_size": by_size, "ids": ids, "sizes": np.array(sizes, np.int64), "prints": prints, "counts": counts, "tables": tables, "shingles": shingles}


def _near(index: dict, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs of one size whose fingerprints are within RADIUS, found by equal blocks of the index."""
    found = []
    for b, (starts, items) in enumerate(index["tables"]):
        value = ((prints >> np.uint64(b * WIDTH)) & np.uint64(0xFFFF)).astype(np.int64)
        low, n = starts[value], starts[value + 1] - starts[value]
        window = np.repeat(np.arange(len(prints)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        item = items[at]
        right = index["sizes"][item] == size
        window, item = window[right], item[right].astype(np.int64)
        close = _distance(prints[window], index["prints"][item]) <= RADIUS
        found.append(window[close] * len(index["prints"]) + item[close])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(index["prints"])), pairs % max(1, len(index["prints"]))


def _scan(index: dict, words: np.ndarray, runs: dict[int, np.ndarray], n: int, percent: int) -> dict[int, tuple[float, int]]:
    """For each item found in one text: its best window (similarity, first word). Windows that hold no shingle of an item
    of their size cannot reach the similarity and are passed over."""
    best: dict[int, tuple[float, int]] = {}
    places = {}
    for k, run in runs.items():
        some = np.flatnonzero(np.isin(run, index["shingles"]))
        places[k] = (some, run[some])
    for size, known in sorted(index["by_size"].items()):
        k = min(n, size)
        run, (some, held) = runs[k], places[k]
        width = size - k + 1
        if len(words) < size or not len(some):
            continue
        at = np.minimum(np.searchsorted(known, held), len(known) - 1)
        some = some[known[at] == held]
        if not len(some):
            continue
        mark = np.zeros(len(run), np.int64)
        mark[some] = 1
        hits = np.concatenate([[0], np.cumsum(mark)])
        starts = np.flatnonzero(hits[width:] > hits[:-width])
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1) if len(starts) else []:
            for low in range(int(part[0]), int(part[-1]) + 1, 4096):
                high = min(low + 4095, int(part[-1]))
                prints = _fingerprints(run[low : high + width], width)
                windows, items = _near(index, prints, size)
                for w, i in zip((windows + low).tolist(), items.tolist(), strict=True):
                    mine, his = Counter(run[w : w + width].tolist()), index["counts"][i]
                    both = sum(min(c, his[s]) for s, c in mine.items() if s in his)
                    likeness = both / (2 * width - both)
                    if 100 * both >= percent * (2 * width - both) and (i not in best or likeness > best[i][0]):
                        best[i] = (likeness, w)
    mine, his = len(words) - n + 1, index["sizes"] - n + 1
    if mine > 0 and n in runs and len(places[n][0]):  # a text shorter than an item is its one window
        long = np.flatnonzero((his > mine) & (100 * mine >= percent * his))
        if len(long):
            near = long[_distance(_fingerprints(runs[n], mine)[0], index["prints"][long]) <= RADIUS]
            held = Counter(runs[n].tolist())
            for i in near.tolist():
                both = sum(min(c, index["counts"][i][s]) for s, c in held.items() if s in index["counts"][i])
                if 100 * both >= percent * (int(his[i]) + mine - both):
                    best[i] = (both / (int(his[i]) + mine - both), 0)
    return best


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, similarity): for each document and each benchmark item that it holds,
    the best window, the first of several.

    An item of k words is held against every window of k words of the whole text (A-Z as a-z), or against the whole text
    where that has fewer words and could still be similar enough. Windows whose SimHash is
    within RADIUS bits of the item's are candidates: four blocks of an index find all of them. A candidate counts if its
    n-word shingles, weighted by how often they stand in the window and in the item, have a weighted Jaccard similarity
    of percent / 100 or more. A text or item of fewer than n words is one shingle; null, empty and shorter texts hold
    nothing. Repeated documents come back each; equal items each; rows with a null item id too.

    Doc_ids and item ids are whole numbers. A pass over the texts finds those that hold any shingle of the benchmark
    (SHINGLES of them at a time, so a benchmark of 40,000 items is one pass); only these are written and held against
    the indexes (ITEMS items and CHARS characters at most each), WAVE at a time. So what is broadcast is bounded whatever
    the benchmark, and corpus passes do not grow with the number of indexes. A single item longer than CHARS is an index of its
    own.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-size[0] // (ITEMS // 2)), -(-size[1] // (CHARS // 2)))
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = _candidates(own, items, n)
    out, wave = spark.createDataFrame([], schema), []
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r[0], r[1]) for r in some.collect()]  # a slice of the query set
        for at in range(0, len(rows), ITEMS):
            index = build(rows[at : at + ITEMS], n)
            if index["ids"]:
                wave.append(spark.sparkContext.broadcast(index))
                out = out.unionByName(own.mapInArrow(_scanner(wave[-1], n, percent), schema))
            if len(wave) == WAVE:
                out, _ = save(out)
                for index in wave:
                    index.destroy()
                wave = []
    return out


def _kinds(items: DataFrame, n: int) -> DataFrame:
    """Distinct (k, shingle) of all items: shingles of n words, or of a whole item of k < n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, firsts, _, _ = word_hashes(batch["text"])
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if b > a:
                    run = np.unique(_runs(words[a:b], n, b - a)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), min(n, b - a), np.int32)), pa.array(run)], ["k", "shingle"])

    return items.select("text").mapInArrow(run, "k int, shingle long").distinct()


def _candidates(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The rows of docs that hold a shingle of an item, written once."""
    spark = docs.sparkSession
    kinds, _ = save(_kinds(items, n))
    passes = max(1, -(-kinds.count() // (SHINGLES // 2)))
    out = None
    for part in range(passes):
        rows = kinds.where(F.pmod(F.xxhash64("shingle"), F.lit(passes)) == part).toPandas()  # SHINGLES / 2 on the mean
        known = {int(k): np.sort(g["shingle"].to_numpy(np.int64).view(np.uint64)) for k, g in rows.groupby("k")}
        found, _ = save(docs.mapInArrow(_holding(spark.sparkContext.broadcast(known), n), "doc_id long, text string"))
        if passes > 1:  # a row that several passes find is one candidate, a repeated row several
            found = found.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
        out = found if out is None else out.unionByName(found)
    if passes == 1:
        return out
    out = out.groupBy("doc_id", "text").agg(F.max("n").alias("n"))
    return out.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id", "text")


def _holding(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(1 << 22, bool) for k in shared.value}
        for k, known in shared.value.items():
            tables[k][(known >> np.uint64(42)).astype(np.int64)] = True
        for batch in slices(batches, "text"):
            words, firsts, _, _ = word_hashes(batch["text"])
            some = np.zeros(batch.num_rows, bool)
            for k, known in shared.value.items():
                table, run = tables[k], _runs(words, n, k)
                at = np.flatnonzero(table[(run >> np.uint64(42)).astype(np.int64)])
                near = np.minimum(np.searchsorted(known, run[at]), len(known) - 1)
                at = at[known[near] == run[at]]
                doc = np.searchsorted(firsts, at, "right") - 1
                some[doc[at + k <= firsts[doc + 1]]] = True
            if some.any():
                yield batch.select(["doc_id", "text"]).filter(pa.array(some))

    return run


def _scanner(shared, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        table = np.zeros(1 << 22, bool)
        table[(index["shingles"] >> np.uint64(42)).astype(np.int64)] = True
        kinds = sorted({min(n, s) for s in index["sizes"].tolist()})
        for batch in slices(batches, "text"):
            words, firsts, _, _ = word_hashes(batch["text"])
            runs, some = {}, np.zeros(len(firsts) - 1, bool)
            for k in kinds:
                runs[k] = _runs(words, n, k)
                at = np.flatnonzero(table[(runs[k] >> np.uint64(42)).astype(np.int64)])
                near = np.minimum(np.searchsorted(index["shingles"], runs[k][at]), len(index["shingles"]) - 1)
                at = at[index["shingles"][near] == runs[k][at]]
                some[np.unique(np.searchsorted(firsts, at, "right")) - 1] = True
            rows = []
            for d in np.flatnonzero(some).tolist():
                a, b = int(firsts[d]), int(firsts[d + 1])
                found = _scan(index, words[a:b], {k: r[a : max(a, b - k + 1)] for k, r in runs.items()}, n, percent)
                rows += [(batch["doc_id"][d].as_py(), index["ids"][i], w, min(int(index["sizes"][i]), b - a), s) for i, (s, w) in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.float64(),), strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Rows of docs that hold no benchmark item, with the columns of docs. A null doc_id is kept."""
    found = hits(docs, benchmark, n, percent).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontaminate(spark, sf_dir):
    """Every benchmark item found in every document."""
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
