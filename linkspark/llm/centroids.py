"""Centroid clustering: each vector's nearest centroid by a tournament of bisector tests in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import save

#: Whole numbers beyond this are taken as this, so that a squared distance of 64 components fits 63 bits.
MOST = 2**27


class Bisectors:
    """Normals and thresholds of all pairs of centroids: of a and a later b, b is nearer to x where
    2 (b - a) . x > |b|^2 - |a|^2. All whole numbers; a tie is a zero."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        square = (centroids * centroids).sum(1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of each row's nearest centroid. The best so far meets each later centroid once: k - 1 tests of a sign,
        and a zero keeps the smaller number."""
        best = np.zeros(len(x), np.int64)
        for b in range(1, len(self.centroids)):
            for a in np.unique(best).tolist():
                who = np.flatnonzero(best == a)
                # x and normals are whole numbers of at most 2^27 and 2^29: 64 products stay within 2^62
                best[who[x[who] @ self.normals[a, b] > self.thresholds[a, b]]] = b
        return best

    def distances(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        away = x - self.centroids[own]
        return (away * away).sum(1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def _sums(centroids: np.ndarray, d: int):
    """Sums and counts of each cluster's vectors, as far as one task has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Bisectors(centroids)
        k = len(centroids)
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch["x"], d)
            own = pairs.nearest(x)
            count += np.bincount(own, minlength=k)
            for c in np.unique(own).tolist():
                total[c] += x[own == c].sum(0)
        who = np.repeat(np.flatnonzero(count), d)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(who) // d)), pa.array(total[count > 0].reshape(-1)), pa.array(count[who])], ["cluster", "place", "total", "n"])

    return run


def _assigned(centroids: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Bisectors(centroids)
        for batch in batches:
            x = _matrix(batch["x"], d)
            own = pairs.nearest(x)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(own.astype(np.int32)), pa.array(pairs.distances(x, own))], ["vec_id", "cluster", "distance"])

    return run


def whole_numbers(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; beyond MOST either way it is MOST."""
    return F.transform(vectors, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(scale)), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly d components (64 at most), none null or not finite, are kept and turned to whole numbers
    floor(scale * x). The k kept rows of the smallest sha256 of seed and vec_id are the first centroids (fewer rows: as
    many centroids; equal hashes, which are repeats of a vec_id, by components; null vec_ids last). Each round gives
    every vector to its nearest centroid, of equal ones the smaller number, and moves each centroid that has vectors to
    the floor of their exact mean; a last assignment gives the result. All is exact: sums are decimals, means whole
    divisions, and assignments signs of whole numbers.

    A round is one pass: each task sums its own vectors by cluster and hands on k * d sums, whatever the clusters'
    sizes, so a cluster of all rows is no hot key. The driver holds k centroids of d numbers; a task holds normals of all
    k * k pairs (8 k k d bytes: meant for up to some hundred centroids). Components beyond 2^27 after scaling count as
    2^27. Repeats are vectors of their own; a null vec_id is kept; an empty table gives no rows; other columns are not
    read. A sum of distances that does not fit a long is null.
    """
    if d > 64:
        raise ValueError("more than 64 components don't fit whole numbers of 63 bits")
    spark = embeddings.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    v = F.col("embedding")
    sound = (F.size(v) == d) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept, _ = save(embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(v, scale).cast("array<int>").alias("x")))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids, d), "cluster int, place int, total long, n long")
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k * d rows at most
            moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break  # every later round would be the same
        centroids = moved
    rows, _ = save(kept.mapInArrow(_assigned(centroids, d), "vec_id long, cluster int, distance long"))
    of = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    fits = lambda n: n if n < 2**63 else None
    names = [(c, fits(n), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(of.items())]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(about), "cluster").withColumn("inertia", F.lit(fits(sum(of.values()))).cast("long"))  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark, sf_dir):
    """Cluster, distance and inertia of every sound vector after ten rounds with eight centroids."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(rounds: int = 10) -> str:
    """The same clustering by plain distances, a pair of common tables for each round."""
    steps = [
        """kept as (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0)""",
        """rows as materialized (select row_number() over () as r, vec_id, x from kept)""",
        """cells as materialized (select r, unnest(range(64)) as i, unnest(x) as v from rows)""",
        """c0 as materialized (select k, unnest(range(64)) as i, unnest(x) as v from (select row_number() over (order by sha256('3:' || vec_id::varchar), x) - 1 as k, x from kept qualify k < 8))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (select r, arg_min(k, (d, k)) as k, min(d) as d from (
  select cells.r, c.k, sum((cells.v - c.v) * (cells.v - c.v))::bigint as d from cells join c{n} c using (i) group by all) group by r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} as materialized (select c.k, c.i, coalesce(m.v, c.v) as v from c{n} c left join (
  select k, i, ((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*))::bigint as v from cells join a{n} using (r) group by all) m using (k, i))""")
    return f"""with {", ".join(steps)},
digests as (select k, sha256(string_agg(v::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by k)
select rows.vec_id, a.k::integer as cluster, a.d as distance, sum(a.d) over (partition by a.k)::bigint as cluster_inertia,
  sum(a.d) over ()::bigint as inertia, centroid_sha256 from rows join a{rounds} a using (r) join digests using (k)"""


OP12_SQL = _sql()
