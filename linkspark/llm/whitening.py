"""Embedding whitening: blockwise QR of the centred rows, then singular values and vectors of what is left of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.bidiagonal import principal
from linkspark.llm.common import save

#: Entries beyond this are taken as this, so that whole numbers of any finite entry exist and are exact as doubles.
MOST = 2**52
#: Triangles that one task of a round puts together, and rows of one block.
FAN, BLOCK = 32, 8192


def whole_numbers(vectors: Column) -> Column:
    """floor(64 * c) of each entry, as longs."""
    return F.transform(vectors, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(64.0), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with 0."""
    column = batch["x"]
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(d: int):
    """Sums of a task's rows by dimension, in two halves so that none of them is beyond 63 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + b for t, h, b in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total])], ["place", "n", "total"])

    return run


class Centre:
    """Exact means of whole numbers: a whole part, taken off without rounding, and what is left, in [0, 1)."""

    def __init__(self, totals: list[int], n: int):
        self.n, self.totals = n, totals
        self.whole = np.array([t // n for t in totals], np.int64)
        self.rest = [t - int(w) * n for t, w in zip(totals, self.whole.tolist(), strict=True)]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None where it is beyond 63 bits."""
        away = x - self.whole
        most = int(np.abs(away).max(initial=0)) + 1
        if (self.n * most) ** 2 * max(x.shape[1], 1) < 2**63:
            off = self.n * away - np.array(self.rest, np.int64)
            return (off * off).sum(1).tolist()
        sums = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away.tolist()]
        return [s if s < 2**63 else None for s in sums]


def _triangle(rows: list[np.ndarray], width: int) -> np.ndarray:
    """R of the QR of all the rows."""
    return np.linalg.qr(np.concatenate(rows), mode="r") if rows else np.zeros((0, width))


def _triangles(of, width: int):
    """R of a task's rows, block by block: a block is put under the R so far and takes part in the next QR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            held.append(of(batch))
            waiting += batch.num_rows
            if waiting >= BLOCK:
                held, waiting = [_triangle(held, width)], 0
        r = _triangle(held, width)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.astype(np.float64).tobytes()])], ["part", "r"])

    return run


def _merged(width: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x).reshape(-1, width) for _, x in sorted(zip(table["part"].to_pylist(), table["r"].to_pylist(), strict=True))]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": [_triangle(rows, width).tobytes()]})

    return run


def triangle(rows: DataFrame, of, width: int) -> np.ndarray:
    """R (width columns) of the QR of all rows, `of` making a matrix of a record batch. Each task hands on one triangle;
    FAN of them meet in a task of the next round, until one is left (width * width numbers), which the driver gets."""
    parts, _ = save(rows.mapInArrow(_triangles(of, width), "part long, r binary"))
    n = parts.count()
    while n > 1:
        parts, _ = save(parts.withColumn("key", F.floor(F.col("part") / FAN).cast("long")).groupBy("key").applyInArrow(_merged(width), "part long, r binary"))
        n = parts.count()
    found = parts.first()
    return np.frombuffer(found["r"]).reshape(-1, width) if found else np.zeros((0, width))


def whitened(embeddings: DataFrame, most: int = 32) -> DataFrame:
    """One row for each sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or holds a null or non-finite entry is dropped. An entry c becomes x = floor(64 c) + 1000000.
    Components are the unit eigenvectors of the covariance (divisor n) of all x, by falling eigenvalue e, `most` at
    most; whitened is the centred vector on the component, over sqrt(e); explained is e over the trace. The covariance
    itself is never made: rows are centred and brought down to a triangle R by QR in blocks, task by task and round by
    round, R is made bidiagonal by Householder reflections, dqds finds its singular values, twisted factorisations its
    right vectors. deviation is exact, in whole numbers. identity_error is measured on the whitened rows themselves, by
    one more QR of them beside a column of ones (which centres them before anything is multiplied).

    One pass finds n and the sums, one the triangle, one measures, one writes; no row is shuffled. Tasks hold blocks of
    8,192 rows; driver and tasks hold d * d numbers, so d is that of embeddings, not of counts. Shorter vectors are
    filled up with c = 0 to the longest one's length. Entries beyond 2^46 count as 2^46. A component without variance
    (below rounding: fewer rows than dimensions, equal or constant dimensions) can't be scaled to one: whitened is null,
    explained 0, and identity_error leaves it out; with no variance at all explained is null. A deviation that does not
    fit a long is null. Repeats are vectors of their own, a null vec_id is kept, other columns are not read, an empty
    table gives no rows. Signs and digits can differ in the last places between runs on other partitions.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = F.col("embedding")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept, _ = save(embeddings.where(F.coalesce(v.isNotNull() & sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(v).alias("x")))
    d = kept.agg(F.max(F.size("x"))).first()[0]
    if not d:  # no rows, or no entries and so no components
        return spark.createDataFrame([], schema)
    sums = kept.mapInArrow(_sums(d), "place int, n long, total string").groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # d rows
    n = sums[0]["n"]
    centre = Centre([int(r["total"]) for r in sorted(sums, key=lambda r: r["place"])], n)
    squares, vectors = principal(triangle(kept, lambda b: centre.centred(_matrix(b, d)), d))
    values = squares / n
    k = min(most, d)
    alive = int((values[:k] > 0).sum())
    turn = vectors[:, :alive] / np.sqrt(values[:alive])
    r = triangle(kept, lambda b: np.hstack([np.ones((b.num_rows, 1)), centre.centred(_matrix(b, d)) @ turn]), 1 + alive)
    off = r[1:, 1:].T @ r[1:, 1:] / n - np.eye(alive)
    error = float(np.abs(off).max(initial=0.0))
    trace = float(values.sum())
    explained = [float(e) / trace if trace else None for e in values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            x = _matrix(batch, d)
            rows = len(x)
            w = np.zeros((rows, k))
            w[:, :alive] = centre.centred(x) @ turn
            none = np.zeros((rows, k), bool)
            none[:, alive:] = True
            at = pa.array(np.repeat(np.arange(rows), k))
            made = [
                batch["vec_id"].take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, np.int64)),
                pa.array(centre.deviations(x), pa.int64()).take(at),
                pa.array(w.reshape(-1), mask=none.reshape(-1)),
                pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), rows))),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(made, names)

    return kept.mapInArrow(run, schema)


def op13_embedding_whitening(spark, sf_dir):
    """The first 32 whitened components of every sound vector."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
