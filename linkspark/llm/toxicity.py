"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import crc_mod, mix, slices
from linkspark.llm.labelled import sample

BITS = 18
GRAMS = (3, 4, 5)
_STEP = np.uint64(0x9DDFEA08EB382D69)


def grams(text: str) -> np.ndarray:
    """Ids of all character n-grams of the lower-cased text between two blanks, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    run, out = codes, []
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        run = run[: len(codes) - n + 1] * _STEP + codes[n - 1 :]
        if n in GRAMS:
            out.append(mix(run + np.uint64(n)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 2000, chars: int = 4_000_000, least: int = 5, sure: float = 4.0, steps: int = 120) -> dict:
    """Log-count ratios and logistic weights from a bounded sample of labelled texts.

    Each feature is the presence of an n-gram, times log((1 + toxic texts with it) / (1 + clean texts with it)) after
    both counts are brought to shares; ratios within `sure` standard deviations of none are left out, so that chance
    n-grams of a few texts carry no weight. Equal texts of the sample count once. With no labelled text of one class every text gets the share of label 1.
    """
    frame, share = sample(docs, labels, "toxic", learn, rows, chars)
    frame = frame.drop_duplicates(["label", "text"], ignore_index=True)
    y = frame["label"].to_numpy(float)
    prior, size = min(max(share, 0.001), 0.999), 1 << BITS
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return {"weights": np.zeros(size, np.float32), "bias": base}
    ids = [np.unique(grams(t)).astype(np.int32) for t in frame["text"]]
    n = np.array([len(i) for i in ids])
    flat, row = np.concatenate(ids), np.repeat(np.arange(len(y), dtype=np.int32), n)
    del ids
    toxic = np.bincount(flat, y[row], size)
    every = np.bincount(flat, minlength=size)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((every - toxic + 1) / (n0 + 2))
    spread = np.sqrt(1 / (toxic + 1) + 1 / (every - toxic + 1))
    ratio[(every < least) | (np.abs(ratio) < sure * spread)] = 0
    some = ratio[flat] != 0
    flat, row = flat[some], row[some]
    value = (ratio[flat]).astype(np.float32)
    weight = np.where(y == 1, 0.3 / n1, 0.7 / n0)  # fixed shares, whatever the sample holds of each class
    w, bias, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, steps + 1):  # Adam on the whole sample
        margin = np.bincount(row, w[flat] * value, len(y)) + bias
        slip = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        g = np.bincount(flat, slip[row] * value, size) + 1e-4 * w
        gb = slip.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.02
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-10)
    return {"weights": (w * ratio).astype(np.float32), "bias": float(bias)}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: 0 to 1, higher for text that is likelier toxic.

    Whole texts; null counts as empty, and an empty text takes the bias with the n-grams of two blanks. Other columns
    stay; a column named as `out` is replaced. One narrow pass; the model has 2**18 weights whatever the data.
    """
    row = "linkspark_score"
    schema = docs.drop(out).schema.add(row, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value["weights"], shared.value["bias"]
        last = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches, text):
            got = []
            for t in batch[text].to_pylist():
                ids = grams(t or "")
                at = np.arange(len(ids))
                last[ids] = at  # each n-gram counts once: where it stood last
                got.append(float(weights[ids[last[ids] == at]].sum(dtype=np.float64)) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(got), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, row])

    return docs.drop(out).mapInArrow(run, schema).withColumnRenamed(row, out)


def op6_toxicity(spark, sf_dir):
    """Score and decision of every document; labels only from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
