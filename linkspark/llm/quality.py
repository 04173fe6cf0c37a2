"""Quality classifier: compression under zstandard dictionaries built from good and from bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import crc_mod, slices
from linkspark.llm.labelled import sample

BLOCK = 2048
LEVEL = 3


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _sizes(raw: bytes, packers: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes that the text takes under each dictionary, over all of its blocks."""
    blocks = _blocks(raw)
    return [sum(len(p.compress(b)) for b in blocks) for p in packers]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; plain content where there is too little text to train on."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(blocks) or b"-" * 8)[-size:]


def _packers(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _feature(raw: bytes, packers: list[zstandard.ZstdCompressor]) -> float:
    """Bytes that the good dictionary saves against the bad one, for each byte of the text; 0 for an empty text."""
    good, bad = _sizes(raw, packers)
    return (bad - good) / max(len(raw), 1)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, for the prior of the whole table instead of the sample's."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return 0.0, math.log((n1 + 1) / (n0 + 1))
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    scale = float(np.std(x)) or 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, np.array([(g * z).sum() + a, g.sum()]))
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 2500, chars: int = 8_000_000, size: int = 65_536) -> dict:
    """Dictionaries from two thirds of a bounded sample of labelled texts, the curve from the other third.

    With no labelled text of one class the model says the share of label 1 for every text.
    """
    frame, share = sample(docs, labels, "quality", learn, rows, chars)
    raw = [t.encode() for t in frame["text"]]
    y = frame["label"].to_numpy(np.int64)
    held = np.arange(len(y)) % 3 == 2
    dictionaries = [_dictionary([t for t, v, h in zip(raw, y, held, strict=True) if v == k and not h], size) for k in (1, 0)]
    prior = min(max(share, 0.01), 0.99)
    packers = _packers(dictionaries)
    x = np.array([_feature(t, packers) for t, h in zip(raw, held, strict=True) if h], float)
    slope, intercept = _logistic(x, y[held], prior)
    if slope <= 0:
        slope, intercept = 0.0, math.log(prior / (1 - prior))
    return {"good": dictionaries[0], "bad": dictionaries[1], "slope": float(slope), "intercept": float(intercept)}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: the chance (0 to 1) that the whole text is good.

    Null and empty texts take the curve at a difference of 0. Every other column stays as it is; a column that has the
    name of `out` is replaced. One narrow pass over the texts: no shuffle. The dictionaries are bounded (64 KB each).
    """
    row = "linkspark_score"
    schema = docs.drop(out).schema.add(row, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers([model["good"], model["bad"]])
        for batch in slices(batches, text):
            x = [model["slope"] * _feature((t or "").encode(), packers) + model["intercept"] for t in batch[text].to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(x), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, row])

    return docs.drop(out).mapInArrow(run, schema).withColumnRenamed(row, out)


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column | None = None, least: float = 0.3) -> DataFrame:
    """Rows of docs whose score is at least `least`, with the columns of docs."""
    model = fit(docs, labels, F.lit(True) if learn is None else learn)
    name = "linkspark_quality"
    return score(docs, model, out=name).where(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality_classifier(spark, sf_dir):
    """Score and decision of every document; labels only from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
