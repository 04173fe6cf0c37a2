"""Suffix-array dedup: repeated byte strings across documents, by external induced sorting of shards of shared text."""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import _BYTE, _STEP, mix, text_bytes
from linkspark.llm.induced import mapped, sorted_suffixes

#: A string of SPAN bytes that also starts in an earlier document is removed. Its anchor is the least hash of GRAM bytes.
SPAN, GRAM = 50, 24
#: Windows that share an anchor in a row and travel together: bits of one mask.
RUN = 32
#: Runs whose texts a shard copies at once.
RUNS = 1 << 16
#: Bytes that are hashed at once: a bound on the arrays of 8 bytes a place.
STRETCH = 1 << 18
#: Bytes of text to a block and to a shard of anchors; a document counts as PER_DOC bytes more.
BYTES, PER_DOC = 1 << 22, 256
_ALL = np.where(_BYTE == 0, np.arange(256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(0x9E3779B97F4A7C15), _BYTE)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    p = int(_STEP)
    power = lambda k: np.uint64(pow(p, k, 1 << 64))
    h = _ALL[data]
    for k in (1, 2, 4):
        h = h[:-k] * power(k) + h[k:]
    h16 = h[:-8] * power(8) + h[8:]
    return mix(h16[:-8] * power(8) + h[16:])


def _least(data: np.ndarray) -> np.ndarray:
    """Anchor of the window from each place: the least of the hashes of its parts."""
    least, width, k = _grams(data), SPAN - GRAM + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    return np.minimum(least[: len(least) - (width - k)], least[width - k :]) if width > k else least


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first window, number of windows, anchor, document (all by place). Taken
    STRETCH bytes at a time; a run ends where a stretch does."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none.astype(np.uint64), none)]
    for low in range(0, max(0, len(data) - SPAN + 1), STRETCH):
        anchor = _least(data[low : low + STRETCH + SPAN - 1])
        start = np.arange(low, low + len(anchor))
        doc = np.searchsorted(ends, start, "right") - 1
        whole = np.flatnonzero(start + SPAN <= ends[doc + 1])  # windows that lie within their document
        start, doc, anchor = start[whole], doc[whole], anchor[whole]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(heads, append=len(start))
        if len(size) and size.max() > RUN:  # long runs in periodic text are cut
            pieces = -(-size // RUN)
            part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            heads = np.repeat(heads, pieces) + part * RUN
            size = np.minimum(np.repeat(size, pieces) - part * RUN, RUN)
        out.append((start[heads], size, anchor[heads], doc[heads]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mix(anchor ^ np.uint64(0x51ED270B)) % np.uint64(shards)).astype(np.int64)


def _dealt(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings what goes to one shard together, the shards that occur, and where each begins (and the last ends)."""
    order = np.argsort(shard, kind="stable")
    shards, edges = np.unique(shard[order], return_index=True)
    return order, shards, np.append(edges, len(order))


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"shard": pa.int64(), "block": pa.int64()}
    names = names.split()
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols, strict=True)})


def _sorted_docs(table: pa.Table, text: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a block, by id; their bytes, their ends and their ids (null stands last)."""
    order = np.lexsort((table["linkspark_hash"].to_numpy(), table["linkspark_id"].to_numpy()))
    table = table.take(pa.array(order))
    data, ends = text_bytes(table[text].combine_chunks().cast(pa.large_string()) if table.num_rows else pa.array([], pa.string()))
    return table, data, ends, table["linkspark_id"].to_numpy()


def _contents(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run; starts ascend. Taken STRETCH bytes at a time."""
    out = np.zeros(len(start), np.uint64)
    n = min(len(data), STRETCH + RUN + SPAN) + 1
    power, back = np.full(n, _STEP, np.uint64), np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    edges = np.searchsorted(start, np.arange(0, len(data) + STRETCH, STRETCH))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            piece = data[k * STRETCH : (k + 1) * STRETCH + RUN + SPAN]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_ALL[piece] * power[: len(piece)], out=total[1:])
            first, own = start[a:b] - k * STRETCH, size[a:b]
            out[a:b] = mix((total[first + own + SPAN - 1] - total[first]) * back[first] + own.astype(np.uint64))
    return out


def _alike(data: np.ndarray, n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run the first one with the same bytes. Runs meet by a hash and are compared byte by byte. data: n bytes
    and 96 spare ones; starts ascend."""
    _, head, inverse = np.unique(_contents(data[:n], start, size), return_index=True, return_inverse=True)
    one = head[inverse]
    words = np.ndarray((len(data) - 8,), np.uint64, buffer=data.data, strides=(1,))
    own = np.flatnonzero(one != np.arange(len(one)))
    end = size[own] + SPAN - 9  # where the last eight bytes begin
    same = size[own] == size[one[own]]
    for k in range(0, RUN + SPAN - 1, 8):
        at = np.minimum(k, end)
        same &= words[start[own] + at] == words[start[one[own]] + at]
    other: dict[bytes, int] = {}
    for i in own[~same].tolist():
        one[i] = other.setdefault(data[start[i] : start[i] + size[i] + SPAN - 1].tobytes(), i)
    return one


def _spare(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(96, np.uint8)])


def _anchors(shards: int, text: str):
    """The distinct anchors of a block for each shard, as 32 bits (a chance match only lets more runs travel)."""

    def run(table: pa.Table) -> pa.Table:
        block = table["linkspark_block"][0].as_py()
        table, data, ends, ids = _sorted_docs(table, text)
        _, _, anchor, doc = _runs(data, ends)
        keys, inverse = np.unique(anchor, return_inverse=True)
        owner = ids[doc]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, owner)
        np.maximum.at(high, inverse, owner)
        order, some, edges = _dealt(_shard(keys, shards))
        codes, several = keys[order].astype(np.uint32), (low < high)[order]
        rows = [(s, block, codes[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for s, a, b in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return _table(rows, "shard block keys several")

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Which anchors of each block stand in more than one document, as bits."""
    keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table["several"].to_pylist(), keys, strict=True)])
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    yes = (count[inverse] > 1) | (several > 0)
    rows, at = [], 0
    for s, b, k in zip(table["shard"].to_pylist(), table["block"].to_pylist(), keys, strict=True):
        rows.append((s, b, np.packbits(yes[at : at + len(k)]).tobytes()))
        at += len(k)
    return _table(rows, "shard block bits")


def _gather(shards: int, text: str):
    """The distinct shared runs of a block with their bytes, for the shard of their anchor; packed for the way."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows or not bits.num_rows:
            return _table([], "shard block numbers sizes owners texts")
        block = docs["linkspark_block"][0].as_py()
        docs, data, ends, ids = _sorted_docs(docs, text)
        start, size, anchor, doc = _runs(data, ends)
        keys, inverse = np.unique(anchor, return_inverse=True)
        shard, yes = _shard(keys, shards), np.zeros(len(keys), bool)
        order, some, edges = _dealt(shard)
        at = np.searchsorted(some, bits["shard"].to_numpy())
        for a, b, raw in zip(edges[at].tolist(), edges[at + 1].tolist(), bits["bits"].to_pylist(), strict=True):
            yes[order[a:b]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        raw, some = data.tobytes(), np.flatnonzero(yes[inverse])
        first = some[np.unique(_alike(_spare(data), len(data), start[some], size[some]))]
        order, some, edges = _dealt(shard[inverse[first]])
        first = first[order]
        rows, packer = [], zstandard.ZstdCompressor(level=1)
        for s, a, b in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = first[a:b]
            texts = b"\0".join(raw[a : a + n + SPAN - 1] for a, n in zip(start[own].tolist(), size[own].tolist(), strict=True))
            rows.append((s, block, own.astype(np.int32).tobytes(), size[own].astype(np.uint8).tobytes(), ids[doc[own]].tobytes(), packer.compress(texts)))
        return _table(rows, "shard block numbers sizes owners texts")

    return run


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort one shard; for each run of each block the windows that start in an earlier document too, as a mask.
    Texts are in files; numbers of each run are in memory."""
    shards, blocks, numbers, sizes, owners = [], [], [], [], []
    file, unpacker = tempfile.TemporaryFile(), zstandard.ZstdDecompressor()
    for batch in batches:
        for c, name in ((shards, "shard"), (blocks, "block"), (numbers, "numbers")):
            c += batch[name].to_pylist()
        sizes += [np.frombuffer(x, np.uint8) for x in batch["sizes"].to_pylist()]
        owners += [np.frombuffer(x, np.int64) for x in batch["owners"].to_pylist()]
        for x in batch["texts"]:
            file.write(unpacker.decompress(x.as_py()))
            file.write(b"\0")
    file.write(bytes(96))
    file.flush()
    counts = [len(x) for x in sizes]
    size, owner = np.concatenate(sizes).astype(np.int64), np.concatenate(owners)
    joined = mmap.mmap(file.fileno(), 0)
    # runs that several blocks hold alike are sorted once, for the earliest document; the others follow it
    data = np.frombuffer(joined, np.uint8)
    begin = np.cumsum(size + SPAN) - (size + SPAN)
    key = _alike(data, len(data) - 96, begin, size)
    order = np.lexsort((owner, key))
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    one = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    same = np.empty(len(order), np.int64)
    same[order] = one
    later = owner > owner[same]
    chosen = np.flatnonzero(same == np.arange(len(same)))
    own, old = size[chosen], begin[chosen]
    size, owner = own, owner[chosen]
    begin = np.cumsum(size + SPAN) - (size + SPAN)  # each run is size + SPAN - 1 bytes and a separator
    data = mapped(int((size + SPAN).sum()) - 1)
    run_at = mapped(len(data), np.int32)  # 1 + the run of each window start
    for k in range(0, len(size), RUNS):
        part = b"\0".join(joined[a : a + n + SPAN - 1] for a, n in zip(old[k : k + RUNS].tolist(), own[k : k + RUNS].tolist(), strict=True))
        data[begin[k] : begin[k] + len(part)] = np.frombuffer(part, np.uint8)
        some = size[k : k + RUNS]
        at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[k : k + RUNS], some)
        run_at[at] = np.repeat(np.arange(k, k + len(some), dtype=np.int32) + 1, some)
    masks = np.zeros(len(size), np.uint32)
    tail_pos, tail_new = np.zeros(0, np.int64), np.zeros(0, bool)

    def settle(pos: np.ndarray, new: np.ndarray) -> None:
        group = np.cumsum(new) - 1
        which = run_at[pos] - 1
        ok = which >= 0
        pos, group, which = pos[ok], group[ok], which[ok]
        if not len(pos):
            return
        head = np.flatnonzero(np.diff(group, prepend=-1))
        low = np.minimum.reduceat(owner[which], head)
        early = np.repeat(low, np.diff(head, append=len(pos))) < owner[which]
        np.bitwise_or.at(masks, which[early], np.uint32(1) << (pos[early] - begin[which[early]]).astype(np.uint32))

    for pos, lcp in sorted_suffixes(data, SPAN):
        pos, new = np.concatenate([tail_pos, pos]), np.concatenate([tail_new, lcp < SPAN])
        if len(new):
            new[0] = True
        last = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last group may go on
        settle(pos[:last], new[:last])
        tail_pos, tail_new = pos[last:], new[last:]
    settle(tail_pos, tail_new)
    place = np.zeros(len(same), np.int64)
    place[chosen] = np.arange(len(chosen))
    masks = np.where(later, np.uint32(0xFFFFFFFF), masks[place[same]])
    rows, at = [], 0
    for s, b, which, n in zip(shards, blocks, numbers, counts, strict=True):
        rows.append((s, b, which, masks[at : at + n].tobytes()))
        at += n
    yield from _table(rows, "shard block numbers masks").to_batches()


def _cut(names: list[str], text: str, with_text: bool):
    """Remove what the masks and earlier documents of the block cover."""

    def run(docs: pa.Table, masks: pa.Table) -> pa.Table:
        docs, data, ends, ids = _sorted_docs(docs, text)
        start, size, anchor, doc = _runs(data, ends)
        mask = np.zeros(len(start), np.uint32)
        first = [np.frombuffer(x, np.int32) for x in masks["numbers"].to_pylist()]
        for numbers, m in zip(first, masks["masks"].to_pylist(), strict=True):
            mask[numbers] = np.frombuffer(m, np.uint32)
        some = np.flatnonzero(np.isin(anchor, anchor[np.concatenate(first)])) if first else np.zeros(0, np.int64)
        start, size, doc, mask = start[some], size[some], doc[some], mask[some]
        which = _alike(_spare(data), len(data), start, size)
        mask = np.where(ids[doc[which]] < ids[doc], np.uint32(0xFFFFFFFF), mask[which])
        step = np.zeros(len(data) + 1, np.int32)
        for k in range(RUN):
            hit = start[((mask >> np.uint32(k)) & np.uint32(1)).astype(bool) & (size > k)] + k
            step[hit] += 1  # each place is in one run
            step[hit + SPAN] -= 1
        np.cumsum(step, out=step)
        gone = step[:-1] > 0
        raw, out = data.tobytes(), [[], [], [], [], []]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = data[a:b][~own].tobytes() if own.any() else raw[a:b]
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if b > a else 0
            for c, v in zip(out, (b - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None), strict=True):
                c.append(v)
        cols = {n: docs[n] for n in names}
        new = dict(zip(("linkspark_n_bytes", "linkspark_n_removed", "linkspark_n_spans", "linkspark_kept_sha256", "linkspark_kept"), (pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True)), strict=True))
        return pa.table(cols | new)

    return run


def _parts(docs: DataFrame, text: str) -> int:
    """Number of blocks, and of shards, by the bytes of the texts."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + F.lit(PER_DOC)
    return max(8, -(-(docs.agg(F.sum(size.cast("long"))).first()[0] or 0) // BYTES))


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with linkspark_n_bytes, linkspark_n_removed, linkspark_n_spans, linkspark_kept_sha256 and linkspark_kept.

    Each byte is removed that a string of SPAN bytes covers which also starts in a document with a smaller doc_id,
    judged on the whole texts as given (UTF-8; null is empty). kept is what is left, without characters that a cut went
    through; the hash is of all bytes left.

    Every window of SPAN bytes has an anchor, the least hash of its GRAM-byte parts, so equal windows meet where their
    anchor is dealt to. Blocks of documents send their distinct anchors to shards and learn which stand in two
    documents; they send the distinct runs of windows with such anchors, and a shard sorts all suffixes of these runs
    by external induced sorting and gives back which windows start in an earlier document. Copies within a block travel
    once, so a passage that all documents hold is a run for each block. Blocks and shards are as many as keep them at
    about BYTES bytes of the texts, dealt by a hash, whatever their sources; a block holds its texts in memory, one text
    at least. A shard that comes out larger has its text, queues and sorted order in files, and in memory the numbers
    of its runs. Runs meet by hashes and count as equal only if their bytes are.

    Doc_ids are whole numbers. Rows with a null doc_id stand behind all others: they lose what those hold and give nothing. Rows of one doc_id do
    not cut each other. Texts of fewer than SPAN bytes stay whole. Other columns stay as they are; no rows give no rows.
    """
    blocks = shards = _parts(docs, text)
    names = docs.columns
    key = F.xxhash64(F.col("doc_id"), F.col(f"`{text}`"))
    own = docs.withColumns({"linkspark_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "linkspark_hash": key, "linkspark_block": F.pmod(key, F.lit(blocks)).cast("long")})
    by = "linkspark_block"
    anchors = own.groupBy(by).applyInArrow(_anchors(shards, text), "shard long, block long, keys binary, several binary")
    bits = anchors.groupBy("shard").applyInArrow(_shared, "shard long, block long, bits binary")
    runs = own.groupBy(by).cogroup(bits.groupBy("block")).applyInArrow(_gather(shards, text), "shard long, block long, numbers binary, sizes binary, owners binary, texts binary")
    masks = runs.groupBy("shard").applyInArrow(_sort, "shard long, block long, numbers binary, masks binary")
    schema = T.StructType(list(docs.schema.fields))  # add() changes a schema in place
    for c, t in (("linkspark_n_bytes", "long"), ("linkspark_n_removed", "long"), ("linkspark_n_spans", "long"), ("linkspark_kept_sha256", "string"), ("linkspark_kept", "string")):
        schema = schema.add(c, t)
    return own.groupBy(by).cogroup(masks.groupBy("block")).applyInArrow(_cut(names, text, with_text), schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text, and n_chars to match; the columns of docs, every row kept."""
    out = remove_repeats(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("linkspark_kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_suffix_dedup(spark, sf_dir):
    """What every document loses to earlier ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, with_text=False)
    return out.select("doc_id", *[F.col(f"linkspark_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


OP3_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as raw, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
places as (select doc_id, raw, unnest(range(0, n - 49)) as i from d),
w as (select doc_id, i, array_slice(raw, i + 1, i + 50) as s from places),
f as (select s, min(doc_id) as earliest from w group by s),
hit as (select w.doc_id, w.i from w join f on f.s = w.s where w.doc_id > f.earliest),
mark as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as fresh from hit),
run as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from mark),
span as (select doc_id, min(i) as a, max(i) + 50 as b from run group by doc_id, k),
gap as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from span
  union all select d.doc_id, coalesce(max(span.b), 0), d.n from d left join span on span.doc_id = d.doc_id group by d.doc_id, d.n),
kept as (select gap.doc_id, string_agg(hex(array_slice(d.raw, gap.a + 1, gap.b)), '' order by gap.a) as h from gap join d on d.doc_id = gap.doc_id group by gap.doc_id),
gone as (select doc_id, cast(sum(b - a) as bigint) as removed, count(*) as spans from span group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(gone.removed, 0) as n_removed, coalesce(gone.spans, 0) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept on kept.doc_id = d.doc_id left join gone on gone.doc_id = d.doc_id"""
