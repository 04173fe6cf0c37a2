"""Language-model scoring: marginal likelihood over a subword lattice, with an add-one word model as its base."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import crc_mod, save, slices, word_hashes

#: The vocabulary of a public tokenizer; never trained or copied here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose words make one dictionary block.
BLOCK = 16_000_000
#: Words whose lattices are run side by side, and the longest of them.
SIDE, LONG = 4096, 64
START = "▁"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a row for each document with the numbers and counts of its words, and a row for each word
    of the block with its number and its count in training documents."""
    names = ["block", "doc_id", "held_out", "n_words", "words", "counts", "word", "number", "train"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def flush(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], text: dict[int, str]) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().int >> 66
        keys = np.array(sorted(text), np.uint64)
        train = np.zeros(len(keys), np.int64)
        docs = [[], [], [], [], []]
        for batch, words, firsts in held:
            number = np.searchsorted(keys, words).astype(np.int32)
            out = batch["held_out"].to_pylist()
            for d, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                own, count = np.unique(number[a:b], return_counts=True)
                if not out[d]:
                    train[own] += count
                for c, v in zip(docs, (batch["doc_id"][d].as_py(), out[d], b - a, _packed(np.diff(own, prepend=0)), _packed(count)), strict=True):
                    c.append(v)
        k = len(docs[0])
        yield pa.RecordBatch.from_arrays([pa.array([block] * k, kinds[0]), *[pa.array(c, t) for c, t in zip(docs, kinds[1:6], strict=True)], *[pa.nulls(k, t) for t in kinds[6:]]], names)
        k = len(keys)
        if k:
            spelled = pa.array([text[x] for x in keys.tolist()], kinds[6])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *[pa.nulls(k, t) for t in kinds[1:6]], spelled, pa.array(np.arange(k, dtype=np.int32)), pa.array(train)], names)

    held, text, size = [], {}, 0
    for batch in slices(batches, "text"):
        words, firsts, starts, data = word_hashes(batch["text"])
        keys, where = np.unique(words, return_index=True)
        raw = data.tobytes().lower()
        ends = np.append(starts[1:], len(raw))
        for key, a, b in zip(keys.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True):
            if key not in text:
                text[key] = raw[a:b].split(None, 1)[0].decode()
        held.append((batch.select(["doc_id", "held_out"]), words, firsts))
        size += len(raw)
        if size >= BLOCK:
            yield from flush(held, text)
            held, text, size = [], {}, 0
    if held:
        yield from flush(held, text)


def _vocabulary(file: bytes) -> tuple[list[str], np.ndarray]:
    """Pieces and their standing weights: the file's score orders the pieces, a piece of rank r weighs 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    n = model.get_piece_size()
    pieces = [f"<0x{int(p[3:5], 16):02X}>" if model.is_byte(i) else p for i, p in enumerate(map(model.id_to_piece, range(n)))]
    usable = np.array([not (model.is_control(i) or model.is_unknown(i)) for i in range(n)])
    score = np.array([model.get_score(i) for i in range(n)])
    rank = np.empty(n)
    rank[np.argsort(-score, kind="stable")] = np.arange(n)
    weight = np.where(usable, 1 / (rank + 10), 0.0)
    return pieces, weight / weight.sum()


def _expected(shared):
    """Pieces of the words, as often as the segmentations of each word hold them on average; each word counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        total = np.zeros(len(lattices.names))
        for batch in batches:
            total += lattices.expected(batch["word"].to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lattices.names[i] for i in some.tolist()], pa.string()), pa.array(total[some])], ["piece", "n"])

    return run


def word_log10(word: str, pieces: dict[str, float], longest: int) -> float:
    """log10 of the chance of a word, summed over all of its segmentations: forward recursion in log space. A character
    that is no piece stands as its UTF-8 bytes."""
    text = START + word
    n = len(text)
    ahead: list[list[float]] = [[] for _ in range(n + 1)]
    ahead[0].append(0.0)
    for i in range(n):
        paths = ahead[i]
        if not paths:
            continue
        top = max(paths)
        here = top + math.log(sum(math.exp(p - top) for p in paths)) if len(paths) > 1 else top
        ahead[i] = []
        for j in range(i + 1, min(n, i + longest) + 1):
            p = pieces.get(text[i:j])
            if p is not None:
                ahead[j].append(here + p)
        if text[i] not in pieces:
            ahead[i + 1].append(here + sum(pieces[f"<0x{b:02X}>"] for b in text[i].encode("utf-8", "surrogatepass")))
    top = max(ahead[n])
    return (top + math.log(sum(math.exp(p - top) for p in ahead[n]))) / math.log(10)


def word_counts(word: str, pieces: dict[str, float], longest: int) -> dict[str, float]:
    """How often each piece stands in the segmentations of a word, weighted by their chances: forward and backward sums."""
    text = START + word
    n = len(text)
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)

    def steps(i: int) -> Iterator[tuple[int, list[str], float]]:
        for j in range(i + 1, min(n, i + longest) + 1):
            if text[i:j] in pieces:
                yield j, [text[i:j]], pieces[text[i:j]]
        if text[i] not in pieces:
            spelled = [f"<0x{b:02X}>" for b in text[i].encode("utf-8", "surrogatepass")]
            yield i + 1, spelled, sum(pieces[b] for b in spelled)

    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for j, _, p in steps(i):
            ahead[j] = add(ahead[j], ahead[i] + p)
    out: dict[str, float] = {}
    for i in reversed(range(n)):
        for j, names, p in steps(i):
            back[i] = add(back[i], p + back[j])
            for name in names:
                out[name] = out.get(name, 0.0) + math.exp(ahead[i] + p + back[j] - ahead[n])
    return out


class Lattices:
    """The same sum as word_log10 for many words side by side: the pieces are a trie, and all words of a lot walk it
    together from each of their characters."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.names = list(pieces)
        self.number = {p: i for i, p in enumerate(self.names)}
        made = [-1]
        children: dict[tuple[int, int], int] = {}
        self.value = [-np.inf]
        for piece, p in pieces.items():
            at = 0
            for ch in piece:
                step = (at, ord(ch))
                if step not in children:
                    children[step] = len(self.value)
                    self.value.append(-np.inf)
                    made.append(-1)
                at = children[step]
            self.value[at] = p
            made[at] = self.number[piece]
        self.made = np.array(made)
        self.value = np.array(self.value)
        self.keys = np.array([at << 21 | ch for at, ch in children], np.int64)
        order = np.argsort(self.keys)
        self.keys, self.to = self.keys[order], np.array(list(children.values()), np.int64)[order]

    def _spelled(self, ch: int) -> float:
        """Chance of a character that is no piece, as its bytes."""
        return -np.inf if chr(ch) in self.pieces else sum(self.pieces[f"<0x{b:02X}>"] for b in chr(ch).encode("utf-8", "surrogatepass"))

    def _lot(self, words: list[str], edges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the beginnings of words, and where the words end; edges takes the pieces on the way: begin, end, words,
        chances, and the numbers of the pieces, or of characters (behind them) that are no pieces."""
        size = np.array([len(w) for w in words]) + 1
        width = int(size.max())
        chars = np.full((len(words), width), -1, np.int64)
        flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[np.arange(width) < size[:, None]] = flat
        kinds, inverse = np.unique(flat, return_inverse=True)
        spelled = np.full(chars.shape, -np.inf)
        spelled[chars >= 0] = np.array([self._spelled(c) for c in kinds.tolist()])[inverse]
        ahead = np.full((len(words), width + 1), -np.inf)
        ahead[:, 0] = 0.0

        def step(i: int, j: int, rows: np.ndarray, value: np.ndarray, what: np.ndarray) -> None:
            ahead[rows, j] = np.logaddexp(ahead[rows, j], ahead[rows, i] + value)
            if edges is not None and len(rows):
                edges.append((i, j, rows, value, what))

        for i in range(width):
            who = np.flatnonzero((i < size) & (ahead[:, i] > -np.inf))
            none = who[spelled[who, i] > -np.inf]
            step(i, i + 1, none, spelled[none, i], chars[none, i] + len(self.names))
            at = np.zeros(len(who), np.int64)
            for j in range(i, min(width, i + self.longest)):
                key = at << 21 | chars[who, j]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = (self.keys[found] == key) & (chars[who, j] >= 0)
                who, at = who[on], self.to[found[on]]
                if not len(who):
                    break
                some = self.value[at] > -np.inf
                step(i, j + 1, who[some], self.value[at[some]], self.made[at[some]])
        return ahead, size

    def _lots(self, words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Numbers of words of like length, SIDE at a time: those of LONG characters or fewer, and the longer ones."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for low in range(0, len(order), SIDE):
            lot = order[low : low + SIDE]
            short = [k for k in lot if len(words[k]) <= LONG]
            yield short, lot[len(short) :]

    def log10(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for short, long in self._lots(words):
            if short:
                ahead, size = self._lot([words[k] for k in short])
                out[short] = ahead[np.arange(len(short)), size] / math.log(10)
            for k in long:
                out[k] = word_log10(words[k], self.pieces, self.longest)
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """word_counts of all words, summed, by number of the piece."""
        out = np.zeros(len(self.names))
        spelled: dict[int, float] = {}
        for short, long in self._lots(words):
            edges: list = []
            if short:
                ahead, size = self._lot([words[k] for k in short], edges)
                row = np.arange(len(short))
                whole = ahead[row, size]
                back = np.full(ahead.shape, -np.inf)
                back[row, size] = 0.0
            for i, j, rows, value, what in reversed(edges):
                through = value + back[rows, j]
                back[rows, i] = np.logaddexp(back[rows, i], through)
                share = np.exp(ahead[rows, i] + through - whole[rows])
                piece = what < len(self.names)
                np.add.at(out, what[piece], share[piece])
                for ch, n in zip((what[~piece] - len(out)).tolist(), share[~piece].tolist(), strict=True):
                    spelled[ch] = spelled.get(ch, 0.0) + n
            for k in long:
                for piece, n in word_counts(words[k], self.pieces, self.longest).items():
                    out[self.number[piece]] += n
        for ch, n in spelled.items():
            for b in chr(ch).encode("utf-8", "surrogatepass"):
                out[self.number[f"<0x{b:02X}>"]] += n
        return out


def _score_words(shared, own: float, total: int):
    """Chance of each word: its lattice, and the word itself as one piece of the weight `own`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        for batch in batches:
            words = batch["word"].dictionary_encode()
            at = words.indices.to_numpy()
            got = lattices.log10(words.dictionary.to_pylist())[at] + math.log10(1 - own)
            seen = batch["seen"].to_numpy()
            known = np.flatnonzero(seen)
            if own and len(known):
                got[known] = np.logaddexp(got[known] * math.log(10), np.log(own * seen[known] / total)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch["block"], batch["number"], batch["seen"], pa.array(got)], ["block", "number", "seen", "log10"])

    return run


def _score_docs(base: float, end_base: float, end_known: int, end_score: float, train: int):
    """The documents of one block, from the words of that block."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["number"].to_numpy())
        seen, log10 = words["seen"].to_numpy()[order], words["log10"].to_numpy()[order]
        known, simple = seen > 0, np.log10((seen + 1) / base)
        cols = [[], [], []]
        for own, count in zip(docs["words"].to_pylist(), docs["counts"].to_pylist(), strict=True):
            i, c = np.cumsum(_unpacked(own)), _unpacked(count)
            cols[0].append(int(c[known[i]].sum()) + end_known)
            cols[1].append(float((c * simple[i]).sum()) + end_base)
            cols[2].append(float((c * log10[i]).sum()) + end_score)
        n = docs.num_rows
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array([w + 1 for w in docs["n_words"].to_pylist()], pa.int64()), "n_known": pa.array(cols[0], pa.int64()), "train_tokens": pa.array([train] * n, pa.int64()), "base_score": pa.array(cols[1], pa.float64()), "score": pa.array(cols[2], pa.float64())})

    return run


def score(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, prior: float = 3_000.0, own: float | None = None, rounds: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words (A-Z as a-z) and one end. base_score: log10 of add-one word frequencies of the training rows.
    score: log10 of the marginal probability over every segmentation of every word into pieces of an existing vocabulary.
    Its scores weigh the pieces (they are ranks in a BPE file, so a piece of rank r weighs 1 / (r + 10)) with `prior`
    pseudo-counts; `rounds` times the counts that all segmentations of the training words hold on average are added, under
    the weights so far (expectation maximization). Each distinct word counts once there, because pieces serve the words
    that training does not hold. One more segmentation of a word is the word itself, with its training frequency, so that
    what the model knows grows with the corpus. It has the share `own` of the weight; null: what words that training holds
    once leave of all tokens, the usual estimate of the share of words seen before (0: pieces alone). The end is one more
    piece.

    Documents are read once, in blocks of about BLOCK bytes; a block hands on each of its words once, and gets its
    count and score back. So a word that stands in all documents is as many rows as there are blocks, which is less than
    a task's share of all rows; no words are broadcast and no list of a word's blocks is made. Within a block words are
    told apart by a 64-bit hash. Doc_ids are whole numbers. Null text has no words; it has one token, the end. Repeated
    rows come back each; a null doc_id is a row like others (held_out null counts as training and shows as false).
    Without training rows N and V are 0. The vocabulary file is read on the driver and shipped.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    blocks, _ = save(rows.mapInArrow(_blocks, "block long, doc_id long, held_out boolean, n_words long, words binary, counts binary, word string, number int, train long"))
    word = Window.partitionBy("word").orderBy("block", "number")
    seen = F.sum("train").over(word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    words = blocks.where("word is not null").select("word", "block", "number", seen.alias("seen"), (F.row_number().over(word) == 1).alias("head"))
    words, _ = save(words)  # in order of the words: a word's blocks stand together
    first = words.where("head and seen > 0").select("word", "seen")
    total, distinct, once = first.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("seen") == 1)).first()
    ends = blocks.where("word is null and not held_out").count()
    train, distinct = total + ends, distinct + (ends > 0)
    pieces, weight = _vocabulary(Path(vocabulary).read_bytes())
    usable = np.flatnonzero(weight)
    chance = weight[usable] / (1 + 1 / prior)
    for r in range(rounds + 1):
        model = {pieces[i]: c for i, c in zip(usable.tolist(), np.log(chance).tolist(), strict=True)}
        shared = spark.sparkContext.broadcast(model)  # one number for each piece of the vocabulary
        if r == rounds:
            break
        gained = {x["piece"]: x["n"] for x in first.mapInArrow(_expected(shared), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        count = np.array([gained.get(pieces[i], 0.0) for i in usable.tolist()])
        chance = (count + prior * weight[usable]) / (count.sum() + prior + 1)
    if own is None:
        own = 1 - (once + 1) / (train + 2)
    own = own if train else 0.0
    end = own * ends / max(train, 1) + (1 - own) * (1 - chance.sum())
    scored = words.select("word", "block", "number", "seen").mapInArrow(_score_words(shared, own, train), "block long, number int, seen long, log10 double")
    base = train + distinct + 1
    give = _score_docs(base, math.log10((ends + 1) / base), int(ends > 0), math.log10(end), train)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.where("word is null").select("block", "doc_id", "held_out", "n_words", "words", "counts").groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(give, schema)


def op9_lattice_score(spark, sf_dir):
    """Base and lattice score of every document; rows of one remainder are held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_mod(F.col("doc_id"), 7) == 2)
