"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs for merge-type vocabularies."""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from linkspark.llm.common import slices

#: The mark that stands for a blank (fixed by the file format).
BLANK = "▁"
#: Words after which a task forgets those that it has not met since, and the longest that share an agenda's matrix.
KEPT, LONG = 150_000, 64
#: Words that the library checks in one text; characters of a stretch of a long text.
SIDE, STRETCH = 256, 1_000_000


class Vocabulary:
    """The pieces of a merge-type model file: those that merges may make, by text with number and score, and the
    numbers of bytes and of the unknown piece."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = m.get_piece_size()
        spelled = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(m.is_unused(i) for i in plain):
            raise ValueError("a vocabulary with unused pieces is not supported")
        self.merged = {spelled[i]: (-m.get_score(i), i) for i in plain}
        self.bytes = {int(spelled[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.raw = {i: b for b, i in self.bytes.items()}
        self.unknown = m.unk_id()
        self.text = spelled
        if len(self.bytes) != 256 or m.normalize("  a  Ａ\t ") != f"{BLANK * 3}a{BLANK * 2}Ａ\t{BLANK}":
            raise ValueError("only vocabularies with bytes for unknown characters, a blank put first and no other normalization are supported")
        #: No piece goes on past a blank that follows another character, so such blanks begin words of their own.
        self.parts = not any(BLANK in p.lstrip(BLANK) for p in self.merged)

    def words(self, text: str) -> list[str]:
        """A text cut where no merge can reach across: before each run of blanks, where the vocabulary allows it."""
        if not text:
            return []
        if not self.parts:
            return [BLANK + text.replace(" ", BLANK)]
        out, run = [], BLANK
        for part in text.replace(BLANK, " ").split(" "):
            if part:
                out.append(run + part)
                run = BLANK
            else:
                run += BLANK
        if len(run) > 1:  # blanks behind the last word
            out.append(run[1:])
        return out

    def encode(self, word: str) -> list[int]:
        """Numbers of a word's pieces. All adjacent symbols that make a piece wait in an agenda, best score first and of
        equal scores the leftmost; the first is merged and offers itself to its neighbours, until none waits."""
        symbols: list[str] = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merged, agenda = self.merged, []
        for i in range(n - 1):
            found = merged.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two was merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                found = merged.get(symbols[i] + symbols[k])
                if found:
                    heapq.heappush(agenda, (found[0], i, k, size + len(symbols[k])))
            h = left[i]
            if h >= 0:
                found = merged.get(symbols[h] + symbols[i])
                if found:
                    heapq.heappush(agenda, (found[0], h, i, len(symbols[h]) + size))
        out: list[int] = []
        for s in symbols:
            if s:
                found = merged.get(s)
                out += [found[1]] if found else [self.bytes[b] for b in s.encode()]
        return out

    def spell(self, ids: list[int]) -> str:
        """The text that a word's pieces stand for, blanks as BLANK."""
        if self.raw.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out = bytearray()
        for i in ids:
            out += bytes([self.raw[i]]) if i in self.raw else self.text[i].encode()
        return out.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """A text from its ids: the pieces side by side, blanks back in place, less the one that was put first."""
        return self.spell(ids).removeprefix(BLANK).replace(BLANK, " ")


class Agendas:
    """Vocabulary.encode for many words side by side. Each word has a row of symbols and a row of the scores of its
    adjacent pairs, its agenda; in a round every word merges its best pair, of equal scores the leftmost, and its two
    neighbours are scored anew. Words without a pair that makes a piece leave."""

    def __init__(self, vocabulary: Vocabulary):
        merged = vocabulary.merged
        self.vocabulary, self.first = vocabulary, len(vocabulary.text)
        #: A character is its piece, or stands by its code point behind all pieces.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.first
        for piece, (_, i) in merged.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        rank = {x: r for r, x in enumerate(sorted({x for x, _ in merged.values()}))}
        self.none = len(rank)
        found: dict[int, tuple[int, int]] = {}
        for piece, (score, i) in merged.items():
            for k in range(1, len(piece)):
                left, right = self._known(piece[:k]), self._known(piece[k:])
                if left is not None and right is not None:
                    found[left << 21 | right] = rank[score], i
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([found[k][1] for k in self.keys.tolist()], np.int64)

    def _known(self, part: str) -> int | None:
        if len(part) == 1:
            return int(self.symbol[ord(part)])
        found = self.vocabulary.merged.get(part)
        return found and found[1]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pair stands among the pairs that make a piece, and its rank (none: behind all)."""
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.rank[at], self.none)

    def _lot(self, words: list[str]) -> list[list[int]]:
        """Symbols of words of one length."""
        n, width = len(words), len(words[0])
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(n, width)
        agenda = self._pairs(symbols[:, :-1], symbols[:, 1:])[1]
        who = np.arange(n)
        out: list[list[int]] = [[]] * n
        while len(who):
            best = agenda.argmin(1) if width > 1 else np.zeros(len(who), np.int64)
            goes_on = agenda[np.arange(len(who)), best] < self.none if width > 1 else np.zeros(len(who), bool)
            if not goes_on.all():
                for k, row in zip(who[~goes_on].tolist(), symbols[~goes_on].tolist(), strict=True):
                    out[k] = row
                who, symbols, agenda, best = who[goes_on], symbols[goes_on], agenda[goes_on], best[goes_on]
                if not len(who):
                    break
            rows = np.arange(len(who))
            at, _ = self._pairs(symbols[rows, best], symbols[rows, best + 1])
            symbols[rows, best] = self.made[at]
            # every word loses the right half of its pair, and its agenda the pair itself
            stays = np.ones(symbols.shape, bool)
            stays[rows, best + 1] = False
            symbols = symbols[stays].reshape(len(who), width - 1)
            stays = np.ones(agenda.shape, bool)
            stays[rows, best] = False
            agenda = agenda[stays].reshape(len(who), width - 2)
            width -= 1
            some = best > 0
            r, b = rows[some], best[some]
            agenda[r, b - 1] = self._pairs(symbols[r, b - 1], symbols[r, b])[1]
            some = best < width - 1
            r, b = rows[some], best[some]
            agenda[r, b] = self._pairs(symbols[r, b], symbols[r, b + 1])[1]
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Numbers of each word's pieces; words over LONG characters go through their own agenda."""
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.vocabulary.encode(w)
            else:
                by.setdefault(len(w), []).append(k)
        spelled = self.vocabulary.bytes
        for some in by.values():
            for k, row in zip(some, self._lot([words[k] for k in some]), strict=True):
                if max(row) >= self.first:
                    row = [i for s in row for i in ([s] if s < self.first else [spelled[b] for b in chr(s - self.first).encode()])]
                out[k] = row
        return out


def _stretches(text: str) -> Iterator[str]:
    """A long text in pieces of about STRETCH characters that are encoded on their own: each cut is a blank behind
    another character, which is the blank that is put before the next piece."""
    low = 0
    while len(text) - low > STRETCH:
        cut = low + STRETCH
        while (cut := text.find(" ", cut)) >= 0 and text[cut - 1] in (" ", BLANK):
            cut += 1
        if cut < 0:
            break
        yield text[low:cut]
        low = cut + 1
    yield text[low:]


class Encoder:
    """Words with their ids as text and what they spell; words of the last stretches are remembered, KEPT at a time."""

    def __init__(self, file: bytes):
        self.vocabulary = Vocabulary(file)
        self.agendas = Agendas(self.vocabulary)
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.strange: set[str] = set()
        self.digits = [str(i) for i in range(len(self.vocabulary.text))]

    def _same(self, words: list[str], ids: list[list[int]]) -> bool:
        """Whether the library gives these ids for the words side by side, and for these ids the text that they spell."""
        library = self.vocabulary.model
        # the library puts a blank in front of its own accord: the first word's first blank is that one
        text = "".join(words).removeprefix(BLANK).replace(BLANK, " ")
        mine = np.fromiter(chain.from_iterable(ids), np.int32)
        if words == [BLANK]:  # an empty text would have no ids
            return mine.tolist() == library.encode("x ")[len(library.encode("x")) :]
        spelled = "".join([self.young[w][1] for w in words]).removeprefix(" ")
        return np.array_equal(mine, library.encode(text, return_type="numpy")) and spelled == library.decode(mine)

    def learn(self, words: set[str]) -> None:
        """Have all these words ready. New ones are encoded, and the library has to come to the same."""
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
            self.strange &= self.old.keys()
        new = []
        for w in words:
            if w not in self.young:
                if w in self.old:
                    self.young[w] = self.old[w]
                else:
                    new.append(w)
        ids = self.agendas.encode(new)
        spell, digits = self.vocabulary.spell, self.digits
        for w, x in zip(new, ids, strict=True):
            self.young[w] = ",".join([digits[i] for i in x]), spell(x).replace(BLANK, " ")
        together = [k for k, w in enumerate(new) if self.vocabulary.parts and w[-1] != BLANK]
        alone = [k for k, w in enumerate(new) if not self.vocabulary.parts or w[-1] == BLANK]
        for low in range(0, len(together), SIDE):
            some = together[low : low + SIDE]
            if not self._same([new[k] for k in some], [ids[k] for k in some]):
                alone += some
        self.strange.update(new[k] for k in alone if not self._same([new[k]], [ids[k]]))


def _rows(shared, text: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        watched = gc.isenabled()
        gc.disable()  # some 100,000 words are held and nothing here makes cycles: looking for them took a quarter of the time
        try:
            yield from given(encoder, batches)
        finally:
            if watched:
                gc.enable()

    def given(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [v or "" for v in batch[text].to_pylist()]
            # a slice holds texts of about one stretch together, or one longer text
            lots = [[s] for s in _stretches(texts[0])] if len(texts) == 1 and encoder.vocabulary.parts else [texts]
            done = [([hashlib.sha256(), hashlib.sha256()], [0, True], [[], []]) for _ in texts]
            for number, lot in enumerate(lots):
                words = [encoder.vocabulary.words(t) if t or not number else [BLANK] for t in lot]
                encoder.learn(set().union(*words))
                got = encoder.young
                for own, (digests, counts, parts) in zip(words, done, strict=True):
                    numbers, spelled = zip(*[got[w] for w in own], strict=True) if own else ((), ())
                    ids, decoded = ",".join(numbers), "".join(spelled)
                    counts[0] += ids.count(",") + 1 if ids else 0
                    counts[1] = counts[1] and not (encoder.strange and encoder.strange.intersection(own))
                    digests[0].update(("," * bool(number) + ids).encode())
                    decoded = decoded if number else decoded.removeprefix(" ")
                    digests[1].update(decoded.encode())
                    if keep:
                        parts[0] += map(int, filter(None, ids.split(",")))
                        parts[1].append(decoded)
            cols = [[c[0] for _, c, _ in done], [d[0].hexdigest() for d, _, _ in done], [d[1].hexdigest() for d, _, _ in done], [c[1] for _, c, _ in done], [p[0] for _, _, p in done], ["".join(p[1]) for _, _, p in done]]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string()), strict=True)]
            made, names = (made, [*NAMES, "ids", "decoded"]) if keep else (made[:4], NAMES)
            rest = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], *made], [*rest, *names])

    return run


NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "same_as_library"]


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", keep: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, same_as_library; with `keep` also the ids and the decoded text.

    vocabulary: path of a merge-type model file, read on the driver and shipped (under 1 MB). Each whole text is encoded
    as the file's own library does, without begin or end ids, and decoded again. A text is cut where no piece of the
    vocabulary reaches across, which is before each run of blanks. The words of about 2 MB of text run their
    agendas side by side, as rows of a matrix; words over LONG characters each have a heap, in time n log n. A task
    remembers the pieces of the words that it met lately (KEPT and twice that at most, and those of one stretch). A text
    over 2 MB goes stretch by stretch; one without blanks is one word. same_as_library: the library gave the same ids and the same text for
    every word of the text.

    Null and empty texts have no tokens; their digests are those of an empty string. Characters outside the vocabulary
    are their UTF-8 bytes. A mark of a blank that stands in a text comes back as a blank, as with the library. Rows come
    back one for one, repeats and null ids included; other columns stay, but columns that have the name of a new one are
    replaced. One narrow pass, no shuffle.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = [*NAMES, "ids", "decoded"] if keep else NAMES
    if text in names:
        raise ValueError(f"the text's column can't be named {text}")
    rest = docs.drop(*names)
    schema = StructType(list(rest.schema.fields))
    for name, kind in zip(names, ("long", "string", "string", "boolean", ArrayType(IntegerType()), "string"), strict=False):
        schema = schema.add(name, kind)
    return rest.mapInArrow(_rows(file, text, keep), schema)


def op11_sentencepiece(spark, sf_dir):
    """Number of tokens, digest of the ids and digest of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    return encoded(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", *NAMES)
