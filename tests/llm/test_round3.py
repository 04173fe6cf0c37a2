"""Pieces, centroids and whitening against the library, a brute-force version and numpy, with nulls, repeats and ties."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from linkspark.llm import bidiagonal, centroids, lattice, pieces, queries, whitening

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", "a", " a", "a ", "  a   b  ", "▁", "a▁b", "▁▁ x", "a\x00b", "\t\n x\r\n", "　全角　空白", "é😀 é", "<s> hi </s>", "<0x0A>", "<unk>", " " * 41 + "x" + " " * 7, "aaaa" * 60, "the of and " * 50, "Zażółć gęślą jaźń", "﻿x", " "]


PIECES = {"▁": 0.2, "▁a": 0.1, "a": 0.3, "b": 0.1, "ab": 0.05, "▁ab": 0.02, "c": 0.05}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_equal_the_library(spark):
    rng = random.Random(3)
    letters = "abcdefgh  \n▁é😀中文.,()<>0x1" + " "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["x" * 30_000 + " " + "".join(rng.choice("abcdef") for _ in range(20_000))]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, None, "n"), (3, "a", "again")], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.encoded(docs.repartition(3), MODEL, keep=True).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = r.text or ""
        ids = model.encode(text)
        assert list(r.ids) == ids and r.decoded == model.decode(ids), repr(text[:50])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(model.decode(ids)) and r.same_as_library


def test_pieces_of_the_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = queries.QUERIES["op11_sentencepiece"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.same_as_library) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)), True)


def test_pieces_uncut_and_empty(spark):
    vocabulary = pieces.Vocabulary(open(MODEL, "rb").read())
    assert vocabulary.parts
    vocabulary.parts = False  # a vocabulary whose pieces may hold blanks is encoded as one word
    for text in ODD:
        ids = [i for w in vocabulary.words(text) for i in vocabulary.encode(w)]
        assert ids == vocabulary.model.encode(text) and vocabulary.decode(ids) == vocabulary.model.decode(ids)
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    with pytest.raises(ValueError):
        pieces.encoded(spark.createDataFrame([], "n_tokens string"), MODEL, text="n_tokens")


def brute_clusters(rows, k=8, rounds=10, d=64):
    kept = [(v, [math.floor(1024 * float(c)) for c in x]) for v, x in rows if x is not None and len(x) == d and all(c is not None and math.isfinite(c) for c in x)]
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, sha(f"3:{r[0]}")), r[1]))
    centre = [list(x) for _, x in order[:k]]
    near = lambda x: min(range(len(centre)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centre[c], strict=True)), c))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for c in range(len(centre)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centre[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(x) for _, x in kept]
    away = [sum((a - b) ** 2 for a, b in zip(x, centre[o], strict=True)) for (_, x), o in zip(kept, own, strict=True)]
    return sorted(((v, o, a, sum(b for p, b in zip(own, away, strict=True) if p == o), sum(away), sha(",".join(map(str, centre[o])))) for (v, _), o, a in zip(kept, own, away, strict=True)), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 64).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # copies, and so ties and empty clusters
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [None] + [0.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [-1e-30] * 64), (207, [1e4] * 64)]
    df = spark.createDataFrame([(v, x, 1, "z") for v, x in rows], "vec_id long, embedding array<double>, cluster int, x string")
    got = centroids.clustered(df.repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)
    few = rows[:3] + [(1, None)]
    assert sorted(map(tuple, centroids.clustered(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()), key=str) == brute_clusters(few)
    assert centroids.clustered(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<double>")
    assert {r.distance for r in centroids.clustered(huge).collect()} == {0}


def test_clusters_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.SQL["op12_centroid_clusters"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op12_centroid_clusters"](spark, SF).collect())) == sorted(want)


def test_bisectors_ties():
    c = np.array([[0, 0], [2, 0], [0, 2], [2, 2]])
    own = centroids.Bisectors(c).nearest(np.array([[1, 1], [1, 0], [2, 1], [3, 3], [-1, -1], [1, 2]]))
    assert own.tolist() == [0, 0, 1, 3, 0, 2]


@pytest.mark.parametrize("kind", ["random", "equal", "ranks", "graded", "clusters", "zero", "few", "split"])
def test_bidiagonal(kind):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((60, 30)))[0]
    other = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    made = {
        "random": rng.standard_normal((200, 30)),
        "equal": turn,
        "ranks": np.hstack([rng.standard_normal((90, 20)), np.ones((90, 10))]),
        "graded": turn * 10.0 ** -np.linspace(0, 7, 30) @ other,
        "clusters": turn * np.repeat([3.0, 2.0, 1.0], 10) @ other,
        "zero": np.zeros((9, 5)),
        "few": rng.standard_normal((4, 30)),
        "split": np.diag(np.arange(1.0, 31)),
    }[kind]
    r = np.linalg.qr(made, mode="r")
    squares, vectors = bidiagonal.principal(r)
    d = made.shape[1]
    want = np.zeros(d)
    found = np.linalg.svd(made, compute_uv=False)
    want[: len(found)] = found**2
    top = max(want[0], 1e-300)
    assert np.abs(squares - want).max() <= 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-9
    assert np.abs(made.T @ (made @ vectors) - vectors * squares).max() <= 1e-12 * top


def test_dqds_keeps_small_values():
    a, b = np.array([1.0, 1e-3, 1e-7, 1e-9]), np.array([1e-4, 1e-6, 1e-10])
    got = np.sqrt(bidiagonal.singular_squares(a, b))
    from fractions import Fraction

    # the product of the squares is that of the diagonal; a plain symmetric solver loses the last ones entirely
    product = Fraction(1)
    for x in a.tolist():
        product *= Fraction(x)
    assert abs(float(np.prod(got)) / float(product) - 1) < 1e-12


def check_white(rows, got, most=32):
    sound = [(v, x) for v, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    d = max(len(x) for _, x in sound)
    x = np.array([[math.floor(64 * c) + 1000000 for c in list(v) + [0.0] * (d - len(v))] for _, v in sound], object)
    n, total = len(x), x.sum(0)
    away = (x - 1000000).astype(float) - ((total - 1000000 * n) / n).astype(float)
    e, vec = np.linalg.eigh(away.T @ away / n)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(most, d)
    assert len(got) == n * k
    devs = sorted(int(sum((n * a - t) ** 2 for a, t in zip(row, total, strict=True))) for row in x.tolist())
    assert sorted(r.deviation for r in got if r.component == 1) == devs and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(1, k + 1):
        mine = [r for r in got if r.component == c]
        if e[c - 1] > 1e-9 * max(e[0], 1e-300):
            assert abs(mine[0].explained / (e[c - 1] / e.sum()) - 1) < 1e-9
            w = np.array([r.whitened for r in mine])
            assert abs((w * w).mean() - 1) < 1e-9 and abs(w.mean()) < 1e-9
        else:
            assert all(r.whitened is None and r.explained in (0, None) for r in mine)
    return away, e, vec


def test_whitening_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    away, e, vec = check_white([(r.vec_id, r.embedding) for r in table], got)
    place = {r.vec_id: i for i, r in enumerate(table)}
    for c in (1, 2, 17, 32):
        want = away @ vec[:, c - 1] / math.sqrt(e[c - 1])
        mine = np.array([r.whitened for r in sorted((r for r in got if r.component == c), key=lambda r: place[r.vec_id])])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_whitening_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((40, 5)))]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (50, None), (51, [None] * 5), (52, [float("inf")] * 5), (53, []), (54, [1.0, 2.0])]
    rows = [(v, x if x is None or len(x) < 5 else [*x, x[0], 0.25]) for v, x in rows]  # one dimension twice, one nearly constant
    df = spark.createDataFrame([(v, x, "q") for v, x in rows], "vec_id long, embedding array<double>, n string")
    check_white(rows, whitening.whitened(df.repartition(7)).collect())
    one = whitening.whitened(df.where("vec_id = 1")).collect()
    assert len(one) == 7 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    assert whitening.whitened(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitened(huge).collect()] == [None] * 4
    far = spark.createDataFrame([(i, [1e9 + i, 1e9 - i * i]) for i in range(9)], "vec_id long, embedding array<double>")
    check_white([(i, [1e9 + i, 1e9 - i * i]) for i in range(9)], whitening.whitened(far).collect())


def test_triangles_meet_in_rounds(spark):
    x = np.random.default_rng(1).integers(-50, 50, (4000, 6))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(70)
    r = whitening.triangle(df, lambda b: whitening._matrix(b, 6).astype(float), 6)
    assert np.allclose(r.T @ r, x.T @ x)
    assert df.where(F.lit(False)).count() == 0 and not whitening.triangle(df.where(F.lit(False)), lambda b: whitening._matrix(b, 6).astype(float), 6).size


def test_pieces_long_texts_in_stretches(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh  \n▁é ") for _ in range(4000))
    monkeypatch.setattr(pieces, "STRETCH", 50)
    parts = list(pieces._stretches(text))
    assert len(parts) > 20 and " ".join(parts) == text
    shared = type("Shared", (), {"value": open(MODEL, "rb").read()})
    import pyarrow as pa

    for t in (text, text + " ", text + "  ", "x" * 60 + " ", "x" * 60 + "  y", " " * 200, "x" * 200):
        (out,) = pieces._rows(shared, "text", True)(iter([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])]))
        row = out.to_pylist()[0]
        assert row["ids"] == model.encode(t) and row["decoded"] == model.decode(model.encode(t)) and row["same_as_library"]
        assert row["ids_sha256"] == sha(",".join(map(str, row["ids"]))) and row["n_tokens"] == len(row["ids"])


def test_jaccard_finds_crowded_tokens(spark, monkeypatch):
    """A shingle that stands in few documents of each stretch, but in many in all, is ordered last in a second round."""
    from linkspark.llm import jaccard

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, tail = [], "one two three four five six seven eight nine ten eleven twelve"
    for _ in range(60):
        own = [word() for _ in range(40)]
        texts.append(" ".join([*own, tail]))
        if rng.random() < 0.5:
            texts.append(" ".join([*own, tail, word()]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), len(texts) // 2), "doc_id long, text string")
    for name, value in (("TALLY", 40), ("CROWD", 20)):
        monkeypatch.setattr(jaccard, name, value)
    made, real = [], jaccard._prefixes
    monkeypatch.setattr(jaccard, "_prefixes", lambda n, percent, heavy: made.append(len(heavy.value[0])) or real(n, percent, heavy))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) == 60
    assert len(made) > 1 and made[-1] > made[0]


def test_expected_counts_of_all_segmentations():
    chance = PIECES | {f"<0x{b:02X}>": 1e-4 for b in range(256)}
    model = {k: float(np.log(v)) for k, v in chance.items()}
    words = ["ab", "cab", "aabb", "b", "é", "aéb", "漢a", "", "ab" * 40]
    total = np.zeros(len(model))
    for word in words[:8]:
        text, found = lattice.START + word, {}
        for n in range(len(text)):
            for cuts in itertools.combinations(range(1, len(text)), n):
                ends = [0, *cuts, len(text)]
                parts = [text[a:b] for a, b in itertools.pairwise(ends)]
                parts = [q for p in parts for q in ([p] if p in PIECES or len(p) > 1 else [f"<0x{b:02X}>" for b in p.encode()])]
                found[tuple(ends)] = parts, float(np.prod([chance.get(p, 0.0) for p in parts]))
        whole = sum(c for _, c in found.values())
        want = {}
        for parts, c in found.values():
            for p in parts if c else []:
                want[p] = want.get(p, 0.0) + c / whole
        assert lattice.word_counts(word, model, 3) == pytest.approx(want)
        for p, v in want.items():
            total[list(model).index(p)] += v
    side = lattice.Lattices(model)
    assert side.expected(words[:8]) == pytest.approx(total)
    long = lattice.word_counts(words[8], model, 3)  # more characters than words side by side may have
    assert side.expected(words[8:])[list(model).index("ab")] == pytest.approx(long["ab"]) and side.expected([]).sum() == 0


def test_rounds_raise_the_training_likelihood(spark):
    names = [*PIECES, *(f"<0x{b:02X}>" for b in range(256))]
    words, chance, before = ["ab", "cab", "aabb", "abab", "é"], np.full(len(names), 1 / len(names)), -np.inf
    for _ in range(6):
        side = lattice.Lattices({n: float(np.log(c)) for n, c in zip(names, chance, strict=True) if c > 0})
        now = side.log10(words).sum()
        assert now >= before - 1e-12
        before = now
        count = dict(zip(side.names, side.expected(words), strict=True))
        chance = np.array([count.get(n, 0.0) for n in names]) / sum(count.values())
    docs = spark.createDataFrame([(i, f"anderung sanderung {'derung' * (i % 3)}") for i in range(12)] + [(12, "sanderungs"), (13, None), (None, "anderung")], "doc_id long, text string")
    mean = [sum(r.score for r in lattice.score(docs, F.col("doc_id") == 12, prior=1.0, own=0.0, rounds=k).collect()) for k in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]
    same = [sorted((str(r.doc_id), round(r.score, 9), r.held_out) for r in lattice.score(docs.repartition(k), F.col("doc_id") == 12).collect()) for k in (1, 5)]
    assert same[0] == same[1] and all(np.isfinite(s) for _, s, _ in same[0])
    assert lattice.score(docs.limit(0), F.col("doc_id") == 12).count() == 0
