"""The ten operators against brute force on small tables with nulls, empty and repeated rows, and extra columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import chat, decontaminate, induced, jaccard, labelled, lattice, mixing, quality, suffixes, toxicity, urls, vectors
from linkspark.llm.induced import sorted_suffixes

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [prose(60) for _ in range(20)]
    for i in range(12):  # near copies, with shared passages
        words = out[i % 3].split()
        words[RNG.randrange(60)] = "changed"
        out.append(" ".join(words))
    return [*out, out[0], out[0], None, "", "Two words", "two  WORDS", "é" * 90, "x" * 300, "x" * 120, prose(3000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "a" if i % 3 else None, 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + 0.04 * rng.normal(size=16)], i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, None, 0), (62, [0.0] * 16, 0), (63, [float("nan")] * 16, 0), (64, rows[1][1], None)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if v and k is not None and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, m in ok if j != i and m == k and v @ w >= 0.98} for i, v, k in ok}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)


def test_jaccard(docs, texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_suffixes(docs, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(own)
        want[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    got = suffixes.remove_repeats(docs).select("doc_id", *[f"linkspark_{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert suffixes.deduplicated(docs).columns == docs.columns


def test_induced_order():
    for k in range(60):
        raw = bytes(RNG.choice(b"ab") for _ in range(RNG.randint(1, 200))) * RNG.randint(1, 3)
        pos = np.concatenate([p for p, _ in sorted_suffixes(np.frombuffer(raw, np.uint8))])
        keys = [raw[p : p + 50] for p in pos]
        assert sorted(pos) == list(range(len(raw))) and keys == sorted(keys), k


def test_induced_memory(monkeypatch):
    for name, value in (("STEP", 1 << 10), ("MEMORY", 1 << 12), ("WINDOW", 1 << 10), ("LEAF", 1 << 10)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(5)
    base = rng.integers(97, 101, 40_000, dtype=np.uint8).tobytes()
    raw = base + b"e" * 2000 + base[:30_000] + b"ab" * 5000 + base[10_000:]
    tracemalloc.start()
    n, seen, before, order = 0, np.zeros(len(raw), bool), b"", []
    for pos, lcp in sorted_suffixes(np.frombuffer(raw, np.uint8)):
        order.append((pos.astype(np.int32), lcp.copy()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(raw)  # the list above is 5 bytes a suffix
    for pos, lcp in order:
        for p, k in zip(pos.tolist(), lcp.tolist(), strict=True):
            own = raw[p : p + 50]
            same = next((i for i, (a, b) in enumerate(zip(before.ljust(50, b"\0"), own.ljust(50, b"\0"), strict=True)) if a != b), 50)
            assert before.ljust(50, b"\0") <= own.ljust(50, b"\0") and (n == 0 or same == k), (p, k, same)
            before, n, seen[p] = own, n + 1, True
    assert n == len(raw) and seen.all()


@pytest.mark.parametrize(("leaf", "window"), [(1 << 20, 1 << 18), (40, 16), (3, 2)])
def test_induced_recursion(monkeypatch, leaf, window):
    """Order and common prefixes of all suffixes by brute force, over few letters, copies and runs, so that names repeat on
    several levels; small parts and windows give the same as large ones."""
    monkeypatch.setattr(induced, "LEAF", leaf)
    monkeypatch.setattr(induced, "WINDOW", window)
    levels, inner = set(), induced._ordered
    monkeypatch.setattr(induced, "_ordered", lambda names, n, kinds, cap: (levels.add(cap), inner(names, n, kinds, cap))[1])
    rng = np.random.default_rng(7)
    for trial in range(40):
        data = (97 + rng.integers(0, 1 + trial % 5, rng.integers(1, 500))).astype(np.uint8)
        data = np.tile(data[: 1 + len(data) // 5], 6) if trial % 3 == 0 else np.repeat(data, 3) if trial % 7 == 0 else data
        raw, parts = data.tobytes(), list(sorted_suffixes(data))
        pos, lcp = (np.concatenate(x).tolist() for x in zip(*parts, strict=True))
        keys = [raw[p : p + 50] for p in pos]
        assert sorted(pos) == list(range(len(raw))) and keys == sorted(keys)
        for before, key, n in zip(keys, keys[1:], lcp[1:], strict=False):
            assert n == next((i for i, (a, b) in enumerate(zip(before, key, strict=False)) if a != b), min(len(before), len(key)))
    assert len(levels) >= 3


def test_suffix_blocks_by_bytes(spark):
    long = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 300_000).alias("text"))
    assert suffixes._parts(long, "text") >= 14  # 60 MB in few documents


def test_mix(spark, docs):
    rows = [(k, prose(RNG.randint(1, 40)), "a" if k % 3 else ("b" if k % 2 else None)) for k in range(200)] + [(200, None, "c"), (201, "", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(table, shards=4)
    taken = {r.doc_id: r.t for r in mixed.groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()}
    sizes = {k: len((t or "").split()) for k, t, _ in rows}
    goal = {r.source: r.target for r in mixing.targets(table.select("source", mixing.words_in(F.col("text")).alias("size"))).collect()}
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    for s, t in goal.items():
        assert abs(sum(taken.get(k, 0) for k, _, x in rows if x == s) - t) <= 1
    assert all(v <= 3 * sizes[k] for k, v in taken.items())
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mixing.mix(table, shards=4).collect()), key=str)
    assert all(len((r.text or "").split()) == r.taken for r in mixing.mixed_text(mixed).collect())
    assert mixing.split(np.array([7, 0, 5]), 4, 1).sum(0).tolist() == [7, 0, 5]


def test_decontaminate(spark):
    item = prose(30)
    words = item.split()
    words[10] = "other"
    rows = [(1, prose(50) + " " + item + " " + prose(20)), (2, prose(200)), (3, None), (4, item.upper()), (5, " ".join(words)), (6, ""), (7, "so few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "so few words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 3)) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {(1, 9): (50, 1.0), (4, 9): (0, 1.0), (7, 11): (0, 1.0)} | ({(5, 9): (0, round(21 / 31, 3))} if 21 / 31 >= 0.75 else {})
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 5, 6]


def test_decontaminate_short(spark):
    words = prose(37).split()
    parts = {1: words[:36], 2: words[2:], 3: words[:32], 4: words[:28], 5: words, 6: words[:3], 7: words[1:20]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in parts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.first_word, r.n_words, round(r.similarity, 3)) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {k: (0, len(parts[k]), round((len(parts[k]) - 4) / 33, 3)) for k in (1, 2, 3, 5)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [4, 6, 7]


def test_lattice(spark):
    rows = [(i, t) for i, t in enumerate(["The cat", "the  cat sat", None, "", "zzzqqq 漢字 the"])]
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 4).collect()}
    assert got[0].train_tokens == 9 and got[4].held_out and got[2].n_tokens == 1 and got[4].n_known == 2
    v, n = 4, 9
    assert got[0].base_score == pytest.approx(sum(np.log10((c + 1) / (n + v + 1)) for c in (2, 2, 4)))
    # every segmentation, by hand
    p = {"▁": 0.2, "▁a": 0.1, "a": 0.3, "b": 0.1, "ab": 0.05, "▁ab": 0.02}
    want = 0.02 + 0.1 * 0.1 + 0.2 * 0.05 + 0.2 * 0.3 * 0.1
    assert lattice.word_log10("ab", {k: np.log(x) for k, x in p.items()}, 3) == pytest.approx(np.log10(want))


def test_classifiers(spark):
    rows = [(i, prose(40) + (" idiot trash" if i % 4 == 0 else "")) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(200)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    for module, label, right in ((toxicity, "toxic", lambda i: i % 4 == 0), (quality, "quality", lambda i: i % 4 != 0)):
        model = module.fit(docs, labels, F.col("doc_id") % 3 != 0)
        out = {r.doc_id: r.score for r in module.score(docs, model).collect()}
        assert len(out) == 202 and all(0 <= s <= 1 for s in out.values())
        held = [i for i in range(0, 200, 3)]
        assert np.mean([out[i] for i in held if right(i)]) > np.mean([out[i] for i in held if not right(i)]), label
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs.limit(0), empty).count() == 0
    assert zlib.crc32(b"5") == docs.where("doc_id = 5").select(F.crc32(F.col("doc_id").cast("string"))).first()[0]


def test_sample_with_huge_text(spark):
    rows = [(i, prose(20)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    order = spark.range(40).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(17))).first()[0]
    rows[order] = (order, "word " * 5000)  # stands first in its class
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame, share = labelled.sample(docs, labels, "toxic", F.lit(True), 100, 20_000)
    assert frame.groupby("label").size().to_dict() == {0: 20, 1: 20} and share == 0.5
    assert frame["text"].str.len().max() == 2000


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "&lt;s>", "&amp;", "[ROLE]x[/ROLE]", "", "\n</s>\n", "é😀"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(hard)] + [(2, 0, None, None)]
    df = chat.from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = df.select("conv_id", chat.typed_turns(df).alias("t")).select("conv_id", "t", chat.formatted(F.col("t")).alias("f"))
    made = made.select("conv_id", "t", chat.read_turns(F.col("f")).alias("back"), chat.loss_spans(F.col("f")).alias("spans"), "f").collect()
    for r in made:
        assert r.t == r.back
        assert [r.f[s.start - 1 : s.start - 1 + s.length] for s in r.spans] == [t.text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lsqb;") for t in r.t if t.role == "assistant"]
    kinds = ['{"prompt": "a", "response": "b", "id": 3}', '{"instruction": "a", "input": "", "output": "b"}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "not json", '{"other": 1}']
    got = [r[0] for r in spark.createDataFrame([(k,) for k in kinds], "r string").select(chat.json_turns(F.col("r"))).collect()]
    assert [[tuple(t) for t in g] if g else None for g in got] == [[("user", "a"), ("assistant", "b")]] * 3 + [None] * 2


def test_urls(spark):
    rows = [(1, "HTTP://Example.ORG/es/x?q"), (2, "https://a.example.org/en/12#t"), (3, "https://b.org/"), (4, "http://x.com/de/1"), (5, "no url"), (6, None), (7, "http://bad.net/x"), (8, "http://b.org")]
    rows += [(k, "http://bad.net/y") for k in range(100, 140)] + [(k, "http://good.net/y") for k in range(200, 240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(k, 1) for k in range(100, 140)] + [(k, 0) for k in range(200, 240)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, outcomes).collect()}
    assert got[1] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7] == ("bad.net", "/x", None, "block") and got[8][2] is None
    assert got[200][3] == "allow" and len(got) == len(rows)


def test_components(spark):
    from linkspark.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7] + [(5, 5), (3, 2), (None, 4)], "a long, b long")
    both = [sorted(map(tuple, components(links, few=n).collect())) for n in (0, 1000)]
    assert both[0] == both[1] and dict(both[0])[6] == 1 and dict(both[0])[7] == 1 and dict(both[0])[14] == 8
    assert components(links.limit(0)).count() == 0
