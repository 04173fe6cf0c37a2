"""Delimited files in ranges, source sets, foreign keys, the batch log."""

import csv
import random

import pytest

from linkspark.sources import delimited


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def read(path, sep=","):
    with open(path, encoding="utf-8-sig", newline="") as f:
        head, *rows = [r for r in csv.reader(f, delimiter=sep) if any(c.strip() for c in r) or len(r) > 1]
    clean = lambda c: c.replace("\r\n", "\n")
    return head, [tuple(clean(c) for c in (r + [""] * len(head))[: len(head)]) for r in rows]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("feeds", [0.0, 0.02, 0.6])
def test_records_in_ranges(spark, tmp_path, small_ranges, ends, feeds):
    rng = random.Random(f"{ends}{feeds}")
    path = tmp_path / "a.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, lineterminator=ends)
        w.writerow(["id", "text", "x,y"])
        for i in range(400):
            word = "".join(rng.choice('ab",;é ') for _ in range(rng.randint(0, 12)))
            w.writerow([i, ends.join([word] * rng.randint(2, 30)) if rng.random() < feeds else word, '5" pipe' if i % 7 else '""'])
        f.write(f"1000,short{ends}{ends}1001,a,b,too,many{ends}")
        f.write(f'1002,5" pipe,b"c{ends}')
    head, want = read(path)
    df = delimited.table(spark, str(path))
    assert df.columns == head and sorted(map(tuple, df.collect())) == sorted(want)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10  # the file is read in ranges


def test_folder_tabs_and_empty(spark, tmp_path, small_ranges):
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"{k}.csv").write_text("a,a,\n" + "".join(f'{k},"x\n{i}",\n' for i in range(60)))
    df = delimited.table(spark, str(tmp_path / "t"))
    assert df.columns == ["a", "a_2", "_c2"] and df.count() == 180 and {r._c2 for r in df.collect()} == {""}
    (tmp_path / "b.tsv").write_text('p\tq\n"1\t2"\t3\n')
    assert [tuple(r) for r in delimited.table(spark, str(tmp_path / "b.tsv")).collect()] == [("1\t2", "3")]
    (tmp_path / "e.csv").write_text("")
    assert delimited.table(spark, str(tmp_path / "e.csv")).columns == []
    (tmp_path / "h.csv").write_text("only,header\n")
    assert delimited.table(spark, str(tmp_path / "h.csv")).count() == 0


def test_source_set(spark, tmp_path):
    from linkspark.sources.source_set import inclusions, source_set

    (tmp_path / "meta.csv").write_text("sample_id,name,note\nS0,zero,\nS1,one, x \nS9,,y\n")
    (tmp_path / "inst.txt").write_bytes("\r\n".join(["前置き行", "sample_id\tvalue", *[f"S{i}\t{i}" for i in range(6)]]).encode("cp932") + b"\r\n")
    (tmp_path / "wrap.json").write_text('{"took": 3, "hits": [{"x": 1}], "docs": [{"sample_id": "S1", "of": {"k": true}}, {"sample_id": "S5", "list": [1]}], "tags": ["a", "b", "c"]}')
    (tmp_path / "top.geojson").write_text(' [{"name": "one"}, {"name": null}]')
    (tmp_path / "flat.json").write_text('{"name": "zero", "tags": ["a"]}')
    (tmp_path / "plain.json").write_text("[1, null, \"x\"]")
    (tmp_path / "doc.xml").write_text("<article><body/></article>")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "t.tsv").write_text("name\tz\none\t1\n")
    got = source_set(spark, str(tmp_path))
    assert {n: s.kind for n, s in got.items()} == {"meta.csv": "table", "inst.txt": "table", "wrap.json": "json", "top.geojson": "json", "flat.json": "json", "plain.json": "json", "doc.xml": "xml", "t.tsv": "table"}
    assert got["inst.txt"].dialect.encoding == "cp932" and sorted(map(tuple, got["inst.txt"].rows.collect()))[0] == ("S0", "0")
    rows = [r.asDict() for r in got["wrap.json"].rows.collect()]
    assert rows == [{"list": "", "of.k": "true", "sample_id": "S1"}, {"list": '["1"]', "of.k": "", "sample_id": "S5"}]
    assert sorted(r.value for r in got["plain.json"].rows.collect()) == ["", "1", "x"] and got["flat.json"].rows.first().tags == '["a"]'
    assert [r.value for r in source_set(spark, str(tmp_path), record_path="tags")["wrap.json"].rows.collect()] == ["a", "b", "c"]
    keys = inclusions({n: s.rows for n, s in got.items() if s.kind != "xml"})
    found = {(r.from_source, r.to_source, r.from_column): (r.overlap, r.from_distinct, r.ratio) for r in keys.collect()}
    assert found == {
        ("flat.json", "meta.csv", "name"): (1, 1, 1.0),
        ("inst.txt", "meta.csv", "sample_id"): (2, 6, 2 / 6),
        ("inst.txt", "wrap.json", "sample_id"): (2, 6, 2 / 6),
        ("inst.txt", "plain.json", "value"): (1, 6, 1 / 6),
        ("meta.csv", "t.tsv", "name"): (1, 2, 0.5),
        ("meta.csv", "top.geojson", "name"): (1, 2, 0.5),
        ("meta.csv", "wrap.json", "sample_id"): (1, 3, 1 / 3),
        ("t.tsv", "top.geojson", "name"): (1, 1, 1.0),
    }
    assert inclusions({"a": got["meta.csv"].rows}).count() == 0


def test_digest_and_log(spark, tmp_path):
    from linkspark.streaming import batches

    df = spark.range(9000).selectExpr("id", "case when id % 3 > 0 then concat('x', id) end as v")
    one = batches.digest(df)
    assert one == batches.digest(df.repartition(7).select("v", "id")) and len(one) == 64
    assert one != batches.digest(df.where("id > 0")) and one != batches.digest(df.unionByName(df.limit(1)))
    pairs = [spark.createDataFrame([r], "a string, b string") for r in (("1", "23"), ("12", "3"), (None, "3"), ("", "3"), ("-", "3"))]
    assert len({batches.digest(p) for p in pairs}) == 5
    assert batches.digest(df.limit(0)) == batches.digest(df.limit(0)) != one
    log = batches.Log(spark, str(tmp_path / "l"))
    assert log.entries() == [] and log.commit({"x": 1}, 0) == {"x": 1, "seq": 1}
    assert log.commit({"x": 2}, 0) is None and log.commit({"x": 3}, 1)["seq"] == 2 and [e["x"] for e in log.entries()] == [1, 3]


def test_batches_count_once(spark, tmp_path, monkeypatch):
    from linkspark.streaming import batches

    root = str(tmp_path / "t")
    control = spark.createDataFrame([("d", "promoted"), ("r", "retracted")], "dataset string, status string")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "id long, p string")
    for bad in ("r", "none"):
        with pytest.raises(ValueError):
            batches.append_batch(first, root, ["id"], control, bad)
    assert batches.live(spark, root) is None
    # the run ends behind the data and before the log
    commit = batches.Log.commit
    monkeypatch.setattr(batches.Log, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        batches.append_batch(first, root, ["id"], control, "d", by="p")
    assert batches.live(spark, root) is None
    monkeypatch.setattr(batches.Log, "commit", commit)
    done = batches.append_batch(first, root, ["id"], control, "d", by="p")
    assert (done.seq, done.rows, done.fresh, done.replay) == (1, 4, 3, False)
    again = batches.append_batch(first.repartition(3), root, ["id"], control, "d", by="p")
    assert again == batches.Outcome(done.batch, 1, 4, 3, True)
    # another writer's entry comes between: new rows are found again
    second, third = spark.createDataFrame([(3, "a"), (1, "a")], "id long, p string"), spark.createDataFrame([(3, "a"), (4, "b")], "id long, p string")
    raced = []

    def late(self, entry, after):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(batches.Log, "commit", commit)
            batches.append_batch(third, root, ["id"], by="p")
            monkeypatch.setattr(batches.Log, "commit", late)
        return commit(self, entry, after)

    monkeypatch.setattr(batches.Log, "commit", late)
    got = batches.append_batch(second, root, ["id"], by="p")
    assert (got.seq, got.fresh) == (3, 0)
    assert sorted((r.id or 0, r.p) for r in batches.live(spark, root).collect()) == [(0, "c"), (1, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert batches.append_batch(first.limit(0), root, ["id"]).fresh == 0


def test_hub_follows_batches(spark, tmp_path):
    from linkspark.operators.crosswalk import hub
    from linkspark.streaming import batches

    rng = random.Random(9)
    root, hubs = str(tmp_path / "v"), str(tmp_path / "h")
    said, sizes = [], []
    for n in range(4):
        rows = [(f"p{rng.randint(0, 3)}", f"e{rng.randint(0, 50)}", f"Key {rng.randint(0, 40)}") for _ in range(60 if not n else 5)]
        said += rows
        values = batches.keyed_values(spark.createDataFrame(rows, "participant string, entity string, value string"), buckets=16)
        batches.append_batch(values, root, ["participant", "entity", "value"], by="bucket")
        if n == 1:
            continue  # two batches, one build
        sizes.append(len(batches.refreshed_hub(spark, root, hubs, "k", buckets=16)))
        want = hub(spark.createDataFrame(said, "participant string, entity string, value string"), "k")
        assert sorted(map(tuple, batches.hub_rows(spark, hubs).collect())) == sorted(map(tuple, want.collect()))
    assert sizes[0] > 8 and sizes[2] <= 5 and batches.refreshed_hub(spark, root, hubs, "k", buckets=16) == []


def test_recheck_equals_full_check(spark):
    from linkspark.operators import checks
    from linkspark.streaming import batches

    schema = "g string, s string, p string, o string, kind string, dt string, lang string, o_num double"
    q = lambda s, p, o, kind: ("g", s, p, o, kind, "", "", None)
    before = [q("a", "rdf:type", "T", "iri"), q("a", "x:of", "b", "iri"), q("c", "rdf:type", "T", "iri"), q("c", "x:of", "gone", "iri"), q("d", "x:of", "e", "iri"), q("e", "rdf:type", "U", "iri"), q("h", "x:of", "i", "iri"), q("i", "rdf:type", "W", "iri")]
    new = [q("b", "rdf:type", "U", "iri"), q("f", "rdf:type", "T", "iri"), q("f", "x:of", "e", "iri"), q("gone", "rdf:type", "V", "iri")]
    check = lambda df: checks.wrong_class(df, "x:of", "U")
    old, batch = spark.createDataFrame(before, schema), spark.createDataFrame(new, schema)
    every = old.unionByName(batch)
    got = batches.rechecked(check(old), batch, every, check, "o")
    assert {r.o for r in check(every).collect()} == {"gone", "i"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, check(every).collect()))
    assert {r.s for r in batches.touched(batch, every).collect()} >= {"a", "b", "c", "f", "gone"}


def test_ntriples_forms(spark):
    from linkspark.operators.mapping import to_ntriples
    from linkspark.sources import readers

    lines = [
        r'<http://x/a> <http://x/p> "café \U0001F600 \\u0041 \t\"q\"" . # said so',
        '_:b0 <p> _:c.1 .',
        '<http://x/\\u00e9><p><o>.',
        '<a> <p> "x"@en-GB .',
        '<a> <p> "1"^^<int> .#c',
        '<a> <p> "no end .',
        'junk',
        '<a> "p" <o> .',
        "",
        "  # only a comment",
        '<a> <p> "bad \\uD800 half" .',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = readers.ntriples_of(df)
    got = {(r.s, r.p, r.o, r.kind, r.dt, r.lang) for r in rows.collect()}
    assert got == {
        ("http://x/a", "http://x/p", 'café 😀 \\u0041 \t"q"', "literal", "", ""),
        ("_:b0", "p", "_:c.1", "blank", "", ""),
        ("http://x/é", "p", "o", "iri", "", ""),
        ("a", "p", "x", "literal", "", "en-GB"),
        ("a", "p", "1", "literal", "int", ""),
        ("a", "p", "bad � half", "literal", "", ""),
    }
    assert sorted(r.value for r in readers.error_lines(df).collect()) == sorted(['<a> <p> "no end .', "junk", '<a> "p" <o> .'])
    again = readers.ntriples_of(to_ntriples(rows))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.collect()}


def test_observed_write_reads_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from linkspark.sources import readers

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("v")).mapInPandas(count, "id long, v long")
    did = readers.observed_write(rows, F.col("v") > 500, lambda df: df.write.parquet(str(tmp_path / "o")))
    assert (did["rows_in"], did["rows_ok"], did["rows_err"], did["status"]) == (1000, 450, 550, "partial") and did["started"] <= did["ended"]
    assert seen.value == 1000 and spark.read.parquet(str(tmp_path / "o")).count() == 450
    assert readers.observed_write(spark.range(0), F.lit(True), lambda df: df.write.format("noop").mode("overwrite").save())["status"] == "ok"


def test_removals_go_on(spark, tmp_path, monkeypatch):
    from linkspark.operators import versions
    from linkspark.sources.readers import write_graph

    path = str(tmp_path / "q")
    write_graph(spark.createDataFrame([(f"http://x/{v}", str(i)) for v in ("d/v1", "d/v2", "d/v3", "e é") for i in range(5)], "g string, s string"), path)
    control = spark.createDataFrame([("d", "promoted", "http://x/d/v1", "http://x/d/v2")], "dataset string, status string, live string, staged string")
    queue = versions.Removals(spark, path)
    with pytest.raises(ValueError):
        queue.add(versions.replaced(control, "d"), control)
    after = versions.stage(control, "d", "http://x/d/v3")
    queue.add(versions.replaced(control, "d"), after)
    queue.add(spark.createDataFrame([("http://x/e é",), ("http://x/never",), (None,)], "g string"), after)
    assert versions.Removals(spark, path).queued() == ["http://x/d/v2", "http://x/e é", "http://x/never"]
    assert queue.sweep(1) == ["http://x/d/v2"] and queue.queued() == ["http://x/e é", "http://x/never"]
    assert {r.g for r in spark.read.parquet(path).select("g").distinct().collect()} == {"http://x/d/v1", "http://x/d/v3", "http://x/e é"}
    assert len(queue.sweep()) == 2 and queue.sweep() == [] and spark.read.parquet(path).count() == 10


def test_summaries(spark):
    from linkspark.operators import profile

    rows = [("1", "2020-01-01", "[1]", "x", "true", None), (" 2", "2020-01-01T00:00:00Z", '[{"a":1}]', "3", "FALSE", " "), ("2.5", None, "[]", "", "no", None)]
    df = spark.createDataFrame(rows, ["n", "day", "list", "mix", "flag", "none"])
    got = {r["column"]: r for r in profile.summaries(df).collect()}
    assert {k: r.type for k, r in got.items()} == {"n": "double", "day": "dateTime", "list": "json-array", "mix": "string", "flag": "string", "none": "string"}
    assert got["mix"].mixed and got["flag"].mixed and not got["none"].mixed and got["list"].element is None and (got["none"].filled, got["none"].total) == (0, 3)
    assert profile.summaries(df.limit(0)).where("filled = 0 and total = 0").count() == 6
    plan = profile.summaries(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_header_needs_no_records(spark, tmp_path):
    from linkspark.sources import delimited

    (tmp_path / "a.csv").write_text('\n \nk,v\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text('k,v\n3,"p\n\nq"\n')
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = delimited.table(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("1", "x\ny"), ("2", "z"), ("3", "p\n\nq")]
    assert plan(got).count("array_sort") == 1  # records are put together once
    (tmp_path / "a.csv").write_text('"k\n1",v\n1,"x\ny"\n')
    assert delimited.table(spark, str(tmp_path / "a.csv")).columns == ["k\n1", "v"]
    assert list(map(tuple, delimited.table(spark, str(tmp_path / "a.csv")).collect())) == [("1", "x\ny")]
