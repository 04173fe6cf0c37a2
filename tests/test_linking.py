"""Formulas, units, files of instruments, drop folders: literal cases, nulls, empty tables, repeated batches."""

import pytest
from pyspark.sql import functions as F

from linkspark.operators import formulas, grounding, profile
from linkspark.sources import dialects, readers
from linkspark.sources.dialects import Dialect
from linkspark.streaming import incremental


def test_hosts(spark):
    rows = spark.createDataFrame([("Bi2Te2.7Se0.3", None), ("Hf0.75Zr0.25NiSn", " half-Heusler"), ("Pb0.98Na0.02Te", "PbTe"), ("Polymer blend", "Polymer"), (None, None), ("", "SnSe"), ("Te0.01", "")], "c string, f string")
    got = {r.c: r for r in formulas.hosts(rows, "c", "f").collect()}
    names = lambda c: [x.formula for x in got[c].candidates or []]
    assert names("Bi2Te2.7Se0.3") == ["Bi2Te3"] and got["Bi2Te2.7Se0.3"].candidates[0].method == "rounded stoichiometry"
    assert names("Hf0.75Zr0.25NiSn") == ["HfNiSn"] and got["Hf0.75Zr0.25NiSn"].substituents == ["Zr"]
    assert names("Pb0.98Na0.02Te") == ["PbTe"] and [tuple(d) for d in got["Pb0.98Na0.02Te"].dopants] == [("Na", 0.02)]
    assert got["Polymer blend"].candidates is None and got[None].candidates is None and got[None].dopants == [] and names("") == ["SnSe"] and names("Te0.01") == []
    assert formulas.hosts(rows.limit(0), "c", "f").count() == 0


def test_links_without_host(spark):
    rows = spark.createDataFrame([("s", "k", None, None, None, [("Na", 0.1)], ["Zr"], None), (None, "k", "X", "m", "low", [], [], None)], "sample string, key string, formula string, method string, confidence string, dopants array<struct<element:string,amount:double>>, substituents array<string>, reference_id string")
    q = formulas.link_quads(rows, "http://x/", "2020")
    assert q.count() == 5 and {r.o for r in q.where("p like 'sd:match%'").collect()} == {"no host resolvable", "unresolved"}
    assert formulas.bridge(q).count() == 0


def test_units(spark):
    catalog = spark.createDataFrame([("K", "kelvin", "K", ["K"], True), ("KY", "kayser", "K", ["Ky"], False), ("OHM-M", "ohm metre", "Ω·m", ["Ohm.m"], None)], "name string, label string, symbol string, ucum array<string>, si boolean")
    spelt = spark.createDataFrame([("Ohm*m", "OHM-M")], "spelling string, name string")
    asked = spark.createDataFrame([("K",), (" OHM*M",), ("Kelvin",), ("kay",), ("",), (None,)], "query string")
    got = sorted(map(tuple, grounding.units(asked, catalog, spelt).collect()))
    assert got == [("K", "K", "symbol", 1, True), ("K", "KY", "symbol", 2, True), ("Kelvin", "K", "label", 1, True), ("OHM*M", "OHM-M", "alias", 1, True), ("kay", "KY", "suggestion", 1, False)]


def test_quantity_kinds(spark):
    kinds = spark.createDataFrame([("SeebeckCoefficient", "Seebeck Coefficient", ["V-PER-K"]), ("ThermalConductivity", "Thermal Conductivity", ["W"]), ("ThermalResistivity", "Thermal Resistivity", ["R"])], "name string, label string, units array<string>")
    asked = spark.createDataFrame([("S", "V-PER-K"), ("Thermal conductivity", None), ("thermal", "R"), (None, None)], "query string, unit string")
    got = sorted((r.query, r.name, r.score) for r in grounding.quantity_kinds(asked, kinds).collect())
    assert got == [("S", "SeebeckCoefficient", 25), ("Thermal conductivity", "ThermalConductivity", 100), ("thermal", "ThermalResistivity", 94)]


def test_dialects(spark):
    data = [("a", "名前,値\n".encode("cp932") + b"1,2\n" * 5), ("b", b"Title line\r\n" + b"1.0\t2.0\r\n" * 6), ("c", b""), ("d", None), ("e", "﻿x|y\n".encode() + b"1|2\n" * 5), ("f", "x\n1".encode("utf-16"))]
    rows = spark.createDataFrame(data, "file string, content binary")
    got = {r.file: tuple(r)[1:] for r in dialects.detected(rows).collect()}
    assert got == {"a": ("cp932", ",", 0), "b": ("utf-8-sig", "\t", 1), "c": ("utf-8-sig", ",", 0), "d": ("utf-8-sig", ",", 0), "e": ("utf-8-sig", "|", 0), "f": ("utf-16", ",", 0)}
    first = dialects.cells(rows.where("file = 'a'"), Dialect("cp932")).where("row = 1").first()
    assert first.cells == ["名前", "値"]
    meta = spark.createDataFrame([("m", b"S1, T=300 K,T=4,\n\nx,y,z\n1,2\n")], "file string, content binary")
    said = dialects.preamble(meta, Dialect(skip_rows=2, preamble="keyvalue_cells")).orderBy("place").collect()
    assert [(r.name, r.value, r.line, r.named) for r in said] == [("preamble_1", "S1", 1, False), ("T", "300 K", 1, True), ("T_2", "4", 1, True)]
    lines = dialects.preamble(meta, Dialect(skip_rows=1, preamble="lines")).first()
    assert (lines.name, lines.value) == ("preamble_1", "S1, T=300 K,T=4,") and dialects.preamble(meta, Dialect()).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        dialects.cells(rows.where("file = 'a'"), Dialect()).collect()


def test_profiles(spark):
    rows = spark.createDataFrame([(2, ["c", "a"]), (1, ["a", None, "b"]), (3, None)], "row long, names array<string>")
    assert [tuple(r) for r in profile.column_order(rows, "row", "names").orderBy("row", "position").collect()] == [("a", 1, 0), ("b", 1, 2), ("c", 2, 0)]
    assert profile.transform_coverage(spark.createDataFrame([], "dataset string, kind string")).count() == 0


def test_drop_dir(spark, tmp_path):
    root, target, found, hubs = (str(tmp_path / n) for n in ("in", "live", "found", "hubs"))
    rows = spark.createDataFrame([("x", "rdf:type", "T"), ("y", "p", "1")], "s string, p string, o string")
    rows.coalesce(1).write.parquet(f"{root}/d1/a")
    rows.coalesce(1).write.parquet(f"{root}/.hidden/a")
    seen = []
    incremental.drop_dir(spark, root, "s string, p string, o string", lambda df, i: seen.extend((r.dataset, r.s) for r in df.collect()), str(tmp_path / "c1"))
    assert sorted(seen) == [("d1", "x"), ("d1", "y")]
    check = incremental.rechecked(target, found, ["s", "p", "o"], lambda live, classes: live.join(classes, live.o == classes["class"]).select("s"))
    for _ in range(2):  # the same batch again
        check(rows, 0)
    assert spark.read.parquet(target).count() == 2 and spark.read.parquet(found).count() == 1
    hub = incremental.refreshed(target, hubs, ["s", "p", "o"], lambda live: live.groupBy("p").agg(F.count("*").alias("n")))
    hub(rows, 3)
    assert spark.read.parquet(f"{hubs}/build=3").count() == 2
    incremental.drop_dir(spark, root, "s string, p string, o string", check, str(tmp_path / "c2"))
    assert spark.read.parquet(target).count() == 2


def test_sinks(spark, tmp_path):
    q = spark.range(10).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("s"))
    readers.write_graph(q.coalesce(1), str(tmp_path / "q"), 4)
    assert len(list((tmp_path / "q" / "g=g").glob("*.parquet"))) == 3
    for _ in range(2):
        readers.accumulate(q, str(tmp_path / "s"), "b1")
    readers.accumulate(q, str(tmp_path / "s"), "b2")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


def test_detected_tables(spark):
    table = "\n".join(f"{i}\t{i * 2}\t{i * 3}" for i in range(8))
    files = {
        "comma": b"a,b\n1,2\n",
        "quoted": b'a,b\n"x,\n""y",2\n3,4\n',
        "tab": ("# made by\nsome tool, v1\n\n" + table).encode(),
        "bom": b"\xef\xbb\xbf" + table.encode(),
        "wide": ("title, one\n" + table).encode("utf-16"),
        "cp": "温度,圧力\n1,2\n".encode("cp932"),
        "latin": "é\xff,b\n1,2\n".encode("latin-1") + b"\x81\x20,1\n",
        "blank": b"\n".join(b"%d  %d %d" % (i, i, i) for i in range(6)),
        "head": b"time   value, note\n" + b"\n".join(b"%d   %d" % (i, i) for i in range(9)),
        "bar": b"x|y\n" * 6,
        "semi": b"k;l;m\n" * 4 + b"no\n" + b"k;l;m\n" * 6,
        "few": b"x|y\n" * 3,
        "empty": b"",
        "spaces": b" \n \n",
        "long": b"1;2\n" * 400_000,
        "crlf": b"note\r\n" + b"1,2,3\r\n" * 5,
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "file string, content binary")
    got = {r.file: tuple(r)[1:] for r in dialects.detected(rows).collect()}
    assert got == {
        "comma": ("utf-8-sig", ",", 0),
        "quoted": ("utf-8-sig", ",", 0),
        "tab": ("utf-8-sig", "\t", 3),
        "bom": ("utf-8-sig", "\t", 0),
        "wide": ("utf-16", "\t", 1),
        "cp": ("cp932", ",", 0),
        "latin": ("latin-1", ",", 0),
        "blank": ("utf-8-sig", "whitespace", 0),
        "head": ("utf-8-sig", "whitespace", 1),
        "bar": ("utf-8-sig", "|", 0),
        "semi": ("utf-8-sig", ";", 5),
        "few": ("utf-8-sig", ",", 0),
        "empty": ("utf-8-sig", ",", 0),
        "spaces": ("utf-8-sig", ",", 0),
        "long": ("utf-8-sig", ";", 0),
        "crlf": ("utf-8-sig", ",", 1),
        "null": ("utf-8-sig", ",", 0),
    }


def _by_hand(queries, terms, n):
    """Every pair scored, in plain Python."""
    import re

    def parts(x):
        x = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", x)
        return [w for w in re.split(r"[^A-Za-z0-9]+", x.lower()) if w]

    out = set()
    for label, kind, domain in {(a or "", b or "", c or "") for a, b, c in queries}:
        p, w, found = "".join(parts(label)), set(parts(label)), []
        for prefix, name, k, called, d in {tuple(x or "" for x in t) for t in terms}:
            m = parts(name)
            if not p or not m or kind not in ("", k) or domain not in ("", d):
                continue
            core = m[1:] if k == "property" and m[0] in grounding.LEADS else m
            y, np, lp = set(m) | set(parts(called)), "".join(m), "".join(parts(called))
            if p in (np, lp, "".join(core)):
                score = 100, "exact"
            elif w == y:
                score = 90, "exact_tokens"
            elif w <= y:
                score = 70 + max(0, 10 - len(y) + len(w)), "tokens_subset"
            elif p in np or np in p or p in lp:
                score = 50, "substring"
            elif w & y:
                score = 20 + len(w & y), "overlap"
            else:
                continue
            found.append((-score[0], len(name), prefix, name, k, called, d, score[1]))
        for place, (s, _, prefix, name, k, _, d, match) in enumerate(sorted(found)[:n], 1):
            out.add((label, kind, domain, prefix, name, k, d, -s, match, place))
    return out


def test_candidates_as_all_pairs(spark):
    import random

    rng = random.Random(5)
    common, rare = ["the", "of", "has", "a", "is"], ["age", "cell", "unit", "crystal", "lattice", "mass", "xy", "cellUnit", "HTMLPage", "q"]
    some = lambda k: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(k))
    terms = [(rng.choice(["u", "v", None]), some(rng.randint(1, 5)).title().replace(" ", rng.choice(["", " ", "_"])), rng.choice(["class", "property", None]), rng.choice([None, some(2)]), rng.choice(["m", "n", None])) for _ in range(250)]
    terms += [(None, None, None, None, None), ("u", "", "class", "x", "m"), ("u", "--", "class", "age", "m"), ("u", "has", "property", "", "m"), ("u", "the " * 400, "class", "", "m"), terms[0]]
    queries = [(some(rng.randint(1, 6)), rng.choice(["class", "property", "", None, "other"]), rng.choice(["m", "", None, "none"])) for _ in range(60)]
    queries += [(None, None, None), ("", "class", ""), ("!!", "", ""), ("e", "", ""), ("ll", "class", "m"), ("zzzz", "", ""), ("the of a " * 200, "", ""), queries[0]]
    asked = spark.createDataFrame(queries, "label string, kind string, domain string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(terms, "prefix string, name string, kind string, label string, domain string").withColumn("place", F.lit(1)).withColumn("p", F.lit(2))
    for n in (1, 4):
        got = [tuple(r) for r in grounding.candidates(asked, known, n).collect()]
        assert len(got) == len(set(got)) and set(got) == _by_hand(queries, terms, n)
    assert grounding.candidates(asked.limit(0), known).count() == 0 and grounding.candidates(asked, known.limit(0)).count() == 0


def test_property_without_lead(spark):
    terms = spark.createDataFrame([("c", "hasSpaceGroup", "property"), ("c", "SpaceGroup", "class"), ("c", "Group", "class")], "prefix string, name string, kind string")
    asked = spark.createDataFrame([("space group", "property"), ("space group", None)], "label string, kind string")
    got = sorted((r.asked_kind, r.place, r.name, r.match) for r in grounding.candidates(asked, terms).collect())
    assert got == [("", 1, "SpaceGroup", "exact"), ("", 2, "hasSpaceGroup", "exact"), ("", 3, "Group", "substring"), ("property", 1, "hasSpaceGroup", "exact")]


def test_candidates_send_no_word_lists_whole(spark):
    known = spark.range(400).select(F.concat_ws(" ", F.lit("common"), F.col("id") % 20, "id").alias("name"))
    plan = grounding.candidates(known.select(F.col("name").alias("label")), known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") > 1 and plan.count("BroadcastHashJoin") <= plan.count("LeftSemi, BuildRight")  # the scopes alone


def test_link_quads_are_dealt_by_their_number(spark, monkeypatch):
    from linkspark.operators import formulas

    monkeypatch.setattr(formulas, "ROWS", 10)
    rows = spark.range(100).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("n/"), "id").alias("sample"), F.lit("PbTe").alias("formula"), F.lit("m").alias("method"), F.lit("high").alias("confidence"), F.expr("array(named_struct('element', 'Na', 'amount', 0.02D))").alias("dopants"), F.array(F.lit("Se")).alias("substituents"), F.lit("r").alias("reference_id"))
    made = formulas.link_quads(rows.unionByName(rows), "n/", "2020-01-01T00:00:00Z")
    assert ", 240)" in made._jdf.queryExecution().executedPlan().toString()  # 200 rows of about 12 quads
    got = made.collect()
    assert len(got) == len(set(got)) == 100 * 10 + 4


def _head(i):
    return f"a: {i}\nb: x\nc d\n1 {i}\n".encode()


def test_heads_are_dealt_by_their_lines(spark, monkeypatch):
    content = spark.createDataFrame([(i, _head(i)) for i in range(400)], "file long, content binary")
    card = Dialect(delimiter=dialects.WHITESPACE, skip_rows=2, preamble="keyvalue")
    monkeypatch.setattr(dialects, "LINES", 20, raising=False)
    tasks = dialects.preamble(content, card).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    assert tasks.agg(F.max("n")).first()[0] <= 60 and tasks.count() > 30


def test_files_meet_their_heads_as_rows(spark, monkeypatch):
    content = spark.createDataFrame([(i, _head(i)) for i in range(400)] + [(400, b""), (401, None), (402, b"a: 1\n\n\n\n")], "file long, content binary")
    card = Dialect(delimiter=dialects.WHITESPACE, skip_rows=2, preamble="keyvalue")
    assert "Exchange" not in dialects.cells(content, card)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dialects, "BYTES", 200, raising=False)
    rows = dialects.broadcast_rows(content, card)
    got = sorted((r.file, r.row, tuple(r.cells), tuple(sorted(r.meta.items()))) for r in rows.collect())
    said = lambda i: (("a", str(i)), ("b", "x"))
    assert got == sorted(x for i in range(400) for x in ((i, 1, ("c", "d"), said(i)), (i, 2, ("1", str(i)), said(i))))
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("file").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] <= 40 and tasks.count() > 20


def test_few_large_parts_of_files_are_dealt(spark, monkeypatch):
    content = spark.range(0, 300, 1, 1).select(F.col("id").alias("file"), F.encode(F.format_string("a,%d\nb,1\nc,2\nd,3\ne,4\n", "id"), "UTF-8").alias("content"))
    monkeypatch.setattr(dialects, "FILES", 20, raising=False)
    found = dialects.detected(content)
    assert found.where("encoding = 'utf-8-sig' and delimiter = ',' and skip_rows = 0").count() == 300
    assert found.groupBy(F.spark_partition_id().alias("task")).count().count() >= 12


def test_fusion_makes_what_it_asks_for(spark):
    from linkspark.operators.mapping import Map, Property, all_quads, by_predicate, quads

    curves = spark.createDataFrame([(1, 7, "f", "2.5"), (1, 7, "f", "2.5"), (2, 8, "f", "x"), (3, 9, "h", "1")], "k long, s long, f string, y string")
    samples = spark.createDataFrame([(7, "A"), (8, "B"), (9, None)], "s long, c string")
    curve = Map("c/{k}", ("sd:Curve",), (Property("sd:ofSample", template="s/{s}"), Property("prov:wasDerivedFrom", template="f/{f}"), Property("sd:yMax", column="y")))
    figure = Map("f/{f}", (), (Property("rdfs:label", column="f"),))
    sample = Map("s/{s}", (), (Property("sd:compositionString", column="c"), Property("lit:conditionStatedIn", template="t/{c}")))
    stated = Map("t/{c}", (), (Property("nif:anchorOf", column="c"), Property("prov:wasQuotedFrom", template="p/{c}")))
    maps = (curves, curve, 3), (curves, figure, None), (samples, sample, 3), (samples, stated, None)
    whole = formulas.fusion(all_quads(*[quads(t, m, "g", distinct=False) for t, m, _ in maps]))
    by = formulas.fusion(by_predicate(*maps), parts=3)
    rows = sorted(map(tuple, by.collect()), key=str)
    assert rows == sorted(map(tuple, whole.collect()), key=str) and [(r[0], r[1], r[3], r[5], r[9]) for r in rows] == [("c/1", "A", 2.5, "f", "p/A"), ("c/2", "B", None, "f", "p/B")]
    assert set(by_predicate(*maps)("none").columns) == {"s", "p", "o"}
    assert sorted(map(tuple, formulas.fusion(by_predicate(*maps), "B").select("curve").collect())) == [("c/2",)]
