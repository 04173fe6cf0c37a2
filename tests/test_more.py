"""Operators without a query: snapshots, intake, tools' arguments, designs of maps, edge cases."""

import pytest
from pyspark.sql import functions as F

from linkspark.operators import checks, discovery, graph, tools, versions
from linkspark.operators.mapping import Map, Property, quads, to_ntriples
from linkspark.sources import readers
from linkspark.streaming import incremental


@pytest.fixture(scope="module")
def q(spark):
    rows = spark.createDataFrame([(1, 'a "b"\n\\c', "2"), (2, "x", None), (2, "x", None), (None, "y", "3")], "id long, name string, n string")
    spec = Map("http://o/datasets/d/{id}", ("x:T",), (Property("x:name", column="name", language="en"), Property("x:n", column="n", datatype="xsd:integer")))
    return quads(rows, spec, "d1")


def control(spark):
    return spark.createDataFrame([("d", "promoted", "d1", None)], "dataset string, status string, live string, staged string")


def test_snapshot(spark, q):
    triples, manifest = versions.snapshot(q, control(spark), "d")
    assert manifest.first()["triples"] == 5
    empty = control(spark).limit(0)
    assert [tuple(r) for r in versions.restored(triples, manifest, empty, "v1").collect()] == [("d", "draft", None, "v1")]
    with pytest.raises(ValueError, match="exists"):
        versions.restored(triples, manifest, control(spark), "v1")
    with pytest.raises(ValueError, match="manifest"):
        versions.restored(triples.limit(1), manifest, empty, "v1")
    moved = versions.rebased(triples, "http://o", "http://l")
    assert moved.where("s like 'http://l/datasets/%'").count() == 5 and versions.snapshot(q.limit(0), control(spark), "d")[1].first()["triples"] == 0


def test_ntriples(spark, q):
    back = readers.ntriples_of(to_ntriples(q))
    names = ["s", "p", "o", "kind", "dt", "lang"]
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, q.select(names).collect()))
    lines = spark.createDataFrame([("junk",), ("",), ("# note",), (None,)], "value string")
    assert [r.value for r in readers.error_lines(lines).collect()] == ["junk"] and readers.ntriples_of(lines).count() == 0


def test_write_new(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (None, 2)], "a long, b long")
    for _ in range(2):
        readers.write_new(rows, str(tmp_path / "t"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    good, bad = incremental.quarantined(rows, F.col("a") > 0)
    assert good.count() == 1 and bad.count() == 1 and "quarantined_at" in bad.columns


def test_bind(spark):
    tool = tools.Tool("t", (tools.Param("n", "integer", default=5, low=1, high=9), tools.Param("who", "iri", required=True), tools.Param("kind", "enum", choices=("a",))), lambda t, a: t, ("id",), ("id",))
    assert tools.bind(tool, {"who": "http://x/1", "n": "70"}) == {"n": 9, "who": "http://x/1", "kind": None}
    for args in ({}, {"who": "http://x/1", "other": 1}, {"who": "no iri"}, {"who": "http://x/1", "n": "1.5"}, {"who": "http://x/1", "kind": "b"}, {"who": 'http://x/"'}):
        with pytest.raises(ValueError):
            tools.bind(tool, args)
    rows = tools.run(tool, spark.range(8), {"who": "http://x/1"}, 3).collect()
    assert [tuple(r) for r in rows] == [(0, True), (1, True), (2, True)]


def test_designs():
    a, b = Map("http://x/a/{k}", (), (Property("x:b", template="http://x/b/{m}"),)), Map("http://x/b/{n}", (), (Property("x:v", column="v"),))
    assert checks.no_literal({"a": a, "b": b}) == ["a"] and checks.no_literal({"a": a}) == ["a", "no map writes a literal"]
    assert checks.connectivity({"a": a, "b": b, "c": Map("http://x/c/{k}")}) == [("a", "b"), ("c",)]


def test_edges(spark):
    none = spark.createDataFrame([], "dataset string, predicate string, value string")
    assert discovery.discover(none).count() == 0 and discovery.ladder(none).count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "c")], "a string, b string")
    assert sorted(map(tuple, graph.closure(edges, least=0).where("a is not null").collect())) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
    parts = spark.createDataFrame([("e", "p", "1"), ("e", "p", "2"), ("e", "r", "x"), ("f", "p", "1"), ("f", "r", None)], "entity string, part string, value string")
    assert sorted(tuple(r.key) for r in graph.compound(parts, ["p", "r"]).collect()) == [("1", "x"), ("2", "x")]
    assert tools.passage(spark.createDataFrame([(1, "s", "t"), (2, "s", "u")], "doc_id long, section string, paragraph string"), 1, "s").count() == 1


def test_buckets_grow_with_the_quads(spark, tmp_path):
    from linkspark.operators import mapping
    from linkspark.plans.queries import QUERIES

    spec = mapping.Map("n/{id}", ("T",), (mapping.Property("p:n", column="id"),))
    q = mapping.quads(spark.range(1000), spec, "g", distinct=False)
    made = mapping.stored(q.unionByName(q), "linkspark_test_grown", str(tmp_path / "q"), rows=20 * mapping.ROWS)
    try:
        assert made.count() == 2000 == made.distinct().count()
        described = {r.col_name: r.data_type for r in spark.sql("describe extended linkspark_test_grown").collect()}
        assert described["Num Buckets"] == "20"
    finally:
        spark.sql("drop table linkspark_test_grown")
    plan = QUERIES["set_reuse_new"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s#" not in plan and "hashpartitioning(g#" not in plan  # terms alone are shuffled


def test_schema_summary_gathers_no_subject(spark):
    rows = [("a", "s1", "rdf:type", "C"), ("b", "s1", "rdf:type", "C"), ("a", "s1", "rdf:type", "D"), ("a", "s1", "p", "1"), ("a", "s1", "p", "2"), ("a", "s2", "rdf:type", "C"), ("a", "s3", "p", "1"), ("a", "s2", "rdf:type", None)]
    got = graph.schema_summary(spark.createDataFrame(rows, "g string, s string, p string, o string"))
    found = {(r.kind, r["class"], r.predicate): r.n for r in got.collect()}
    assert found == {("class", "C", None): 2, ("class", "D", None): 1, ("predicate", None, "rdf:type"): 5, ("predicate", None, "p"): 3, ("shape", "C", "rdf:type"): 5, ("shape", "C", "p"): 2, ("shape", "D", "rdf:type"): 3, ("shape", "D", "p"): 2}
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_checks_read_what_is_declared(spark):
    rows = [("s1", "rdf:type", "C", "iri", ""), ("s1", "p", "1", "literal", ""), ("s1", "to", "lost", "iri", ""), ("s2", "to", "lost", "iri", ""), ("s2", "to", "s1", "iri", "")]
    q = spark.createDataFrame(rows, "s string, p string, o string, kind string, dt string")
    got = checks.run_all(q, [("C", "p"), ("C", "none"), ("E", "p")], {"p": "xsd:integer"})
    assert {tuple(r) for r in got.collect()} == {("missing_predicate", "C none", 1), ("dangling", "to", 2), ("datatype", "p", 1)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan(checks.dangling(q)).partition("LeftAnti")[2] and "p#" in plan(checks.missing_predicate(q, [("C", "only")])) and "= only)" in plan(checks.missing_predicate(q, [("C", "only")]))


def test_rows_move_before_their_quads(spark, tmp_path, monkeypatch):
    from linkspark.operators import mapping

    spec = mapping.Map("n/{id}", ("T",), (mapping.Property("p:v", column="v"), mapping.Property("p:w", column="w")))
    other = spark.range(50).selectExpr("id", "'x' as v", "id as w")
    again = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "a", None), (None, "a", 1), (None, "a", 1), (3, None, None)], "id long, v string, w long")
    compared, real = [], mapping._bucket_set
    monkeypatch.setattr(mapping, "_bucket_set", lambda q, n: compared.append(sorted({r.s for r in q.collect()})) or real(q, n))
    want = mapping.quads(other, spec, "g").unionByName(mapping.quads(again, spec, "h")).select(*mapping.QUAD)
    try:
        made = mapping.stored_maps([(other, spec, "g"), (again, spec, "h")], "linkspark_test_moved", str(tmp_path / "q"), rows=20 * mapping.ROWS)
        assert compared == [["n/1"]]  # quads of the one subject that comes again
        assert sorted(map(str, made.select(*mapping.QUAD).collect())) == sorted(map(str, want.collect())) and want.count() == 150 + 7
        assert made.where("g = 'h' and s = 'n/1'").count() == 4 and made.groupBy("s").count().count() == 50
        at = F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1).cast("int")
        assert made.select(at.alias("at"), F.pmod(F.hash("s"), F.lit(20)).alias("of")).where("at <> of or at is null").count() == 0
        assert len(list((tmp_path / "q").rglob("*.parquet"))) <= 3 * 20 * 3  # a file for each map (two if subjects come again), bucket and predicate
    finally:
        spark.sql("drop table if exists linkspark_test_moved")
    with pytest.raises(ValueError, match="one graph"):
        mapping.stored_maps([(other, spec, "g"), (again, spec, "g")], "linkspark_test_none", str(tmp_path / "n"))


@pytest.mark.parametrize("few", [200_000, 1])
def test_class_shapes_need_no_table_of_quads(spark, monkeypatch, few):
    from linkspark.operators import mapping
    from linkspark.plans import queries

    monkeypatch.setattr(mapping, "FEW", few)
    monkeypatch.setattr(queries, "_LOADED", {})
    monkeypatch.setattr(queries, "stored_maps", lambda *a, **k: pytest.fail("the graph was loaded"))
    assert queries.QUERIES["agg_class_shapes"](spark, "/root/testdata/sf0.001").count() == 8
    columns = "id long, v string, w string, kind string"
    first = spark.createDataFrame([(1, "a", "x y x", "K"), (1, "a", "y", "L"), (1, "b", "", None), (2, "", None, ""), (3, None, "z", "K"), (None, "a", "b", "K"), (None, "a", "b", "K")], columns)
    second = spark.createDataFrame([(3, "c", "q", "K"), (3, "c", "q", "K"), (7, "d", "r r", "M"), (8, "e", "", ""), (9, "a", "b", "K"), (9, "b", "c", "L"), (None, "a", "b", "K")], columns)
    two = (Property("p:v", column="v"), Property("p:v", column="kind"), Property("p:w", function="split", columns=("w",), args=(" ",)))
    cases = [
        [(first, Map("n/{id}", ("T", "T", "U", ""), two), "g")],
        [(first, Map("n/{id}", ("T",), two), "g"), (second, Map("n/{id}", ("U",), two), "h")],
        [(first, Map("n/{id}", ("T",), two), "g"), (second, Map("n/{id}", (), two), "g"), (second, Map("m/{id}", ("U",), two), "h")],
        [(first, Map("n/{id}", ("T",), two), "g"), (second, Map("n/{id}", ("U",), (*two, Property("rdf:type", column="kind", iri=True))), "h")],
        [(second.where("id > 6"), Map("n/{id}", ("T",), ()), "g"), (first, Map("m/{id}", (), two), "h")],
        [(first.where("id = 2"), Map("n/{id}", ("T",), (Property("rdf:type", column="kind"), *two)), "g")],
    ]
    for case in cases:
        want = graph.class_shapes(mapping.all_quads(*[quads(df, spec, g, distinct=False) for df, spec, g in case]))
        got = graph.class_shapes_of(case)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert graph.class_shapes_of(cases[1]).count() == 4


def test_class_shapes_move_hashes_alone(spark):
    from linkspark.operators import mapping

    spec = Map("n/{id}", ("T",), (Property("p:v", column="v"),))
    got = graph.class_shapes_of([(spark.range(50).selectExpr("id", "'x' as v"), spec, "g")])
    assert [tuple(r) for r in got.collect()] == [("T", "p:v", 50)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
