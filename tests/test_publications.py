from pyspark.sql import functions as F

from linkspark.operators import checks, publications
from linkspark.operators.mapping import Map, Property, quads

NS = "n/"


def triples(q):
    return {(r.s, r.p, r.o) for r in q.collect()}


def test_list_functions_without_values_keep_the_row(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None)], "k string, w string")
    for name, args in (("split", (" ",)), ("tokens", ()), ("json_array", ()), ("json_pluck", ("f",)), ("projects", ())):
        spec = Map("n/{k}", ("T",), (Property("p:k", column="k"), Property("p:w", function=name, column="w", args=args)))
        assert {t for t in triples(quads(rows, spec, "g")) if t[1] != "p:w"} == {(f"n/{k}", p, o) for k in "abc" for p, o in (("rdf:type", "T"), ("p:k", k))}, name


def test_papers(spark):
    authors = '[{"given": "A", "family": ""}, {"given": " "}, {"family": "B"}]'
    rows = spark.createDataFrame([("7 ", "Journal X", authors, '["P", " "]', 1), ("8", "journal-x", "no list", None, 2), (" ", "Y", authors, None, 3), (None, "Z", None, None, 4), ("7 ", "Journal X", authors, '["P", " "]', 1)], "SID string, container_title string, author string, project_names string, slug int")
    got = triples(publications.papers(rows, NS, "g"))
    assert {t for t in got if t[0].startswith("n/per")} == {
        ("n/periodical/journal-x", "rdf:type", "schema:Periodical"), ("n/periodical/journal-x", "schema:name", "Journal X"), ("n/periodical/journal-x", "schema:name", "journal-x"),
        *[(f"n/person/7/{i}", "rdf:type", c) for i in (0, 1) for c in ("schema:Person", "prov:Agent")], ("n/person/7/0", "schema:givenName", "A"), ("n/person/7/1", "schema:familyName", "B")}
    assert {(p, o) for s, p, o in got if s == "n/paper/7" and p not in ("rdf:type", "dcterms:identifier")} == {("schema:isPartOf", "n/periodical/journal-x"), ("x:projectName", "P"), ("schema:author", "n/person/7/0"), ("schema:author", "n/person/7/1")}
    assert {s for s, _, _ in got if s.startswith("n/paper")} == {"n/paper/7", "n/paper/8"}
    assert sorted(r.slug for r in publications.keyless(rows, publications.PAPER_KEY).collect()) == [3, 4]
    assert publications.papers(rows.limit(0), NS, "g").count() == 0


def test_samples(spark):
    info = '{"z": {"category": "c"}, "empty": {"comment": " "}, "n": 5, "list": ["category"], "a": {"extracted": "e", "comment": 3}}'
    rows = spark.createDataFrame([("1", "2", info), ("1", "3", "{broken"), ("1", "4", None), ("1", None, info)], "SID string, sample_id string, sample_info string")
    got = triples(publications.samples(rows, NS, "g", "r"))
    assert {t for t in got if t[0].startswith("n/desc") and t[1] != "rdf:type"} == {("n/descriptor/1-2/0", "x:descriptorName", "z"), ("n/descriptor/1-2/0", "x:descriptorCategory", "c"), ("n/descriptor/1-2/1", "x:descriptorName", "a"), ("n/descriptor/1-2/1", "x:descriptorComment", "3"), ("n/descriptor/1-2/1", "x:descriptorExtracted", "e")}
    assert {s for s, p, o in got if p == "prov:wasGeneratedBy" and o == "n/ingestion/r"} == {f"n/sample/1-{i}" for i in (2, 3, 4)}


def test_curves(spark):
    rows = spark.createDataFrame([("1", "f", "2", "[3, 1, null]", "[5]", '"thermo power"', "Fri Sep 01 2017 18:19:39 GMT+0900 (JST)"), ("1", "f", "3", "?", "", None, "yesterday"), ("", "f", "3", "[1]", "[1]", None, None)], "SID string, figure_id string, sample_id string, x string, y string, prop_y string, created_at string")
    got = triples(publications.curves(rows, NS, "g", quantities={"Thermo Power": "q/S"}))
    first = {(p, o) for s, p, o in got if s == "n/curve/1-f-2"}
    assert {("x:xMin", "1.0"), ("x:xMax", "3.0"), ("x:yMax", "5.0"), ("x:pointCount", "1"), ("x:propertyY", "thermo power"), ("x:propertyYQuantity", "q/S"), ("x:ofSample", "n/sample/1-2"), ("x:xValuesJSON", "[3, 1, null]")} <= first
    second = {p for s, p, _ in got if s == "n/curve/1-f-3"}
    assert "x:xValuesJSON" in second and not second & {"x:xMin", "x:yMax", "x:pointCount", "x:yValuesJSON"} and len({s for s, _, _ in got}) == 2
    made = triples(publications.digitization(rows, NS, "g"))
    assert {(s, o) for s, p, o in made if p == "prov:atTime"} == {("n/digitization/1-f-2", "2017-09-01T09:19:39+00:00")}
    assert len({s for s, _, _ in made}) == 3 and publications.digitization(rows.limit(0), NS, "g").count() == 0


def test_activity_and_examples(spark):
    got = triples(publications.activity(spark, NS, "g", "r1", "2024-01-01T00:00:00+00:00", "a b.csv", "n/agent"))
    assert ("n/ingestion/r1", "prov:used", "n/source/a%20b.csv") in got and ("n/source/a%20b.csv", "schema:name", "a b.csv") in got and len(got) == 7
    some = spark.range(3)
    assert {(r.name, r.has_rows) for r in checks.examples_have_rows({"a": some, "b": some.where("id > 5")}).collect()} == {("a", True), ("b", False)}


def test_repeated_keys_give_a_set(spark):
    rows = spark.createDataFrame([("1", "f", "2", "[3]", '["P", "P"]'), ("1", "f", "3", "[4]", None)], "SID string, figure_id string, sample_id string, x string, project_names string")
    for made in (publications.curves, publications.digitization, publications.samples, publications.papers):
        once = made(rows.dropDuplicates(["SID"]) if made is publications.papers else rows, NS, "g")
        again = made(rows.unionByName(rows).unionByName(rows.withColumn("x", F.lit("[5]"))), NS, "g")
        assert again.count() == again.distinct().count() and triples(once) <= triples(again)
    assert {o for s, p, o in triples(publications.curves(rows.unionByName(rows.withColumn("x", F.lit("[5]"))), NS, "g")) if s == "n/curve/1-f-2" and p == "x:xMax"} == {"3.0", "5.0"}


def test_curves_of_single_keys_have_no_exchange(spark):
    rows = spark.range(50).select(*[F.col("id").cast("string").alias(c) for c in publications.CURVE_KEY])
    assert "Exchange" not in publications.curves(rows, NS, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in publications.samples(rows, NS, "g")._jdf.queryExecution().executedPlan().toString()
