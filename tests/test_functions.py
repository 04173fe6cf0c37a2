"""Edge cases of cleaning functions, written from their descriptions."""

import pytest
from pyspark.sql import functions as F

from linkspark.functions import values as V
from linkspark.operators import crosswalk, documents, grounding

CASES = [
    (V.number_clean, "($1,234.50)", "-1234.50"), (V.number_clean, "+5", "5"), (V.number_clean, "1.2e3", "1.2e3"), (V.number_clean, "abc", ""), (V.number_clean, None, ""),
    (V.range_min, "10–20", "10"), (V.range_max, "1 TO 2", "2"), (V.range_min, "7", ""), (V.value_of, "300 K", "300"), (V.unit_of, "300 K", "K"),
    (V.bool_norm, " Yes ", "true"), (V.bool_norm, "maybe", ""), (V.year_only, "made in 1987.", "1987"), (V.year_only, "19871", ""),
    (V.date_iso, '{"date_parts": [[2020, 2]]}', "2020-02-01"), (V.date_iso, '{"date_parts": [[2020, 13]]}', ""), (V.date_iso, "x", ""),
    (V.slug, '"Hello, World!"', "hello-world"), (V.slug, "", "unknown"), (V.doi_norm, "https://doi.org/10.1000/ABC.", "10.1000/abc"),
    (V.url_canonical, "HTTP://A.org:80/x/#f", "http://a.org/x"), (V.url_canonical, "nothing", ""), (V.percent_encode, "a b*~", "a%20b%2A~"),
    (V.local_name, "http://x/y#z", "z"), (V.float_array_max, '[1, null, "2.5", "x"]', "2.5"), (V.float_array_max, "[]", ""),
    (V.json_array_single, "[7]", "7"), (V.json_array_single, "[1, 2]", ""), (V.datetime_iso, "1600000000", "2020-09-13T12:26:40Z"), (V.strip_footnote, "value [1]*", "value"),
]


def test_scalar_functions(spark):
    df = spark.range(1).select(*[f(F.lit(x).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES)])
    assert list(df.first()) == [want for _, _, want in CASES]


def test_list_functions(spark):
    row = spark.range(1).select(V.json_array(F.lit('[1, null, {"a": 1}, "b"]')), V.json_pluck(F.lit('[{"a": "x"}, 3, {"a": null}]'), "a"), V.split(F.lit(" a ; ;b"), ";"), V.array_at(F.lit("[1, 2, 3]"), -1), V.template("{1}-{3}", F.lit("{1}"))).first()
    assert list(row) == [["1", "b"], ["x"], ["a", "b"], "3", "{1}-"]


def test_closed_set():
    with pytest.raises(ValueError):
        V.function("eval")


def test_stream_appends_once(spark, tmp_path):
    from linkspark.streaming.incremental import append_files, fingerprint

    spark.range(5).write.parquet(str(tmp_path / "in/a"))
    schema = spark.range(1).schema
    run = lambda: append_files(spark, str(tmp_path / "in/*"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"])
    run()
    spark.range(3, 8).write.parquet(str(tmp_path / "in/b"))
    run()
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == list(range(8))
    assert fingerprint(out).first() == fingerprint(out.repartition(3)).first()


def test_sentences(spark):
    text = "See Fig. 3 here. It is 5. Then J. Smith left!  (Why?) \n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  ")], "doc_id long, text string")
    got = documents.sentences(docs).orderBy("doc_id", "n").collect()
    assert [r["sentence"] for r in got] == ["See Fig. 3 here.", "It is 5. Then J. Smith left!", "(Why?) \n"]
    assert all(text[r["begin_at"] : r["end_at"]] == r["sentence"] for r in got)


def test_ground(spark):
    labels = spark.createDataFrame([("old age",), ("hasName",), ("",), (None,), ("old age",)], "label string")
    terms = spark.createDataFrame([("OldAge",), ("age of old men",), ("a",), ("name",), ("xyz",), (None,)], "name string")
    got = {(r["label"], r["name"]): r["score"] for r in grounding.ground(labels, terms).collect()}
    assert got == {("old age", "OldAge"): 100, ("old age", "age of old men"): 78, ("old age", "a"): 50, ("hasName", "name"): 50, ("hasName", "a"): 50}
    assert grounding.ground(labels.limit(0), terms).count() == 0


def test_element_canonical(spark):
    cases = {"Te3Bi2": "Bi2Te3", "Te₃ Bi₂": "Bi2Te3", "Co": "Co", "OC": "CO", "Hea": "Hea", "Bi2(Te)3": "Bi2(Te)3", "": "", "C.5B": "BC.5"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in rows.select("v", crosswalk.element_canonical(F.col("v"))).collect()}
    assert got == cases


def test_float_array_count_of_no_array(spark):
    rows = spark.createDataFrame([("[1, 2]", "[3]"), ("none", "[3]"), (None, "[3]"), ("[1]", ""), ("[]", "[1]")], "x string, y string")
    assert [r.n for r in rows.select(V.float_array_count(F.col("x"), F.col("y")).alias("n")).collect()] == ["1", "", "", "", ""]
