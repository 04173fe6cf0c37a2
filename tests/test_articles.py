"""Articles as trees, on XML in any form and on broken XML."""

from pyspark.sql import functions as F

from linkspark.operators import articles

ARTICLE = """<?xml version="1.0"?>
<!DOCTYPE article PUBLIC "x" "y.dtd">
<article><front><article-meta><article-title>T</article-title></article-meta></front>
 <body><!-- <sec id="no"> --><p>Start &amp; go &#x3b1;&#946;.</p>
  <sec sec-type='a > b' id = "s1"><title>1. <italic>Introduction</italic> and
     Methods</title><p>One <b>two</b>
   three.</p><list><list-item><p>a</p><list><list-item><p>b</p></list-item></list></list-item><list-item><p/></list-item></list>
    <fig position="float" id="f1"><label>L1</label></fig><fig id="f2"><caption><title>Cap</title><p>tion</p></caption><label>L2</label></fig><fig><label>none</label></fig>
    <sec id="s1a"><title>2.1. Sub</title><p>Deep.</p><sec id="s1b"/></sec><p><![CDATA[<after> & more]]></p></sec>
  <sec><title>Results</title><sec id="lost"><p>lost</p><fig id="lostfig"/></sec></sec>
  <boxed><sec id="boxed"><p>boxed</p></sec></boxed>
  <sec id="s2" title=" id='wrong'"><title/><title>second</title></sec>
 </body><back><sec id="back"><p>x</p></sec></back></article>"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, xml string")


def test_tree(spark):
    docs = frame(spark, [(1, ARTICLE), (1, ARTICLE)])
    rows = {r.section: r for r in articles.sections(docs).collect()}
    assert set(rows) == {"s1", "s1a", "s1b", "s2", "_body"}
    assert [rows[s].parent for s in ("s1", "s1a", "s1b", "s2")] == [None, "s1", "s1a", None]
    assert (rows["s1"].title, rows["s1"].path, rows["s1"].roles) == ("1. Introduction and Methods", "1", ["Introduction", "Methods"])
    assert (rows["s1a"].path, rows["s1a"].roles, rows["s1b"].level, rows["s2"].title) == ("2-1", [], 3, "")
    assert rows["s1"].begin < rows["s1a"].begin < rows["s1a"].end < rows["s1"].end < rows["s2"].begin
    got = [(r.section, r.n, r.paragraph) for r in articles.paragraphs(docs).orderBy("position").collect()]
    assert got == [("s1", 0, "One two three."), ("s1", 1, "ab"), ("s1", 2, "<after> & more"), ("s1a", 0, "Deep."), ("_body", 0, "Start & go αβ.")]
    assert sorted(tuple(r)[1:] for r in articles.figures(docs).collect()) == [("f1", "s1", "L1", None), ("f2", "s1", "L2", "Caption")]
    said = {r.section: (r.paragraphs, r.passage) for r in articles.passages(docs).collect()}
    assert said == {"s1": (4, "One two three.\nab\n<after> & more\nDeep."), "s1a": (1, "Deep."), "_body": (1, "Start & go αβ.")}
    kinds = {r.element: (r["count"], r.with_id) for r in articles.inventory(docs).collect()}
    assert kinds == {"section": (3, 2), "subsection": (2, 2), "figure": (4, 3), "paragraph": (10, 0)}
    assert articles.errors(docs).count() == 0


def test_bad_documents_fail_alone(spark):
    bad = {
        2: "<article><body><sec id='a'><p>x</sec></body></article>",
        3: '<!DOCTYPE x [<!ENTITY a "A">]><article><body><p>&a;</p></body></article>',
        4: "<article><front/></article>",
        5: "",
        6: None,
        7: "<article><body><p>a & b</p></body></article>",
        8: "<article><body/></article><article/>",
        9: "<article><body><p>a < b</p></body></article>",
        10: "<article><body/></article>tail",
        11: "<article><body><p>x</p></body>",
        12: "plain",
        13: "<article><body><p>&nbsp;</p></body></article>",
        14: "</p><article><body/></article><p>",
    }
    docs = frame(spark, [(1, ARTICLE), (15, "<book><part><body><p>q</p></body></part></book>"), (16, "<article><x><body><p>no</p></body></x></article>"), *bad.items()])
    found = {r.doc_id: r.error for r in articles.errors(docs).collect()}
    assert set(found) == set(bad) | {16} and found[3] == "entities are refused" and found[4] == found[16] == "no body" and found[2] == "tags do not match"
    assert {r.doc_id for r in articles.paragraphs(docs).collect()} == {1, 15} and {r.doc_id for r in articles.sections(docs).collect()} == {1, 15}


def test_empty_and_null_keys(spark):
    assert articles.sections(frame(spark, [])).count() == articles.errors(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(None, ARTICLE, 3), (4, "<article><body><p>x</p></body></article>", 5)], "doc_id long, xml string, at int")
    assert articles.passages(docs).count() == 4 and {r.doc_id for r in articles.paragraphs(docs).collect()} == {None, 4}


def test_articles_are_dealt_by_their_size(spark, monkeypatch):
    docs = frame(spark, [(i, ARTICLE) for i in range(200)])
    monkeypatch.setattr(articles, "CHARS", 5 * len(ARTICLE))
    tree = articles._tree(docs, "doc_id", "xml")
    tasks = tree.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("key").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] <= 20 and tasks.count() > 30
    assert articles.passages(docs).count() == 600
