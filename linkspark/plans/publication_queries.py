"""Queries of the fixed maps, over tables of papers, samples and curves made from orders and their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import checks, publications
from linkspark.plans.queries import _Q, _quads
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t

NS, RUN = "http://x/", "run-1"


def _compared(q):
    """What both engines compare: numbers as numbers, other objects as texts."""
    return q.select("s", "p", "kind", "dt", F.when(F.col("o_num").isNull(), F.col("o")).alias("o"), "o_num")


def _rows(df, **cells: str):
    return df.select(*[F.expr(e).cast("string").alias(c) for c, e in cells.items()])


def _papers(spark, sf_dir):
    """An order is a paper, its priority the periodical; an eighth have no SID, every second author has no family name."""
    return _rows(
        _t(spark, sf_dir, "orders"), SID="if(o_orderkey % 8 = 7, ' ', concat(' ', o_orderkey))", DOI="concat('10.1000/', o_orderkey)", URL="if(o_orderkey % 3 = 0, 'no address', concat('http://e.org/a b/', o_orderkey))",
        title="""concat('"Order ', o_orderkey, '"')""", container_title="o_orderpriority", container_title_short="o_orderstatus",
        issued="""concat('{"date_parts": [[', year(o_orderdate), ',', month(o_orderdate), ']]}')""", project_names="""concat('["P', o_custkey % 5, '", " "]')""",
        author="""concat('[{"given":"","family":" "},{"given":"G', o_custkey, '","family":"', if(o_custkey % 2 = 0, '', 'F'), '"},{"given":"H","family":"K"}]')""")


def _curves(spark, sf_dir):
    """Order, line and part make an item's key; some first arrays are no arrays, some moments lack a zone. Adding 0
    makes one zero of two, so that equal bounds of a key are one text."""
    return _rows(
        _t(spark, sf_dir, "lineitem"), SID="l_orderkey", figure_id="l_linenumber", sample_id="l_partkey", prop_x="'Quantity'", prop_y="if(l_linenumber = 1, 'Discount', 'Other')", unit_x="l_returnflag",
        x="if(l_linenumber = 2, 'none', concat('[', l_quantity + 0D, ', null, ', l_quantity + 1, ']'))", y="concat('[', l_linenumber, ', \"text\"]')",
        created_at="concat('Fri Sep 01 2017 18:19:39 ', if(l_linenumber = 3, '', 'GMT+0900 (Japan Standard Time)'))")


_PAPERS = """k as (select 'http://x/paper/' || o_orderkey as s, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') as slug, * from orders where o_orderkey % 8 <> 7),
a as (select 'http://x/person/' || o_orderkey as w, * from k)"""
_LITERAL = "cast(null as double)"


@query("map_papers", f"""with {_PAPERS}, q(s, p, kind, dt, o) as (
  select s, 'rdf:type', 'iri', '', unnest(['x:Paper', 'schema:ScholarlyArticle', 'prov:Entity']) from k
  union all select s, 'dcterms:identifier', 'literal', '', cast(o_orderkey as varchar) from k
  union all select s, 'prov:wasGeneratedBy', 'iri', '', 'http://x/ingestion/run-1' from k
  union all select s, 'schema:identifier', 'literal', '', '10.1000/' || o_orderkey from k
  union all select s, 'schema:url', 'iri', '', 'http://e.org/a%20b/' || o_orderkey from k where o_orderkey % 3 <> 0
  union all select s, 'schema:name', 'literal', '', 'Order ' || o_orderkey from k
  union all select s, 'schema:isPartOf', 'iri', '', 'http://x/periodical/' || slug from k
  union all select s, 'schema:datePublished', 'literal', 'xsd:date', strftime(o_orderdate, '%Y-%m-01') from k
  union all select s, 'x:projectName', 'literal', '', 'P' || (o_custkey % 5) from k
  union all select 'http://x/periodical/' || slug, unnest(['rdf:type', 'schema:name', 'schema:alternateName']), unnest(['iri', 'literal', 'literal']), '', unnest(['schema:Periodical', o_orderpriority, o_orderstatus]) from k
  union all select s, 'schema:author', 'iri', '', w || unnest(['/0', '/1']) from a
  union all select w || unnest(['/0', '/0', '/1', '/1']), 'rdf:type', 'iri', '', unnest(['schema:Person', 'prov:Agent', 'schema:Person', 'prov:Agent']) from a
  union all select w || '/0', 'schema:givenName', 'literal', '', 'G' || o_custkey from a
  union all select w || '/0', 'schema:familyName', 'literal', '', 'F' from a where o_custkey % 2 = 1
  union all select w || '/1', unnest(['schema:givenName', 'schema:familyName']), 'literal', '', unnest(['H', 'K']) from a)
select distinct *, {_LITERAL} as o_num from q""")
def map_papers(spark, sf_dir):
    return _compared(publications.papers(_papers(spark, sf_dir), NS, "papers", RUN))


@query("map_samples", f"""with k as (select 'http://x/sample/' || l_orderkey || '-' || l_partkey as s, 'http://x/descriptor/' || l_orderkey || '-' || l_partkey as d, * from lineitem),
q(s, p, kind, dt, o) as (
  select s, 'rdf:type', 'iri', '', unnest(['x:Sample', 'prov:Entity']) from k
  union all select s, 'dcterms:identifier', 'literal', '', l_orderkey || '-' || l_partkey from k
  union all select s, 'x:rawSampleId', 'literal', '', cast(l_partkey as varchar) from k
  union all select s, 'prov:wasGeneratedBy', 'iri', '', 'http://x/ingestion/run-1' from k
  union all select s, 'schema:name', 'literal', '', 'Part ' || l_partkey from k
  union all select s, 'x:fromPaper', 'iri', '', 'http://x/paper/' || l_orderkey from k
  union all select s, 'x:hasDescriptor', 'iri', '', d || unnest(['/0', '/1']) from k
  union all select d || unnest(['/0', '/1']), 'rdf:type', 'iri', '', 'x:Descriptor' from k
  union all select d || unnest(['/0', '/1']), 'x:descriptorName', 'literal', '', unnest(['flag', 'a']) from k
  union all select d || '/0', 'x:descriptorCategory', 'literal', '', l_returnflag from k
  union all select d || '/1', 'x:descriptorComment', 'literal', '', 'status ' || l_linestatus from k
  union all select d || '/1', 'x:descriptorExtracted', 'literal', '', 'yes' from k)
select distinct *, {_LITERAL} as o_num from q""")
def map_samples(spark, sf_dir):
    rows = _rows(
        _t(spark, sf_dir, "lineitem"), SID="l_orderkey", sample_id="l_partkey", sample_name="concat('\"Part ', l_partkey, '\"')",
        sample_info="""concat('{"none": {"category": " "}, "flag": {"category": "', l_returnflag, '", "comment": ""}, "number": 5, "a": {"comment": " status ', l_linestatus, '", "extracted": "yes"}}')""")
    return _compared(publications.samples(rows, NS, "samples", RUN))


_KEYED = "k as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey as key, * from lineitem)"


@query("map_curves", f"""with {_KEYED}, q(s, p, kind, dt, o, o_num) as (
  select key, 'rdf:type', 'iri', '', unnest(['x:Curve', 'prov:Entity']), {_LITERAL} from k
  union all select key, 'dcterms:identifier', 'literal', '', key, null from k
  union all select key, 'x:rawFigureId', 'literal', '', cast(l_linenumber as varchar), null from k
  union all select key, 'prov:wasGeneratedBy', 'iri', '', unnest(['http://x/ingestion/run-1', 'http://x/digitization/' || key]), null from k
  union all select key, 'x:ofSample', 'iri', '', 'http://x/sample/' || l_orderkey || '-' || l_partkey, null from k
  union all select key, 'x:propertyX', 'literal', '', 'Quantity', null from k
  union all select key, 'x:propertyY', 'literal', '', case when l_linenumber = 1 then 'Discount' else 'Other' end, null from k
  union all select key, 'x:unitXString', 'literal', '', l_returnflag, null from k
  union all select key, 'x:propertyXQuantity', 'iri', '', 'http://q/Amount', null from k
  union all select key, 'x:propertyYQuantity', 'iri', '', 'http://q/Rebate', null from k where l_linenumber = 1
  union all select key, 'x:unitX', 'iri', '', 'http://u/R', null from k where l_returnflag = 'R'
  union all select key, 'x:yValuesJSON', 'literal', '', '[' || l_linenumber || ', "text"]', null from k
  union all select key, unnest(['x:xMin', 'x:xMax']), 'literal', 'xsd:double', null, unnest([l_quantity, l_quantity + 1]) from k where l_linenumber <> 2
  union all select key, unnest(['x:yMin', 'x:yMax']), 'literal', 'xsd:double', null, cast(l_linenumber as double) from k
  union all select key, 'x:pointCount', 'literal', 'xsd:integer', null, 1.0 from k where l_linenumber <> 2
  union all select key, 'dcterms:created', 'literal', '', 'Fri Sep 01 2017 18:19:39' || case when l_linenumber = 3 then '' else ' GMT+0900 (Japan Standard Time)' end, null from k)
select distinct 'http://x/curve/' || s as s, p, kind, dt, o, o_num from q""")
def map_curves(spark, sf_dir):
    made = publications.curves(_curves(spark, sf_dir), NS, "curves", RUN, {"quantity": "http://q/Amount", "discount": "http://q/Rebate"}, {"R": "http://u/R"})
    return _compared(made.where("p <> 'x:xValuesJSON'"))  # the text of x holds doubles, which the engines spell in two ways


@query("map_digitization", f"""with {_KEYED}, q(s, p, kind, dt, o) as (
  select 'http://x/digitization/' || key, 'rdf:type', 'iri', '', unnest(['x:DigitizationActivity', 'prov:Activity']) from k
  union all select 'http://x/digitization/' || key, 'prov:wasAssociatedWith', 'iri', '', '{publications.AGENT}' from k
  union all select 'http://x/digitization/' || key, 'prov:atTime', 'literal', 'xsd:dateTime', '2017-09-01T09:19:39+00:00' from k where l_linenumber <> 3
  union all select '{publications.AGENT}', unnest(['rdf:type', 'schema:name', 'schema:url']), unnest(['iri', 'literal', 'iri']), '', unnest(['prov:SoftwareAgent', 'WebPlotDigitizer', '{publications.AGENT}']) from k)
select distinct *, {_LITERAL} as o_num from q""")
def map_digitization(spark, sf_dir):
    return _compared(publications.digitization(_curves(spark, sf_dir), NS, "curves"))


@query("map_activity", """select p, o, cast(count(distinct o_orderkey) as bigint) as made from orders, (values
  ('rdf:type', 'x:IngestionActivity'), ('rdf:type', 'prov:Activity'), ('prov:atTime', '2024-05-01T00:00:00+00:00'), ('prov:used', 'http://x/source/orders%20of%20all.csv'), ('prov:wasAssociatedWith', 'http://x/agent')) v(p, o)
where o_orderkey % 8 <> 7 group by all""")
def map_activity(spark, sf_dir):
    """What a run says of itself, with the number of papers that name it."""
    run = publications.activity(spark, NS, "papers", RUN, "2024-05-01T00:00:00+00:00", "orders of all.csv", "http://x/agent")
    made = publications.papers(_papers(spark, sf_dir), NS, "papers", RUN).where("p = 'prov:wasGeneratedBy'").groupBy(F.col("o").alias("s")).agg(F.count(F.lit(1)).alias("made"))
    return run.join(made, "s").select("p", "o", "made")


@query("t10_examples_have_rows", f"""with {_Q} select 'orders of a customer' as name, exists (select 1 from q where p = 'x:customer') as has_rows
union all select 'no such class', exists (select 1 from q where p = 'rdf:type' and o = 'x:Nothing')
union all select 'urgent', exists (select 1 from q where p = 'x:priority' and o = '1-URGENT')""")
def t10_examples(spark, sf_dir):
    q = _quads(spark, sf_dir, "x:customer", "rdf:type", "x:priority")
    return checks.examples_have_rows({"orders of a customer": q.where("p = 'x:customer'"), "no such class": q.where("p = 'rdf:type' and o = 'x:Nothing'"), "urgent": q.where("p = 'x:priority' and o = '1-URGENT'")})
