"""Formulas and their links, units and quantities, files of old instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import crosswalk, formulas, grounding, profile
from linkspark.operators.mapping import ROWS, TYPE, Map, Property, all_quads, by_predicate, quads
from linkspark.plans.queries import _P, _participants
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t
from linkspark.sources import dialects
from linkspark.sources.dialects import WHITESPACE, Dialect

_FORMULA = """case p_partkey % 7 when 0 then 'Bi2Te2.7Se0.' || p_size when 1 then 'Pb0.98Na0.02Te' when 2 then ' Hf0.75Zr0.25NiSn' || p_size || ' '
  when 3 then p_name when 4 then 'Sb(' || p_size || ')Te' when 5 then 'CoSb3~' else 'Te' || p_size || 'Bi4Te.5' end"""
_PARTS = f"""f as (select p_partkey, trim({_FORMULA}) as s from part),
g as (select p_partkey, s, regexp_extract_all(s, '{formulas.PART}') as found from f where not regexp_matches(s, '[ (]|[a-z]{{2,}}')),
i as (select p_partkey, unnest(found) as p, generate_subscripts(found, 1) as pos from g where len(found) > 0 and length(array_to_string(found, '')) >= 0.9 * length(s)),
a as (select p_partkey, regexp_extract(p, '^[A-Z][a-z]?') as element, min(pos) as pos, sum(coalesce(try_cast(regexp_replace(p, '^[A-Z][a-z]?', '') as double), 1.0)) as amount from i group by 1, 2)"""
_GROUPS = ", ".join(f"('{e}', '{g}')" for g in formulas.GROUPS for e in g.split())
_METHODS = ", ".join(f"'{way}'" for way, _ in formulas.WAYS)


@query("nrm_parse_formula", f"with {_PARTS} select p_partkey, element, amount from a")
def nrm_parse_formula(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", formulas.parsed(F.expr(_FORMULA)).alias("f"))
    return rows.select("p_partkey", F.explode("f").alias("e")).select("p_partkey", "e.element", "e.amount")


@query("nrm_host_candidates", f"""with {_PARTS},
d as (select *, amount / sum(amount) over (partition by p_partkey) as share from a),
k as (select *, share < {formulas.DILUTE} and max(share) over (partition by p_partkey) >= {formulas.DILUTE} as dopant from d),
h as (select p_partkey, element, pos, amount, coalesce(grp, element) as grp from k left join (values {_GROUPS}) v(e, grp) on e = element where not dopant),
c as (select p_partkey, grp, arg_max(element, (amount, -pos)) as element, arg_max(pos, (amount, -pos)) as pos, sum(amount) as amount, count(*) as n from h group by 1, 2),
v as (select p_partkey, 2 as way, element, pos, amount, bool_and(abs(amount - round_even(amount, 0)) <= 0.02) over (partition by p_partkey) as ok from h
  union all select p_partkey, 3, element, pos, amount, true from h union all select p_partkey, 4, element, pos, amount, max(n) over (partition by p_partkey) > 1 from c),
w as (select p_partkey, way, list(element order by pos) as es, list(cast(round_even(amount, 0) as bigint) order by pos) as ns from v where ok and round_even(amount, 0) > 0 group by 1, 2),
z as (select *, list_reduce(ns, lambda x, y: gcd(x, y)) as g from w),
m as (select p_partkey, way, array_to_string(list_transform(list_zip(es, ns), lambda x: x[1] || case when x[2] // g = 1 then '' else cast(x[2] // g as varchar) end), '') as formula from z
  union all select p_partkey, 1, 'PbTe' from part where p_partkey % 2 = 0),
u as (select * from m qualify row_number() over (partition by p_partkey, formula order by way) = 1)
select p_partkey, cast(row_number() over (partition by p_partkey order by way) as integer) as place, formula, [{_METHODS}][way] as method from u""")
def nrm_host_candidates(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_FORMULA).alias("c"), F.expr("case when p_partkey % 2 = 0 then 'PbTe' else 'half-Heusler' end").alias("family"))
    rows = formulas.hosts(rows, "c", "family").select("p_partkey", F.posexplode("candidates").alias("i", "c"))
    return rows.select("p_partkey", (F.col("i") + 1).alias("place"), "c.formula", "c.method")


def _linked(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.expr("case when p_partkey % 2 = 0 then 'Pb0.98Na0.02Te0.9Se0.1' else p_name end").alias("c"), F.expr("case when p_partkey % 2 = 0 then 'PbTe' else 'Polymer' end").alias("family"))
    first = F.get("candidates", F.lit(0))
    rows = formulas.hosts(rows, "c", "family").select("key", F.concat(F.lit("http://x/s/"), "key").alias("sample"), first["formula"].alias("formula"), first["method"].alias("method"), first["confidence"].alias("confidence"), "dopants", "substituents", F.lit("http://m/1").alias("reference_id"))
    return formulas.link_quads(rows, "http://x/", "2020-01-01T00:00:00Z")


@query("host_link_triples", """
with a as (select p_partkey % 2 = 0 as found, 'http://x/activity/' || p_partkey as act, 'http://x/s/' || p_partkey as sample, 'http://x/defect/' || p_partkey || '/Na' as defect, 'http://x/structure/PbTe' as node from part)
select act as s, 'rdf:type' as p, 'sd:StructureMatchActivity' as o, 'iri' as kind, '' as dt from a
union all select act, 'prov:used', sample, 'iri', '' from a
union all select act, 'sd:matchMethod', case when found then 'MaterialFamily(curator)' else 'no host resolvable' end, 'literal', '' from a
union all select act, 'sd:matchConfidence', case when found then 'high' else 'unresolved' end, 'literal', '' from a
union all select act, 'prov:endedAtTime', '2020-01-01T00:00:00Z', 'literal', 'xsd:dateTime' from a
union all select sample, 'sd:hasHostStructure', node, 'iri', '' from a where found
union all select distinct node, 'rdf:type', 'sd:CrystalStructure', 'iri', '' from a where found
union all select distinct node, 'sd:reducedHostFormula', 'PbTe', 'literal', '' from a where found
union all select node, 'prov:wasGeneratedBy', act, 'iri', '' from a where found
union all select distinct node, 'sd:idealizedFrom', 'http://m/1', 'iri', '' from a where found
union all select sample, 'sd:hasPointDefect', defect, 'iri', '' from a where found
union all select defect, 'sd:dopantElement', 'Na', 'literal', '' from a where found
union all select defect, 'sd:siteAmount', '0.02', 'literal', 'xsd:double' from a where found
union all select sample, 'sd:hasPointDefect', replace(defect, '/Na', '/Se'), 'iri', '' from a where found
union all select replace(defect, '/Na', '/Se'), 'sd:dopantElement', 'Se', 'literal', '' from a where found
union all select replace(defect, '/Na', '/Se'), 'sd:siteAmount', '0.1', 'literal', 'xsd:double' from a where found""")
def host_link_triples(spark, sf_dir):
    return _linked(spark, sf_dir)


@query("join_link_bridge", "select 'http://x/s/' || p_partkey as sample, 'http://x/structure/PbTe' as structure, 'MaterialFamily(curator)' as method, 'high' as confidence, '2020-01-01T00:00:00Z' as at, 'http://m/1' as reference, 'Na 0.02,Se 0.1' as dopants from part where p_partkey % 2 = 0")
def join_link_bridge(spark, sf_dir):
    return formulas.bridge(_linked(spark, sf_dir))


@query("join_text_data_fusion", """
select 'http://x/curve/' || o_orderkey as curve, c_mktsegment as composition, cast(null as varchar) as property, o_totalprice as value, 'http://x/figure/' || o_orderstatus as figure, o_orderstatus as label,
  cast(null as varchar) as caption, 'http://x/sentence/' || n_nationkey as sentence, n_name as condition, 'http://x/paper/' || r_regionkey as paper, case when r_regionkey > 0 then r_name end as title
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def join_text_data_fusion(spark, sf_dir):
    curve = Map("http://x/curve/{o_orderkey}", ("sd:Curve",), (Property("sd:ofSample", template="http://x/sample/{o_custkey}"), Property("prov:wasDerivedFrom", template="http://x/figure/{o_orderstatus}"), Property("sd:yMax", column="o_totalprice")))
    figure = Map("http://x/figure/{o_orderstatus}", (), (Property("rdfs:label", column="o_orderstatus"),))
    sample = Map("http://x/sample/{c_custkey}", (), (Property("sd:compositionString", column="c_mktsegment"), Property("lit:conditionStatedIn", template="http://x/sentence/{c_nationkey}")))
    sentence = Map("http://x/sentence/{n_nationkey}", (), (Property("nif:anchorOf", column="n_name"), Property("prov:wasQuotedFrom", template="http://x/paper/{n_regionkey}")))
    paper = Map("http://x/paper/{r_regionkey}", (), (Property("dcterms:title", column="r_name"),))
    read = {n: _t(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    parts = max(spark.sparkContext.defaultParallelism, -(-read["orders"].count() // ROWS))  # as the files' footers say
    made = (read["orders"], curve, parts), (read["orders"], figure, None), (read["customer"], sample, parts), (read["nation"], sentence, None), (read["region"].where("r_regionkey > 0"), paper, None)
    return formulas.fusion(by_predicate(*made), parts=parts)


@query("agg_link_counts", f"with {_P}, l as (select distinct key, participant, entity, value from p where key in (select key from k)) select participant, count(*) as links, count(distinct key) as hubs from l group by participant union all select null, count(*), count(distinct key) from l having count(*) > 0")
def agg_link_counts(spark, sf_dir):
    return crosswalk.link_counts(crosswalk.hub(_participants(spark, sf_dir), "nation"))


_KIND = "case when event_id % 3 = 0 then 'function' when event_id % 47 = 2 then 'raw' else 'direct' end"


@query("agg_transform_coverage", f"""
with m as (select 'd' || (user_id % 20) as dataset, {_KIND} as kind from events),
n as (select dataset, grouping(dataset) as everything, count(*) as total, count(*) filter (kind = 'function') as functions, count(*) filter (kind = 'raw') as raws, count(*) filter (kind = 'direct') as directs from m group by rollup (dataset)),
r as (select *, case when raws + functions > 0 then raws / (raws + functions) end as raw_rate from n where total > 0)
select dataset, total, functions, raws, directs, raw_rate, case when everything = 1 then raw_rate < 0.05 end as passes from r""")
def agg_transform_coverage(spark, sf_dir):
    return profile.transform_coverage(_t(spark, sf_dir, "events").select(F.expr("'d' || (user_id % 20)").alias("dataset"), F.expr(_KIND).alias("kind")))


@query("agg_file_order_union", "select name, min(item_id) as row, arg_min(position, (item_id, position)) as position from (select item_id, unnest(string_split(text, ' ')) as name, cast(generate_subscripts(string_split(text, ' '), 1) - 1 as integer) as position from benchmark) group by name")
def agg_file_order_union(spark, sf_dir):
    return profile.column_order(_t(spark, sf_dir, "benchmark").withColumn("names", F.split("text", " ")), "item_id", "names")


@query("fn_qudt_quantity", "select c_custkey, case when c_mktsegment not like 'B%' then 'http://q/' || c_mktsegment end as iri from customer")
def fn_qudt_quantity(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    terms = rows.select("c_mktsegment").distinct().where("c_mktsegment not like 'B%'").select(F.upper("c_mktsegment").alias("name"), F.concat(F.lit("http://q/"), "c_mktsegment").alias("iri"))
    return grounding.term_iri(rows.select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("n")), "n", terms, fold=True).drop("n")


@query("fn_qudt_unit", "select c_custkey, case when c_custkey % 2 = 1 then 'http://u/' || c_mktsegment end as iri from customer")
def fn_qudt_unit(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    terms = rows.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("http://u/"), "c_mktsegment").alias("iri"))
    written = F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return grounding.term_iri(rows.select("c_custkey", written.alias("n")), "n", terms).drop("n")


_CATALOG = "select n_name as name, lower(n_name) || ' unit' as label, substr(n_name, 1, 2) as symbol, cast(n_nationkey as string) as code, n_regionkey = 0 as si from nation"
_ASKED = """select distinct case c_custkey % 7 when 0 then substr(n_name, 1, 2) when 1 then cast(n_nationkey as string) when 2 then n_name when 3 then upper(n_name || ' Unit') when 4 then 'Spelt ' || n_nationkey
  when 5 then 'SPELT ' || n_nationkey else substr(n_name, 2, 4) end as query from customer join nation on n_nationkey = c_nationkey"""


@query("gnd_units", f"""
with u as ({_CATALOG}), q as ({_ASKED}),
k as (select 0 as rank, 'alias' as matched_on, query, name from q join u on query = 'Spelt ' || code
  union all select 1, 'alias', query, name from q join u on lower(query) = lower('Spelt ' || code)
  union all select 2, 'symbol', query, name from q join u on query = symbol union all select 3, 'ucum', query, name from q join u on query = code
  union all select 4, 'name', query, name from q join u on query = name union all select 5, 'label', query, name from q join u on lower(query) = label),
b as (select k.*, si from k join u using (name) qualify rank = min(rank) over (partition by query)),
c as (select *, count(*) over (partition by query) as hits, count(*) filter (si) over (partition by query) as sis from b),
h as (select query, name, matched_on, row_number() over (partition by query order by case when sis = 1 and si then 0 else 1 end, name) as place, hits = 1 or sis = 1 as resolved from c),
n as (select query, name, case when lower(symbol) = lower(query) then 0 when starts_with(label, lower(query)) or starts_with(lower(symbol), lower(query)) then 1
  when contains(label, lower(query)) or contains(lower(symbol), lower(query)) then 2 when contains(lower(query), label) then 3 end as rank from q, u where query not in (select query from h)),
s as (select query, name, 'suggestion' as matched_on, row_number() over (partition by query order by rank, length(name), name) as place, false as resolved from n where rank is not null)
select * from h union all select * from s where place <= 6""")
def gnd_units(spark, sf_dir):
    for name in ("nation", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    catalog = spark.sql(_CATALOG)
    spellings = catalog.select(F.concat(F.lit("Spelt "), "code").alias("spelling"), "name")
    return grounding.units(spark.sql(_ASKED), catalog.withColumn("ucum", F.array("code")), spellings)


@query("gnd_quantity_kinds", r"""
with q as (select distinct p_name as query, case when p_size % 3 = 0 then '' else p_brand end as unit, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as q, list_distinct(string_split(lower(p_name), ' ')) as x from part),
t as (select distinct unnest(string_split(p_name, ' ')) as name from part union select distinct p_name from part),
k as (select name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as k, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') || 'rate' as l, list_distinct(list_append(string_split(lower(name), ' '), 'rate')) as y, ['Brand#' || length(name), 'Brand#' || (length(name) + 1)] as units from t),
b as (select query, unit, name, q, k, l, x, y, len(list_intersect(x, y)) as c, unit <> '' and list_contains(units, unit) as unit_fits from q, k),
s as (select *, case when q = k or q = l then 100 when length(q) < 4 then 0 when c = len(x) and len(x) = len(y) then 90 when c = len(x) then 70 + greatest(0, 10 - (len(y) - len(x))) when contains(k, q) or contains(q, k) or contains(l, q) then 50 when c > 0 then 20 + c else 0 end as s from b),
r as (select query, unit, name, unit_fits, case when s < 30 and unit_fits then 25 when s < 30 then null when unit <> '' and not unit_fits and s < 100 then null else s + case when unit_fits then 15 else 0 end end as score from s),
o as (select *, count(*) filter (score >= 100) over (partition by query, unit) as sure from r where score is not null),
p as (select query, unit, name, score, unit_fits, row_number() over (partition by query, unit order by score desc, unit_fits desc, length(name), name) as place from o where sure <> 1 or score >= 100)
select * from p where place <= 8""")
def gnd_quantity_kinds(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).union(part.select("p_name")).distinct()
    kinds = names.select("name", F.concat("name", F.lit(" rate")).alias("label"), F.array(F.concat(F.lit("Brand#"), F.length("name")), F.concat(F.lit("Brand#"), F.length("name") + 1)).alias("units"))
    return grounding.quantity_kinds(part.select(F.col("p_name").alias("query"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("unit")), kinds)


_ASKED_TERMS = """select distinct p_name || ' ' || p_type as label, case p_size % 3 when 0 then '' when 1 then 'class' else 'property' end as kind, case when p_size % 2 = 0 then p_brand else '' end as domain from part
  union select distinct p_type, '', '' from part union select distinct substr(p_name, 2, 3), 'class', '' from part union select distinct substr(p_name, 1, 2), '', p_brand from part"""
_TERMS = """select distinct 'v' || (p_size % 3) as prefix, case when p_size % 2 = 0 then 'has ' || p_name else p_name end as name, case when p_size % 2 = 0 then 'property' else 'class' end as kind,
    case when p_size % 5 = 0 then lower(p_type) || ' item' else p_name end as label, p_brand as domain from part
  union select distinct 'w', substring_index(p_name, ' ', 1), 'class', p_type, '' from part union select distinct 'w', substring_index(p_name, ' ', -1), 'property', 'the ' || p_type, p_brand from part"""


@query("gnd_candidates", rf"""
with q as ({_ASKED_TERMS}),
t as ({_TERMS.replace("substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]").replace("substring_index(p_name, ' ', -1)", "string_split(p_name, ' ')[-1]")}),
a as (select label, kind as asked_kind, domain as asked_domain, replace(lower(label), ' ', '') as p, list_distinct(list_filter(string_split(lower(label), ' '), lambda x: x <> '')) as w from q),
u as (select *, replace(lower(name), ' ', '') as np, replace(lower(label), ' ', '') as lp, case when kind = 'property' and starts_with(lower(name), 'has ') then replace(lower(name)[5:], ' ', '') else replace(lower(name), ' ', '') end as cp,
  list_distinct(string_split(lower(name), ' ') || string_split(lower(label), ' ')) as y from t),
m as (select a.label, asked_kind, asked_domain, prefix, name, kind, domain, u.label as term_label, p, w, np, lp, cp, y, len(list_intersect(w, y)) as c from a, u where asked_kind in ('', kind) and asked_domain in ('', domain)),
s as (select *, case when p in (np, lp, cp) then 'exact' when c = len(w) and len(w) = len(y) then 'exact_tokens' when c = len(w) then 'tokens_subset' when contains(np, p) or contains(p, np) or contains(lp, p) then 'substring' when c > 0 then 'overlap' end as match from m),
r as (select *, case match when 'exact' then 100 when 'exact_tokens' then 90 when 'tokens_subset' then 70 + greatest(0, 10 - (len(y) - len(w))) when 'substring' then 50 else 20 + c end as score from s where match is not null),
o as (select *, row_number() over (partition by label, asked_kind, asked_domain order by score desc, length(name), prefix, name, kind, term_label, domain) as place from r)
select label, asked_kind, asked_domain, prefix, name, kind, domain, cast(score as integer) as score, match, cast(place as integer) as place from o where place <= 5""")
def gnd_candidates(spark, sf_dir):
    _t(spark, sf_dir, "part").createOrReplaceTempView("part")
    return grounding.candidates(spark.sql(_ASKED_TERMS), spark.sql(_TERMS), 5)


@query("gnd_schema", r"""
with a as (select distinct 'm:' || p_name as term, string_split(lower(p_name), ' ') as x, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as p from part where p_partkey % 2 = 0),
b as (select distinct word as name, [lower(word)] as y, lower(word) as q from (select unnest(string_split(p_name, ' ')) as word from part)),
c as (select term, name, p, q, list_distinct(x) as x, y, len(list_intersect(x, y)) as k from a, b),
s as (select term, name, case when p = q then 100 when k = len(x) and len(x) = len(y) then 90 when k = len(x) then 70 + greatest(0, 10 - (len(y) - len(x))) when contains(q, p) or contains(p, q) then 50 when k > 0 then 20 + k else 0 end as score from c),
r as (select *, row_number() over (partition by term order by score desc, length(name), name) as place from s where score > 0)
select 'class' as kind, term, name, score, place from r where place <= 3 and score >= 40""")
def gnd_schema(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    minted = part.select(F.lit("class").alias("kind"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "m:").otherwise("known:"), "p_name").alias("term"))
    terms = part.select(F.explode(F.split("p_name", " ")).alias("name"), F.lit("class").alias("kind"))
    return grounding.schema_terms(minted, terms, ("known",))


_SPLIT = r"regexp_split_to_array(text, '\r\n|\r|\n')"


@query("src_dialect_text", rf"""
with l as (select doc_id, unnest({_SPLIT}) as line, generate_subscripts({_SPLIT}, 1) as pos from documents),
c as (select doc_id, pos, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as cells from l where pos > 1)
select doc_id as file, row_number() over (partition by doc_id order by pos) as row, len(cells) as n, md5(array_to_string(cells, chr(9))) as digest from c where len(cells) > 0""")
def src_dialect_text(spark, sf_dir):
    content = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.encode("text", "UTF-8").alias("content"))
    rows = dialects.cells(content, Dialect(delimiter=WHITESPACE, skip_rows=1))
    return rows.select("file", "row", F.size("cells").alias("n"), F.md5(F.array_join("cells", "\t")).alias("digest"))


@query("src_dialect_quoted", "select c_custkey as file, 1 as row, 'key|name' as cells from customer union all select c_custkey, 2, c_custkey || '|' || c_name || chr(10) || 'é;' from customer union all select c_custkey, 3, c_mktsegment from customer")
def src_dialect_quoted(spark, sf_dir):
    text = F.expr(r"""'no table\nkey; name \n' || c_custkey || ';"' || c_name || '\né;"\n;\n\n' || c_mktsegment || '\n'""")
    content = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.encode(text, "ISO-8859-1").alias("content"))
    return dialects.cells(content, Dialect("latin-1", ";", skip_rows=1)).select("file", "row", F.array_join("cells", "|").alias("cells"))


def _carded(spark, sf_dir):
    text = F.expr(r"""'Status: ' || o_orderstatus || '\nNote: a: ' || o_orderkey || '\n  goes on\n\n--- head: x\nStatus: again\nid  Status\n1 2\n3\n4 5 ' || o_orderkey || '\n'""")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.encode(text, "UTF-8").alias("content"))


_CARD = Dialect(delimiter=WHITESPACE, skip_rows=6, preamble="keyvalue")


@query("preamble_origins", """
select o_orderkey as file, 1 as place, 'Status' as name, o_orderstatus as value, 1 as line, 'Status: ' || o_orderstatus as text, true as named from orders
union all select o_orderkey, 2, 'Note', 'a: ' || o_orderkey || ' goes on', 2, 'Note: a: ' || o_orderkey, true from orders union all select o_orderkey, 3, 'Status_2', 'again', 6, 'Status: again', true from orders""")
def preamble_origins(spark, sf_dir):
    return dialects.preamble(_carded(spark, sf_dir), _CARD)


@query("preamble_broadcast", """
select o_orderkey as file, row, cells, o_orderstatus as status, 'a: ' || o_orderkey || ' goes on' as note, 'again' as again
from orders, (values (1, 'id,Status'), (2, '1,2'), (3, '3,'), (4, '4,5')) v(row, cells)""")
def preamble_broadcast(spark, sf_dir):
    rows = dialects.broadcast_rows(_carded(spark, sf_dir), _CARD)
    return rows.select("file", "row", F.array_join("cells", ",").alias("cells"), F.col("meta")["Status_3"].alias("status"), F.col("meta")["Note"].alias("note"), F.col("meta")["Status_2"].alias("again"))


@query("detect_dialect_job", """
select c_custkey as file, case when c_custkey % 4 = 3 then 'cp932' else 'utf-8-sig' end as encoding, [',', chr(9), 'whitespace', ';'][c_custkey % 4 + 1] as delimiter, [0, 1, 2, 0][c_custkey % 4 + 1] as skip_rows from customer""")
def detect_dialect_job(spark, sf_dir):
    rows = lambda sign: f"array_join(transform(sequence(1, 6), i -> i || '{sign}' || c_custkey || '{sign}x'), '\\n')"
    text = F.expr(f"case c_custkey % 4 when 0 then {rows(',')} when 1 then 'export of ' || c_name || '\\n' || {rows(chr(9))} when 2 then 'Name: a, b c\\n\\n' || {rows('   ')} else {rows(';')} end")
    odd = F.when(F.col("c_custkey") % 4 == 3, F.unhex(F.lit("81"))).otherwise(F.unhex(F.lit("")))
    tail = F.when(F.col("c_custkey") % 4 == 3, F.unhex(F.lit("40"))).otherwise(F.unhex(F.lit("")))  # 81 40 is a wide blank in cp932, no UTF-8
    return dialects.detected(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.concat(F.encode(text, "UTF-8"), odd, tail).alias("content")))
