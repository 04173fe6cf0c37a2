"""Profiles, crosswalk discovery and tools over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import discovery, documents, profile, tools
from linkspark.operators.mapping import TYPE
from linkspark.plans.queries import _quads
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t
from linkspark.streaming import incremental

_CUST = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("prof_id_candidates", "select c as column, r as rate, r >= 0.95 or c like '%key' as candidate from (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) as c, unnest([count(distinct c_custkey) / count(*), count(distinct c_name) / count(*), count(distinct c_nationkey) / count(*), count(distinct c_mktsegment) / count(*)]) as r from customer)")
def prof_id_candidates(spark, sf_dir):
    return profile.id_candidates(_t(spark, sf_dir, "customer").select(*_CUST))


@query("prof_key_choice", "select key, parts, n as rows, row_number() over (order by parts, n desc, key) as place from (select 'c_custkey' as key, 1 as parts, count(*) as n from customer union all select 'c_name', 1, count(*) from customer having count(distinct c_name) = count(*) union all select 'c_custkey,c_name', 2, count(*) from customer)")
def prof_key_choice(spark, sf_dir):
    return profile.key_choice(_t(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@query("prof_column_owner", "select * from (values ('o_orderkey', null), ('o_custkey', 'o_orderkey'), ('c_nationkey', 'o_custkey'), ('o_totalprice', 'o_orderkey')) v(\"column\", owner) where exists (select 1 from orders)")
def prof_column_owner(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_custkey", "c_nationkey", "o_totalprice")
    return profile.column_owner(rows, [("o_orderkey",), ("o_custkey",)])


@query("prof_growth_overlap", "with c as (select c_nationkey as f, c_mktsegment as v from customer), p as (select f, count(distinct v) as k, min(v) as v from c group by 1) select 'c_mktsegment' as column, count(*) as files, count(*) filter (k = 1) as constant, (select count(*) from (select v from p where k = 1 group by v having count(*) > 1)) as shared from p union all select 'c_nationkey2', count(*), count(*), 0 from p")
def prof_growth_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_nationkey") + 100).alias("c_nationkey2"))
    return profile.growth_overlap(rows, "c_nationkey")


@query("prof_scope_risk", "select 'turn' as key, count(*) = count(distinct turn) as safe, count(*) = count(distinct (conv_id, turn)) as scoped from conversations")
def prof_scope_risk(spark, sf_dir):
    return profile.scope_risk(_t(spark, sf_dir, "conversations"), ("turn",), "conv_id")


@query("prof_missing_row_kind", "select 'o_totalprice' as column, 'o_orderkey' as key, count(*) as entities from orders union all select 'o_orderkey', 'o_orderkey', count(*) from orders")
def prof_missing_row_kind(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.missing_row_kind(rows, [("o_custkey",)], ["o_orderkey"])


@query("prof_entity_preview", "with k as (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 1), r as (select * from orders where o_custkey = (select o_custkey from k)) select 'o_orderpriority' as column, count(distinct o_orderpriority)::int as values, min(o_orderpriority) as least, case when count(distinct o_orderpriority) = 1 then 'stable' else 'varying' end as verdict from r union all select 'o_orderkey', count(distinct o_orderkey)::int, min(o_orderkey::varchar), case when count(distinct o_orderkey) = 1 then 'stable' else 'varying' end from r")
def prof_entity_preview(spark, sf_dir):
    return profile.entity_preview(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ("o_custkey",))


@query("prof_demand", "select * from (values ('k', null), ('pct', 'percent'), ('span', 'range'), ('money', 'currency'), ('url', 'url'), ('flag', 'boolean'), ('js', 'json'), ('size', 'value_unit')) v(\"column\", category) where exists (select 1 from part)")
def prof_demand(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    rows = _t(spark, sf_dir, "part").select(k.alias("k"), F.concat(k, F.lit("%")).alias("pct"), F.concat(F.lit("1-"), k).alias("span"), F.concat(F.lit("$1,"), k).alias("money"), F.concat(F.lit("http://x/"), k).alias("url"), F.when(F.col("p_partkey") % 2 == 0, "yes").otherwise("No").alias("flag"), F.concat(F.lit('{"a": '), k, F.lit("}")).alias("js"), F.concat(k, F.lit(" mm")).alias("size"))
    return profile.demand(rows)


@query("prof_source_samples", "select 'c_mktsegment' as column, list(v order by v)[1:3] as values from (select distinct trim(c_mktsegment) as v from customer) union all select 'c_nationkey', list(v order by v)[1:3] from (select distinct c_nationkey::varchar as v from customer)")
def prof_source_samples(spark, sf_dir):
    return profile.source_samples(_t(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"))


@query("map_numeric_datatypes", "select * from (values ('c_custkey', 'xsd:integer'), ('c_nationkey', 'xsd:integer'), ('c_acctbal', 'xsd:double')) v(\"column\", datatype) where exists (select 1 from customer)")
def map_numeric_datatypes(spark, sf_dir):
    return profile.numeric_datatypes(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))


def _values(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    one = lambda dataset, predicate, value, rows=part: rows.select(F.lit(dataset).alias("dataset"), F.lit(predicate).alias("predicate"), value.alias("value"))
    name = F.col("p_name")
    return one("parts", "name", name).unionByName(one("catalog", "title", F.upper(name), part.where("p_partkey % 2 = 0"))).unionByName(one("stock", "label", F.concat(F.lit(" "), name), part.where("p_partkey % 3 = 0"))).unionByName(one("parts", "number", F.col("p_partkey").cast("string")))


_V = """v as (
  select 'parts' as dataset, 'name' as predicate, p_name as value from part
  union all select 'catalog', 'title', upper(p_name) from part where p_partkey % 2 = 0
  union all select 'stock', 'label', ' ' || p_name from part where p_partkey % 3 = 0
  union all select 'parts', 'number', p_partkey::varchar from part)"""


@query("xw_normalize_ladder", f"with {_V} select 'identity' as rung, dataset, predicate, trim(value) as key, min(value) as raw, count(*) as n from v group by all union all select 'loose_text', dataset, predicate, trim(lower(value)) as key, min(value), count(*) from v group by all")
def xw_normalize_ladder(spark, sf_dir):
    return discovery.ladder(_values(spark, sf_dir), ("identity", "loose_text"))


@query("xw_classify_slots", f"with {_V} select dataset, predicate, case when predicate = 'number' then 'numeric' end as excluded from v group by all")
def xw_classify_slots(spark, sf_dir):
    return discovery.classify(_values(spark, sf_dir))


@query(
    "xw_discover",
    f"""with {_V}, r as (select dataset, trim(value) as own, lower(trim(value)) as fold from v where predicate <> 'number'),
ig as (select own, count(distinct dataset) as d from r group by 1), lg as (select fold, count(distinct dataset) as d from r group by 1),
i as (select count(*) filter (d > 1) as matched from ig), l as (select count(*) filter (d > 1) as matched from lg),
z as (select dataset, count(*) as statements, count(distinct own) as n, count(distinct own) filter (ig.d > 1) as same, count(distinct fold) filter (lg.d > 1) as folded from r join ig using (own) join lg using (fold) group by 1),
m as (select greatest(i.matched, l.matched) as matched, l.matched > i.matched as folds, i.matched as same from i, l),
w as (select min(n) as least, max(statements / n) as fanout, min(case when folds then folded else same_ end / n) as low, max(case when folds then folded else same_ end / n) as high from (select z.* rename (same as same_), folds from z, m))
select ['catalog', 'parts', 'stock'] as datasets, ['title', 'name', 'label'] as predicates, case when folds then 'loose_text' else 'identity' end as rung, matched, log10(1 + matched) * high * 2 as score,
  list_filter([case when matched = 1 then 'single_value_overlap' end, case when least < 8 then 'low_cardinality' end, case when fanout > 1000 then 'high_fanout' end, case when folds and same = 0 then 'fold_only_match' end, case when low < 0.01 and high > 0.5 then 'asymmetric_coverage' end], lambda x: x is not null) as flags
from m, w where matched > 0""",
)
def xw_discover(spark, sf_dir):
    return discovery.discover(_values(spark, sf_dir), 3, ("identity", "nfkc", "loose_text"))


@query("xw_samples", f"with {_V}, k as (select lower(trim(value)) as key, dataset, min(value) as raw from v group by all), g as (select key, count(*) as d, count(distinct raw) as spellings, list(dataset || ': ' || raw order by dataset || ': ' || raw) as raw from k where dataset || key <> '' group by 1) select key, spellings::int as spellings, raw from g where d > 1 order by spellings desc, key limit 10")
def xw_samples(spark, sf_dir):
    return discovery.samples(discovery.ladder(_values(spark, sf_dir).where("predicate <> 'number'"), ("loose_text",)), "loose_text")


SEARCH = tools.Tool(
    "order_search",
    (tools.Param("priority", "enum", choices=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), tools.Param("least", "number", default=0, low=0, high=1e9), tools.Param("limit", "integer", default=20, low=1, high=100)),
    lambda t, a: t.where(F.col("o_totalprice") >= a["least"]) if a["priority"] is None else t.where((F.col("o_totalprice") >= a["least"]) & (F.col("o_orderpriority") == a["priority"])),
    ("o_orderkey",),
    ("o_orderkey", "o_totalprice"),
)


@query("tool_parametrized", "select o_orderkey, o_totalprice, n > 25 as truncated from (select *, count(*) over () as n from orders where o_totalprice >= 1000) order by o_orderkey limit 25")
def tool_parametrized(spark, sf_dir):
    return tools.run(SEARCH, _t(spark, sf_dir, "orders"), {"least": "1000"}, 25)


@query("tool_sample_search", "select distinct p_name from part where contains(lower(p_name), 'an') order by p_name limit 20")
def tool_sample_search(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(tools.contains_ci(F.col("p_name"), "AN")).select("p_name").distinct().orderBy("p_name").limit(20)


@query("tool_flat_rows", "select c_custkey::varchar as c_custkey, c_name, true as truncated, (select count(*) from customer) as row_count from customer order by c_custkey::varchar limit 5")
def tool_flat_rows(spark, sf_dir):
    return tools.flat_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), 5, "c_custkey")


@query("tool_structure_lookup", "select p_partkey, p_brand from part where p_size = 7")
def tool_structure_lookup(spark, sf_dir):
    lookup = tools.Tool("by_size", (tools.Param("size", "integer", required=True, low=1, high=50),), lambda t, a: t.where(F.col("p_size") == a["size"]), ("p_partkey",), ("p_partkey", "p_brand"))
    return lookup.ask(_t(spark, sf_dir, "part"), tools.bind(lookup, {"size": "7"})).select("p_partkey", "p_brand")


@query("tool_trial_queries", "select * from (select 'count' as kind, 'x:Order' as predicate, count(*) as detail from orders union all select 'count', 'x:Customer', count(*) from customer union all select 'range', 'x:total', count(*) from orders) where detail > 0")
def tool_trial_queries(spark, sf_dir):
    return tools.trial_queries(_quads(spark, sf_dir, TYPE, "x:total"), 2)


@query("tool_draft_stats", "select 'customer' as source, 'x:Customer' as class, count(*) as rows, count(*) as entities from customer union all select 'part', 'x:Part', count(*), 0 from part")
def tool_draft_stats(spark, sf_dir):
    sources = {n: _t(spark, sf_dir, n) for n in ("customer", "part")}
    return tools.draft_stats(_quads(spark, sf_dir, TYPE), sources, {"customer": "x:Customer", "part": "x:Part"})


@query("tool_quote", None)
def tool_quote(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return tools.quote(documents.sentences(docs), docs.select("doc_id", "source"), "the", 50)


_PARA = "select doc_id, unnest(string_split(text, chr(10))) as p, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null"


@query("doc_paragraphs", f"with r as ({_PARA}), k as (select doc_id, trim(p) as paragraph, i from r where trim(p) <> '') select doc_id, row_number() over (partition by doc_id order by i) - 1 as position, paragraph from k")
def doc_paragraphs(spark, sf_dir):
    return documents.paragraphs(_t(spark, sf_dir, "documents"))


@query("doc_fulltext", f"with r as ({_PARA}), k as (select doc_id, trim(p) as paragraph, i from r where trim(p) <> '') select doc_id, string_agg(paragraph, chr(10) order by i) as context, count(*) as paragraphs from k group by 1")
def doc_fulltext(spark, sf_dir):
    return documents.fulltext(documents.paragraphs(_t(spark, sf_dir, "documents")))


@query("doc_provenance", "select doc_id, 'http://x/activity/' || substr(sha256(coalesce(text, '')), 1, 12) as activity from documents")
def doc_provenance(spark, sf_dir):
    return documents.provenance(_t(spark, sf_dir, "documents"), "http://x/activity/")


@query("str_batch_digest", "select event_type, count(*) as rows from events group by 1")
def str_batch_digest(spark, sf_dir):
    return incremental.batch_sizes(_t(spark, sf_dir, "events"), "event_type")


@query("src_jsonl_ledger", "select event_id, ts from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from events) where ts >= (select strftime(min(ts), '%Y-%m') from events)")
def src_jsonl_ledger(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    lines = events.select(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))).alias("value"))
    since = events.agg(F.date_format(F.min("ts"), "yyyy-MM")).first()[0]
    return incremental.ledger(lines.unionByName(lines.limit(1).select(F.lit("{broken").alias("value"))), "event_id long, ts string", since=since)


@query("sample_even", "with n as (select count(*) as n from part), r as (select p_partkey, row_number() over (order by p_partkey) - 1 as i from part), want as (select distinct round(j * (n - 1) / 9.0)::bigint as i from n, range(10) t(j)) select p_partkey from r join want using (i)")
def sample_even(spark, sf_dir):
    return profile.even_sample(_t(spark, sf_dir, "part"), "p_partkey", 10)


@query("subset_by_first_keys", "select o_orderkey, o_custkey from orders where o_custkey in (select distinct o_custkey from orders where o_orderpriority = '1-URGENT' order by 1 limit 5)")
def subset_by_first_keys(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return profile.subset(orders, orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", 5).select("o_orderkey", "o_custkey")


@query(
    "prof_summaries",
    """with t as (select count(*) as total from conversations), v as (
  select 'conv_id' as c, conv_id::varchar as v, 'integer' as type, null as element from conversations union all select 'role', trim(coalesce(role, '')), 'string', null from conversations
  union all select 'len (chars)', case when turn % 2 = 0 then length(text)::varchar else (length(text) || '.5') end, 'double', null from conversations
  union all select 'tags', '["' || role || '"]', 'json-array', 'string' from conversations union all select 'of', '{"t":' || turn || '}', 'json-object', null from conversations
  union all select 'first', (turn = 0)::varchar, 'boolean', null from conversations union all select 'none', '', 'string', null from conversations)
select c as column, total, count(*) filter (v <> '') as filled, count(distinct v) filter (v <> '') as "distinct", max(type) as type, false as mixed, max(element) as element,
  case when c = 'len (chars)' then 'chars' end as unit, min(v) filter (v <> '') as low from v, t group by c, total""",
)
def prof_summaries(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").where("role is not null and text is not null")
    size = F.concat(F.length("text").cast("string"), F.when(F.col("turn") % 2 == 0, "").otherwise(".5"))
    rows = rows.select("conv_id", "role", size.alias("len (chars)"), F.to_json(F.array("role")).alias("tags"), F.to_json(F.struct(F.col("turn").alias("t"))).alias("of"), (F.col("turn") == 0).alias("first"), F.lit(" ").alias("none"))
    return profile.summaries(rows).select("column", "total", "filled", "distinct", "type", "mixed", "element", "unit", F.get("samples", F.lit(0)).alias("low"))
