"""Questions over quads, joins, reports and checks that are not in queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import checks, crosswalk, graph, mapping, profile, tools, versions
from linkspark.operators.mapping import TYPE, Map, Property, quads
from linkspark.plans.queries import _Q, CUSTOMER, NATION, ORDER, _quads
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t
from linkspark.sources import readers


@query(
    "map_quad_objects",
    f"with {_Q} select g, s, p, case when p = 'x:total' then null else o end as o, kind, case when p = 'x:total' then 'xsd:double' else '' end as dt, case when g = 'customer' and p = 'x:name' then 'en' else '' end as lang, case when p = 'x:total' then cast(o as double) end as o_num from q",
)
def map_quad_objects(spark, sf_dir):
    q = _quads(spark, sf_dir)
    return q.select("g", "s", "p", F.when(F.col("p") != "x:total", F.col("o")).alias("o"), "kind", "dt", "lang", "o_num")


@query("map_object_kinds", "select 'const' as s, 'x:kind' as p, 'fixed' as o from nation union select 'http://x/n/' || n_nationkey, 'x:label', n_name || ' (' || n_regionkey || ')' from nation union select 'http://x/n/' || n_nationkey, 'x:slug', 'http://x/' || lower(replace(n_name, '_', '-')) from nation")
def map_object_kinds(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").withColumn("slug", mapping.function("slug")(F.col("n_name")))
    const = Map("const", (), (Property("x:kind", constant="fixed"),))
    made = Map("http://x/n/{n_nationkey}", (), (Property("x:label", function="template_of", columns=("n_name", "n_regionkey"), args=("{1} ({2})",)), Property("x:slug", template="http://x/{slug}")))
    return mapping.all_quads(quads(nation, const, "a", distinct=False), quads(nation, made, "a", distinct=False)).select("s", "p", "o")


@query("agg_count_all", f"with {_Q} select g, count(*) as n from q group by rollup (g)")
def agg_count_all(spark, sf_dir):
    return graph.count_all(_quads(spark, sf_dir))


@query("agg_distinct_values", "select value, [''] as datatypes, true as truncated from (select distinct o_orderpriority as value from orders order by value limit 3)")
def agg_distinct_values(spark, sf_dir):
    return graph.distinct_values(_quads(spark, sf_dir, "x:priority"), "x:priority", 3)


@query("agg_top_record", f"with {_Q}, top as (select s from o order by o_totalprice desc, s limit 1) select q.s, p, case when p = 'x:total' then 'n' else q.o end as o from q join top on top.s = q.s where kind = 'literal'")
def agg_top_record(spark, sf_dir):
    found = graph.top_record(_quads(spark, sf_dir, "x:total", "x:priority"), "x:total")
    return found.select("s", "p", F.when(F.col("p") == "x:total", "n").otherwise(F.col("o")).alias("o"))


@query("agg_entity_count", f"with {_Q} select count(distinct s) as n from q")
def agg_entity_count(spark, sf_dir):
    return graph.entity_count(_quads(spark, sf_dir))


@query("agg_per_parent_counts", "select 'http://x/customer/' || c_custkey as parent, c_name as title, n from (select o_custkey, count(*) as n from orders group by 1) join customer on c_custkey = o_custkey order by n desc, parent limit 10")
def agg_per_parent_counts(spark, sf_dir):
    return graph.per_parent(_quads(spark, sf_dir, "x:customer", "x:name"), "x:customer", "x:name", 10)


@query("agg_count_by_class_pivot", 'select (select count(*) from orders) as "Order", (select count(*) from customer) as "Customer", (select count(*) from nation) as "Nation"')
def agg_count_by_class_pivot(spark, sf_dir):
    return graph.class_pivot(_quads(spark, sf_dir, TYPE), ["x:Order", "x:Customer", "x:Nation"])


@query("agg_cross_group", "select c_mktsegment as segment, max(o_totalprice) as top, count(distinct c_custkey) as customers, min(o_orderkey) as example from orders join customer on c_custkey = o_custkey group by 1 order by top desc, segment limit 12")
def agg_cross_group(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return tools.cross_group(rows, "c_mktsegment", "o_totalprice", "c_custkey", "o_orderkey", 12).withColumnsRenamed({"group": "segment", "entities": "customers"})


@query("agg_activity_summary", "select event_type as run, count(*) as entities, min(ts) as started, max(ts) as ended from events group by 1")
def agg_activity_summary(spark, sf_dir):
    return tools.activity_summary(_t(spark, sf_dir, "events"), "event_type", "ts")


@query("agg_source_rows", "select count(*) as n from events where props is not null or event_id is not null")
def agg_source_rows(spark, sf_dir):
    return profile.source_rows(_t(spark, sf_dir, "events"))


@query("agg_conversion_stats", "select count(*) as rows_in, count(*) filter (c_acctbal >= 0) as rows_ok, count(*) filter (c_acctbal < 0) as rows_err, 3 * count(*) filter (c_acctbal >= 0) as triples_out, case when count(*) filter (c_acctbal < 0) = 0 then 'ok' else 'partial' end as status from customer")
def agg_conversion_stats(spark, sf_dir):
    return readers.ingest_stats(_t(spark, sf_dir, "customer"), F.col("c_acctbal") >= 0, 3)


@query("sink_error_rows", "select c_custkey as row, 'negative balance' as error from customer where c_acctbal < 0")
def sink_error_rows(spark, sf_dir):
    return readers.error_rows(_t(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal") >= 0, "negative balance").select("row", "error")


@query("sink_ntriples_round_trip", "select 'http://x/d/' || doc_id as s, 'x:text' as p, coalesce(text, '') as o, 'literal' as kind, '' as dt, '' as lang from documents where coalesce(text, '') <> ''")
def sink_ntriples_round_trip(spark, sf_dir):
    spec = Map("http://x/d/{doc_id}", (), (Property("x:text", column="text"),))
    return readers.ntriples_of(mapping.to_ntriples(quads(_t(spark, sf_dir, "documents"), spec, "d")))


@query("src_ntriples_errors", "select value, 'not an N-Triples line' as error from (select case when event_id % 3 = 0 then '<http://x/' || event_id || '> <x:v> \"1\" .' when event_id % 3 = 1 then '# note' else 'broken ' || event_id end as value from events) where value like 'broken%'")
def src_ntriples_errors(spark, sf_dir):
    e = F.col("event_id")
    value = F.when(e % 3 == 0, F.concat(F.lit("<http://x/"), e, F.lit('> <x:v> "1" .'))).when(e % 3 == 1, "# note").otherwise(F.concat(F.lit("broken "), e))
    return readers.error_lines(_t(spark, sf_dir, "events").select(value.alias("value")))


@query("flt_strstarts_regex", f"with {_Q} select s, o from q where s like 'http://x/customer/%' and p = 'x:segment' and regexp_matches(o, '^(AUTO|BUILD)')")
def flt_strstarts_regex(spark, sf_dir):
    return tools.iri_filter(_quads(spark, sf_dir, "x:segment"), "http://x/customer/", "^(AUTO|BUILD)").select("s", "o")


@query("flt_in_list", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def flt_in_list(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("flt_not_exists_labels", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def flt_not_exists_labels(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("flt_max_length", "select lang, count(*) filter (length(text) <= 500) as kept, count(*) filter (length(text) > 500) as dropped from documents where text is not null group by 1")
def flt_max_length(spark, sf_dir):
    return tools.length_filter(_t(spark, sf_dir, "documents").where("text is not null"), "lang", "text", 500)


@query("join_union_branches", f"with {_Q} select s, o as label from q where p = 'x:name' union select s, o from q where p = 'x:priority'")
def join_union_branches(spark, sf_dir):
    return graph.union_branches(_quads(spark, sf_dir, "x:name", "x:priority"), ("?s", "x:name", "?label"), ("?s", "x:priority", "?label"))


@query("join_cross_dataset", "select s_suppkey, c_custkey from supplier join customer on upper(substr(s_name, 10)) = upper(substr(c_name, 10))")
def join_cross_dataset(spark, sf_dir):
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", crosswalk.normalize(F.substring("s_name", 10, 99), "strip,casefold").alias("key"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", crosswalk.normalize(F.substring("c_name", 10, 99), "strip,casefold").alias("key"))
    return a.join(b, "key").select("s_suppkey", "c_custkey")


@query("join_parent_map", "select 'http://x/order/' || o_orderkey as s, 'x:segmentOf' as p, 'http://x/segment/' || c_mktsegment as o from orders join customer on c_custkey = o_custkey")
def join_parent_map(spark, sf_dir):
    parent = Map("http://x/segment/{c_mktsegment}")
    return mapping.parent_links(_t(spark, sf_dir, "orders"), ORDER, "x:segmentOf", _t(spark, sf_dir, "customer"), parent, [("o_custkey", "c_custkey")])


@query("join_compound_tuple", "select o_custkey as entity, [a, b] as key, 0 as dropped from (select distinct o_custkey, o_orderpriority as a from orders) join (select distinct o_custkey as c, o_orderstatus as b from orders) on c = o_custkey")
def join_compound_tuple(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    part = lambda n: orders.select(F.col("o_custkey").alias("entity"), F.lit(n).alias("part"), F.col(n).alias("value"))
    return graph.compound(part("o_orderpriority").unionByName(part("o_orderstatus")), ["o_orderpriority", "o_orderstatus"])


@query("win_cap_per_entity", "with t as (select o_custkey as entity, count(distinct o_orderpriority) * count(distinct o_orderstatus) as n from orders group by 1) select entity, least(n, 4) as kept, greatest(n - 4, 0) as dropped from t")
def win_cap_per_entity(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    part = lambda n: orders.select(F.col("o_custkey").alias("entity"), F.lit(n).alias("part"), F.col(n).alias("value"))
    rows = graph.compound(part("o_orderpriority").unionByName(part("o_orderstatus")), ["o_orderpriority", "o_orderstatus"], 4)
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("kept"), F.max("dropped").alias("dropped"))


@query("join_host_match", "select p_partkey as entity, candidate, n_nationkey as match from (select p_partkey, unnest([p_brand, p_type, n]) as candidate, unnest([1, 2, 3]) as place, n from part, (select min(n_name) as n from nation)) join nation on n_name = candidate qualify row_number() over (partition by p_partkey order by place) = 1")
def join_host_match(spark, sf_dir):
    least = _t(spark, sf_dir, "nation").agg(F.min("n_name").alias("n"))
    rows = _t(spark, sf_dir, "part").crossJoin(F.broadcast(least)).select(F.col("p_partkey").alias("entity"), F.array("p_brand", "p_type", "n").alias("candidates"))  # one row
    return tools.first_match(rows, _t(spark, sf_dir, "nation").select(F.col("n_name").alias("candidate"), F.col("n_nationkey").alias("match")))


@query("join_most_stable", "select o_custkey as key, min(o_totalprice) as least, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as entity from orders group by 1")
def join_most_stable(spark, sf_dir):
    return tools.most_stable(_t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("join_labels", "select 'http://x/nation/' || n_nationkey as term, n_name as label from nation")
def join_labels(spark, sf_dir):
    q = _quads(spark, sf_dir, "x:name", "x:region")
    return graph.labels(q, q.where("g = 'nation'").select(F.col("s").alias("term")).distinct(), "x:name")


@query("join_alignment", "select substr(sha1('x:' || p_type || chr(10) || 'exactMatch' || chr(10) || 'y:' || p_type), 1, 16) as id, 'x:' || p_type as source, 'exactMatch' as relation, 'y:' || p_type as target from (select distinct p_type from part)")
def join_alignment(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_type").distinct().select(F.concat(F.lit("x:"), "p_type").alias("source"), F.lit("exactMatch").alias("relation"), F.concat(F.lit("y:"), "p_type").alias("target"))
    return tools.alignments(rows)


@query("join_path_closure_zero", "with recursive e as (select 'r' || n_regionkey as a, 'n' || n_nationkey as b from nation), c(a, b) as (select a, b from e union select c.a, e.b from c join e on e.a = c.b) select a, b from c union select a, a from e union select b, b from e")
def join_path_closure_zero(spark, sf_dir):
    edges = _t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return graph.closure(edges, least=0)


@query("topk_keep_payload", "select conv_id, n, case when place <= 5 then texts end as texts from (select *, row_number() over (order by n desc, conv_id) as place from (select conv_id, count(*) as n, string_agg(coalesce(text, ''), '|' order by turn) as texts from conversations group by 1))")
def topk_keep_payload(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("c"))
    rows = rows.select("conv_id", "n", F.array_join(F.transform("c", lambda x: x["t"]), "|").alias("texts"))
    return tools.keep_payload(rows, "texts", 5, F.desc("n"), "conv_id")


@query("sort_multi", "select row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as place, o_orderkey from orders order by place limit 50")
def sort_multi(spark, sf_dir):
    return tools.placed(_t(spark, sf_dir, "orders"), 50, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("place", "o_orderkey")


@query("limit_truncated", "select c_custkey, true as truncated from customer order by c_custkey limit 10")
def limit_truncated(spark, sf_dir):
    return graph.truncated(_t(spark, sf_dir, "customer").select("c_custkey"), 10, "c_custkey")


@query("ask_exists", "select count(*) > 0 as found from orders where o_totalprice > 100000")
def ask_exists(spark, sf_dir):
    return graph.exists(_t(spark, sf_dir, "orders").where("o_totalprice > 100000"))


@query("set_reuse_new", "select * from (values ('class', 'x:Customer', 'new'), ('predicate', 'x:name', 'reused'), ('predicate', 'x:segment', 'new'), ('predicate', 'x:nation', 'new')) v(kind, term, status) where exists (select 1 from customer)")
def set_reuse_new(spark, sf_dir):
    return graph.reused(quads(_t(spark, sf_dir, "customer"), CUSTOMER, "c", distinct=False), quads(_t(spark, sf_dir, "nation"), NATION, "n", distinct=False))  # terms are made a set there


@query("win_positional_ids", "select 'http://x/conv/' || conv_id || '/turn/' || (row_number() over (partition by conv_id order by turn, role, text) - 1) as iri, conv_id, turn from conversations")
def win_positional_ids(spark, sf_dir):
    return tools.positional(_t(spark, sf_dir, "conversations"), "http://x/conv/", "conv_id", "turn", "turn", "role", "text").select("iri", "conv_id", "turn")


@query("win_dup_suffix", "select event_id, case when n = 1 then event_type else event_type || '_' || n end as name from (select event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) as n from events)")
def win_dup_suffix(spark, sf_dir):
    return tools.dup_suffix(_t(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "name")


@query("win_representative_group", "select o_custkey as key, o_orderpriority as shown, n from (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by 1, 2) qualify row_number() over (partition by o_custkey order by n desc, f) = 1")
def win_representative_group(spark, sf_dir):
    return tools.representative(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("ver_tombstone", "select g, status from (values ('orders', 'live'), ('customer', 'deleted'), ('nation', 'live')) v(g, status) where exists (select 1 from nation)")
def ver_tombstone(spark, sf_dir):
    graphs = _quads(spark, sf_dir, TYPE).select("g").distinct()
    control = graphs.select(F.col("g").alias("dataset"), F.lit("promoted").alias("status"), F.lit(None).cast("string").alias("live"), F.lit(None).cast("string").alias("staged"))
    return versions.resolve(graphs, versions.tombstone(control, "customer"))


_VERSIONS = """v as (select c_mktsegment || '/v' || (c_custkey % 3) as g, c_mktsegment as dataset from customer),
c as (select distinct dataset, dataset || '/v0' as live, case when length(dataset) % 2 = 0 then dataset || '/v1' end as staged from v)"""


def _versions(spark, sf_dir):
    """Customers as quads, a dataset for each segment in three versions, and their control table."""
    q = quads(_t(spark, sf_dir, "customer"), Map("http://x/c/{c_custkey}", (), (Property("x:segment", column="c_mktsegment"),)), "all")
    q = q.withColumn("g", F.concat("o", F.lit("/v"), F.substring_index("s", "/", -1).cast("long") % 3))
    staged = F.when(F.length("o") % 2 == 0, F.concat("o", F.lit("/v1")))
    return q, q.select(F.col("o").alias("dataset"), F.lit("promoted").alias("status"), F.concat("o", F.lit("/v0")).alias("live"), staged.alias("staged")).distinct()


@query("set_orphans", f"with {_VERSIONS} select g, count(*) as n from v where g not in (select live from c) and g not in (select staged from c where staged is not null) group by g")
def set_orphans(spark, sf_dir):
    q, control = _versions(spark, sf_dir)
    return q.join(versions.orphans(q, control), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ver_stage",
    f"""with {_VERSIONS}, r as (select 'BUILDING' as dataset, 'BUILDING/v1' as waiting), d as (select dataset, live, case when dataset = 'BUILDING' then 'BUILDING/v2' else staged end as staged from c)
select d.dataset, live, staged, waiting, (select count(*) from v where g = staged) as n_staged from d left join r using (dataset)""",
)
def ver_stage(spark, sf_dir):
    q, control = _versions(spark, sf_dir)
    waiting = versions.replaced(control, "BUILDING").select(F.lit("BUILDING").alias("dataset"), F.col("g").alias("waiting"))
    size = q.groupBy(F.col("g").alias("staged")).agg(F.count(F.lit(1)).alias("n"))
    out = versions.stage(control, "BUILDING", "BUILDING/v2").join(waiting, "dataset", "left").join(size, "staged", "left")
    return out.select("dataset", "live", "staged", "waiting", F.coalesce("n", F.lit(0)).alias("n_staged"))


@query("ver_vacuum", f"with {_Q} select g, s, p from q where g <> 'customer' and p = 'rdf:type'")
def ver_vacuum(spark, sf_dir):
    q = _quads(spark, sf_dir, TYPE)
    control = q.select(F.col("g").alias("dataset")).distinct().where("dataset <> 'customer'").select("dataset", F.lit("promoted").alias("status"), F.lit(None).cast("string").alias("live"), F.lit(None).cast("string").alias("staged"))
    return versions.vacuumed(q, control).select("g", "s", "p")


@query("ver_legacy_migrate", f"with {_Q} select distinct 'canon' as g, s, p from q where p = 'rdf:type'")
def ver_legacy_migrate(spark, sf_dir):
    q = _quads(spark, sf_dir, TYPE)
    half = q.withColumn("g", F.when(F.col("g") == "orders", "default").otherwise("canon"))
    again = versions.migrated(versions.migrated(half, "default", "canon"), "default", "canon")
    return again.select("g", "s", "p")


@query(
    "ver_reinstate",
    """select n_name as dataset, case when n_name = 'GERMANY' then 'promoted' when n_name = 'FRANCE' then 'retracted' when n_regionkey = 2 then 'draft' when n_regionkey = 4 then 'retracted' else 'promoted' end as status,
  case when n_regionkey <> 2 or n_name in ('GERMANY', 'FRANCE') then 'http://x/' || n_nationkey || '/v1' end as live from nation""",
)
def ver_reinstate(spark, sf_dir):
    """A dataset a nation, drafts and retracted ones among them; two are retracted, one of these and a draft reinstated."""
    region = F.col("n_regionkey")
    status = F.when(region == 2, "draft").when(region == 4, "retracted").otherwise("promoted")
    live = F.when(region != 2, F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string"), F.lit("/v1")))
    control = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), status.alias("status"), live.alias("live"), F.lit(None).cast("string").alias("staged"))
    both = versions.retract(versions.retract(control, "GERMANY"), "FRANCE")
    return versions.reinstate(versions.reinstate(both, "GERMANY"), "FRANCE X").select("dataset", "status", "live")


MAPS = {"order": ORDER, "customer": CUSTOMER, "nation": NATION}


@query("chk_run_all", "select * from (values ('dangling', 'x:nation', 0)) v(\"check\", subject, n) where false union all select 'dangling', 'x:customer', count(*) from orders where o_custkey % 5 = 0 having count(*) > 0 union all select 'missing_predicate', 'x:Order x:missing', 1 where exists (select 1 from orders) union all select 'dangling', 'x:region', count(*) from nation union all select 'datatype', 'x:priority', count(*) from orders")
def chk_run_all(spark, sf_dir):
    q = _quads(spark, sf_dir).where("not (g = 'customer' and regexp_extract(s, '([0-9]+)$', 1) % 5 = 0)")
    return checks.run_all(q, [("x:Order", "x:missing"), ("x:Order", "x:total")], {"x:priority": "xsd:integer", "x:total": "xsd:double"})


@query("chk_untyped_numeric", "select 'bare' as map, 'o_totalprice' as column, 'xsd:double' as datatype where exists (select 1 from orders)")
def chk_untyped_numeric(spark, sf_dir):
    bare = Map("http://x/o/{o_orderkey}", (), (Property("x:total", column="o_totalprice"), Property("x:priority", column="o_orderpriority")))
    return checks.untyped_numeric(_t(spark, sf_dir, "orders"), {"bare": bare})


@query("chk_duplicate_columns", "select 'o_orderstatus' as column, ['customer', 'order'] as maps, ['order'] as owners where exists (select 1 from orders)")
def chk_duplicate_columns(spark, sf_dir):
    maps = {"order": Map("http://x/o/{o_orderkey}", (), (Property("x:status", column="o_orderstatus"),)), "customer": Map("http://x/c/{o_custkey}", (), (Property("x:status", column="o_orderstatus"),))}
    return checks.duplicate_columns(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), maps)


@query("chk_empty_shell", "select 'line' as map, c as column from (values ('o_orderpriority'), ('o_orderstatus')) v(c) where exists (select 1 from orders)")
def chk_empty_shell(spark, sf_dir):
    maps = {"line": Map("http://x/o/{o_orderkey}"), "customer": Map("http://x/c/{o_custkey}", (), (Property("x:status", column="o_orderstatus"),))}
    return checks.empty_shell(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), maps)


@query("chk_untyped_compare", "select 'price' as column, count(*) as n from orders where o_totalprice is not null having count(*) > 0")
def chk_untyped_compare(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), "o_orderpriority", "o_orderkey")
    return checks.untyped_compare(rows, ["price", "o_orderpriority", "o_orderkey"])


@query("dq_rules", "select * from (select 'impossible' as severity, 'over_ceiling' as rule, count(*) filter (o_totalprice > 400000 or o_totalprice < 0) as n from orders union all select 'suspicious', 'questionable', count(*) filter (o_totalprice > 300000 and o_totalprice <= 400000) from orders union all select 'impossible', 'min_over_max', count(*) filter (o_custkey > o_orderkey) from orders union all select 'impossible', 'count_not_positive', count(*) filter (o_custkey - 50 <= 0) from orders union all select 'suspicious', 'missing_status', count(*) filter (trim(coalesce(o_orderstatus, '')) = '') from orders)")
def dq_rules(spark, sf_dir):
    rules = [*checks.ceiling(F.col("o_totalprice"), 400000, 300000), *checks.aggregate_order(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") - 50), *checks.missing(status=F.col("o_orderstatus"))]
    return checks.audit(_t(spark, sf_dir, "orders"), rules)


@query("dq_domain_limits", "select 'impossible' as severity, 'below_absolute_zero' as rule, count(*) filter (c_custkey % 2 = 0 and c_acctbal < -273.16) as n from customer union all select 'impossible', 'absurd_size', 0 from customer having true union all select 'impossible', 'negative', count(*) filter (c_custkey % 3 = 0 and c_acctbal < 0) from customer")
def dq_domain_limits(spark, sf_dir):
    c = F.col("c_custkey")
    name_x, name_y = F.when(c % 2 == 0, "Temperature").otherwise("Pressure"), F.when(c % 3 == 0, "Electrical Resistivity").otherwise("log(Resistivity)")
    return checks.audit(_t(spark, sf_dir, "customer"), checks.domain_limits(name_x, F.col("c_acctbal"), name_y, F.col("c_acctbal"), F.col("c_acctbal")))


@query("t1_key_uniqueness", "select 'o_orderkey' as key, count(*) = count(distinct o_orderkey) as is_unique from orders union all select 'l_linenumber,l_orderkey', count(*) = count(distinct (l_orderkey, l_linenumber)) from lineitem")
def t1_key_uniqueness(spark, sf_dir):
    one = profile.uniqueness(_t(spark, sf_dir, "orders"), ("o_orderkey",)).select(F.lit("o_orderkey").alias("key"), "is_unique")
    return one.unionByName(profile.uniqueness(_t(spark, sf_dir, "lineitem"), ("l_linenumber", "l_orderkey")).select(F.lit("l_linenumber,l_orderkey").alias("key"), "is_unique"))


@query(
    "tool_schema_summary",
    f"""with {_Q}, t as (select distinct s, o as class from q where p = 'rdf:type'),
cl as (select 'class' as kind, class, null as predicate, count(*) as n from t group by 2), us as (select 'predicate' as kind, null as class, p as predicate, count(*) as n from q group by 3),
sh as (select 'shape' as kind, class, p as predicate, count(*) as n from q join t using (s) group by 2, 3),
ra as (select *, row_number() over (partition by kind, case when kind = 'shape' then class end order by n desc, class, predicate) as place,
  count(*) over (partition by kind, case when kind = 'shape' then class end) as every from (select * from cl union all select * from us union all select * from sh)),
ma as (select *, case kind when 'class' then 2 when 'predicate' then 5 else 3 end as most from ra)
select kind, class, predicate, n, place, every > most as truncated, case when kind = 'class' then 'Class ' || class when predicate <> 'rdf:type' then 'Term ' || predicate end as label from ma
where place <= most and (kind <> 'shape' or class in (select class from ma where kind = 'class' and place <= 2))""",
)
def tool_schema_summary(spark, sf_dir):
    """The two largest classes, the five most used predicates and three of each class, with labels."""
    q = _quads(spark, sf_dir)
    terms = q.select(F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.col("p")).alias("term"), (F.col("p") == TYPE).alias("class")).distinct()
    labels = terms.select("term", F.concat(F.when(F.col("class"), "Class ").otherwise("Term "), "term").alias("label"))
    return graph.schema_summary(q, 2, 5, 3, labels)
