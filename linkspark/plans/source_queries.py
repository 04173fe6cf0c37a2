"""Queries over files that are written from the tables, and over all tables as one source set."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.plans.registry import folder, query
from linkspark.plans.registry import table as _t
from linkspark.sources import delimited
from linkspark.sources.source_set import inclusions, source_set
from linkspark.streaming import batches

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_COLUMNS = {
    "region": ("regionkey",),
    "nation": ("nationkey", "regionkey"),
    "customer": ("custkey", "nationkey"),
    "supplier": ("suppkey", "nationkey"),
    "part": ("partkey",),
    "orders": ("orderkey", "custkey"),
    "lineitem": ("orderkey", "partkey", "suppkey"),
}


def _folder(spark) -> str:
    return folder(spark, "sources")


def _inclusions_sql() -> str:
    cells = " union all ".join(f"select {i} as i, '{t}' as source, '{c}' as c, {t[0]}_{c}::varchar as v from {t}" for i, t in enumerate(_TABLES) for c in _COLUMNS[t])
    return f"""with d as (select distinct i, source, c, trim(v) as v from ({cells}) where trim(v) <> ''),
n as (select i, c, count(*) as n from d group by all)
select a.source as from_source, a.c as from_column, b.source as to_source, b.c as to_column, count(*) as overlap, max(n.n) as from_distinct, count(*) / max(n.n) as ratio
from d a join d b on a.c = b.c and a.v = b.v and a.i < b.i join n on n.i = a.i and n.c = a.c group by all"""


@query("join_fk_set", _inclusions_sql())
def join_fk_set(spark, sf_dir):
    """All tables as one source set, their columns named without the table's letter."""
    plain = lambda df: df.select(*[F.col(c).alias(c.partition("_")[2]) for c in df.columns])
    return inclusions({t: plain(_t(spark, sf_dir, t)) for t in _TABLES}, sorted({c for cs in _COLUMNS.values() for c in cs}))


@query("src_csv", "select doc_id::varchar as doc_id, replace(coalesce(text, ''), chr(13), '') as text, coalesce(source, '') as source from documents where trim(coalesce(text, ''), ' ') = coalesce(text, '')")
def src_csv(spark, sf_dir):
    """Documents written as one delimited table, quoted line feeds and quotes included, and read back in ranges."""
    path = _folder(spark) + "/documents.csv"
    docs = _t(spark, sf_dir, "documents").where("trim(coalesce(text, '')) = coalesce(text, '')")
    rows = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    return delimited.table(spark, path)


@query(
    "src_source_set",
    """with s as (select 'nations.json' as source, 'nation' as c, n_nationkey::varchar as v from nation union all select 'nations.json', 'name', n_name from nation
  union all select 'suppliers.csv', 'nation', s_nationkey::varchar from supplier union all select 'suppliers.csv', 'name', s_name from supplier union all select 'suppliers.csv', 'note', '' from supplier)
select source, case source when 'nations.json' then 'json' else 'table' end as kind, c as column, count(*) as "rows", count(distinct nullif(v, '')) as filled from s group by all""",
)
def src_source_set(spark, sf_dir):
    """A folder with suppliers as a table and nations as a wrapped array of objects, read as one source set."""
    folder = _folder(spark)
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit("").alias("note"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    wrapped = nations.agg(F.to_json(F.struct(F.lit(1).alias("page"), F.collect_list(F.struct("nation", "name")).alias("docs"))).alias("value"))  # 25 nations
    out = None
    for name, df, kind in (("suppliers.csv", suppliers, "csv"), ("nations.json", wrapped, "text")):
        part = f"{folder}-{kind}"
        # a folder of part files becomes one file by its name: this source set is of plain files
        (df.coalesce(1).write.option("header", kind == "csv") if kind == "csv" else df.coalesce(1).write).format(kind).save(part)
        _renamed(spark, part, f"{folder}/{name}")
    for name, s in source_set(spark, folder).items():
        cells = s.rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in s.rows.columns])))
        rows = cells.groupBy(F.lit(name).alias("source"), F.lit(s.kind).alias("kind"), "column").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(F.col("v") != "", F.col("v"))).alias("filled"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _renamed(spark, folder: str, to: str) -> None:
    """The one part file of a written folder under another name."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))]
    target = jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    fs.rename(part, target)
    fs.delete(path, True)


_TWO = "o_orderkey % 2 = 0", "o_orderkey % 3 = 0"


@query(
    "str_append_batch",
    f"""with a as (select count(*) as n from orders where {_TWO[0]}), b as (select count(*) as n, count(*) filter (not ({_TWO[0]})) as fresh from orders where {_TWO[1]}),
t as (select o_orderpriority as priority, count(*) as orders from orders where {_TWO[0]} or {_TWO[1]} group by 1)
select 'first' as step, a.n as "rows", a.n as fresh, 1 as seq, false as replay from a union all select 'second', b.n, b.fresh, 2, false from b
union all select 'first again', a.n, a.n, 1, true from a union all select priority, orders, orders, 0, false from t""",
)
def str_append_batch(spark, sf_dir):
    """Orders in two batches that overlap, the first one sent again; what each did, and the table that they make."""
    root, orders = _folder(spark), _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    steps = [(n, batches.append_batch(orders.where(w), root, ["o_orderkey"], by="o_orderpriority")) for n, w in (("first", _TWO[0]), ("second", _TWO[1]), ("first again", _TWO[0]))]
    did = spark.createDataFrame([(n, o.rows, o.fresh, o.seq, o.replay) for n, o in steps], "step string, rows long, fresh long, seq int, replay boolean")
    held = batches.live(spark, root).groupBy(F.col("o_orderpriority").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    return did.unionByName(held.select("step", "rows", F.col("rows").alias("fresh"), F.lit(0).alias("seq"), F.lit(False).alias("replay")))


@query(
    "str_hub_refresh",
    """with v as (select 'customer' as participant, c_custkey::varchar as entity, trim(split_part(c_name, '#', 2)) as raw from customer
  union select 'supplier', s_suppkey::varchar, trim(split_part(s_name, '#', 2)) from supplier),
k as (select lower(raw) as key from v where raw <> '' group by 1 having count(distinct participant) > 1)
select 'hub/number/' || key as hub, participant, entity, raw from v join k on lower(v.raw) = k.key""",
)
def str_hub_refresh(spark, sf_dir):
    """A hub of the numbers in names, kept up over two batches; the customers' batch alone gives no link."""
    root, hubs = _folder(spark), _folder(spark)
    number = lambda c: F.trim(F.split_part(F.col(c), F.lit("#"), F.lit(2))).alias("value")
    customers = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("participant"), F.col("c_custkey").cast("string").alias("entity"), number("c_name"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("participant"), F.col("s_suppkey").cast("string").alias("entity"), number("s_name"))
    for values in (customers, suppliers):
        batches.append_batch(batches.keyed_values(values), root, ["participant", "entity", "value"], by="bucket")
        batches.refreshed_hub(spark, root, hubs, "number")
    return batches.hub_rows(spark, hubs)
