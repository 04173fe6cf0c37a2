"""Queries over articles that are made from the turns of the conversations, nested, broken and incomplete ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators import articles
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t


def _gathered(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """One text for each group of rows, in order."""
    held = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(held, lambda r: r[text]), "").alias(text))


def _articles(spark, sf_dir) -> DataFrame:
    """An article for each conversation: a section for each two turns (every third without an id), in it one for each
    turn, with attributes in any order, lists, references, and figures with and without id, label or caption. Of eleven
    articles one isn't well-formed, one declares an entity and one has no body."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "").alias("plain"))
    said = F.when(F.col("turn") % 2 == 0, F.format_string("<label>Fig %d</label>", "turn")).otherwise(F.format_string("<caption content-type='c'><p>cap %d</p></caption>", "turn"))
    turn = F.concat(
        F.format_string('<sec sec-type="a > b" id="t%d"><title>%d.2 <italic>%s</italic>\n result</title>', "turn", F.col("turn") + 1, "role"),
        F.format_string("<p>%s &amp; x</p><!-- <p>no</p> --><list><list-item><p>item %d</p><p>%s</p></list-item></list>", "plain", "turn", "role"),
        F.format_string("<fig position='float' id = 'f%d'>%s</fig><fig><label>none</label></fig></sec>", "turn", said),
    )
    pairs = _gathered(rows.select("conv_id", "k", "turn", turn.alias("x")), ["conv_id", "k"], "turn", "x")
    kind = F.when(F.col("k") == 0, "Introduction").when(F.col("k") == 1, "Results &#38; discussion").otherwise("Other")
    has = F.when(F.col("k") % 3 == 2, "").otherwise(F.format_string(' id="p%d"', "k"))
    pairs = pairs.select("conv_id", "k", F.concat(F.format_string("<sec%s><title>%d. %s</title>", has, F.col("k") + 1, kind), "x", F.lit("</sec>")).alias("x"))
    body = _gathered(pairs, ["conv_id"], "k", "x")
    left = F.col("conv_id") % 11
    start = F.when(left == 5, '<!DOCTYPE article [<!ENTITY a "A">]>').otherwise('<?xml version="1.0"?>')
    whole = F.concat(start, F.format_string("<article><front/><body><p>start %d</p>", "conv_id"), "x", F.when(left == 3, "").otherwise("</body>"), F.lit("</article>"))
    return body.select(F.col("conv_id").alias("doc_id"), F.when(left == 7, "<article><front/></article>").otherwise(whole).alias("xml"))


_ROWS = r"""c as (select conv_id, turn, turn // 2 as k, coalesce(role, '') as role,
  trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') || ' & x', ' +', ' ', 'g')) as plain
  from conversations where conv_id % 11 not in (3, 5, 7)),
kept as (select * from c where k % 3 <> 2),
paras as (select conv_id, 't' || turn as section, turn, k, 0 as n, plain as paragraph from kept
  union all select conv_id, 't' || turn, turn, k, 1, 'item ' || turn || role from kept
  union all select distinct conv_id, '_body', null, null, 0, 'start ' || conv_id from c),
placed as (select *, row_number() over (partition by conv_id order by turn nulls last, n) - 1 as position from paras)"""


@query(
    "doc_sections",
    f"""with {_ROWS} select distinct conv_id as doc_id, 'p' || k as section, null as parent, 1 as level,
  (k + 1) || '. ' || case k when 0 then 'Introduction' when 1 then 'Results & discussion' else 'Other' end as title, (k + 1)::varchar as path,
  case k when 0 then 'Introduction' when 1 then 'Results,Discussion' else '' end as roles from kept
union all select conv_id, 't' || turn, 'p' || k, 2, (turn + 1) || '.2 ' || case when role = '' then '' else role || ' ' end || 'result', (turn + 1) || '-2', '' from kept
union all select distinct conv_id, '_body', null, 1, '', '', '' from c""",
)
def doc_sections(spark, sf_dir):
    rows = articles.sections(_articles(spark, sf_dir))
    return rows.select("doc_id", "section", "parent", "level", "title", "path", F.array_join("roles", ",").alias("roles"))


@query("doc_blocks", f"with {_ROWS} select conv_id as doc_id, section, n, position, paragraph from placed")
def doc_blocks(spark, sf_dir):
    return articles.paragraphs(_articles(spark, sf_dir)).select("doc_id", "section", "n", "position", "paragraph")


@query(
    "doc_figures",
    f"""with {_ROWS} select conv_id as doc_id, 'f' || turn as figure, 't' || turn as section, case when turn % 2 = 0 then 'Fig ' || turn end as label,
  case when turn % 2 = 1 then 'cap ' || turn end as caption from kept""",
)
def doc_figures(spark, sf_dir):
    return articles.figures(_articles(spark, sf_dir))


@query(
    "doc_xml_inventory",
    f"""with {_ROWS} select conv_id as doc_id, 'section' as element, count(distinct k) as count, count(distinct k) filter (k % 3 <> 2) as with_id from c group by 1
union all select conv_id, 'subsection', count(*), count(*) from c group by 1
union all select conv_id, 'figure', 2 * count(*), count(*) from c group by 1
union all select conv_id, 'paragraph', 1 + 3 * count(*) + count(*) filter (turn % 2 = 1), 0 from c group by 1""",
)
def doc_xml_inventory(spark, sf_dir):
    return articles.inventory(_articles(spark, sf_dir))


@query("doc_errors", "select distinct conv_id as doc_id, case conv_id % 11 when 3 then 'tags do not match' when 5 then 'entities are refused' else 'no body' end as error from conversations where conv_id % 11 in (3, 5, 7)")
def doc_errors(spark, sf_dir):
    return articles.errors(_articles(spark, sf_dir))


_PASSAGES = f"""with {_ROWS}, held as (select conv_id, section as of, position, paragraph from placed
  union all select conv_id, 'p' || k, position, paragraph from placed where k is not null),
said as (select conv_id as doc_id, of as section, count(*) as paragraphs, string_agg(paragraph, chr(10) order by position) as passage from held group by 1, 2)
select * from said"""


@query("doc_passages", _PASSAGES)
def doc_passages(spark, sf_dir):
    return articles.passages(_articles(spark, sf_dir))


@query("tool_fetch_passage", _PASSAGES + " where section = 'p1'")
def tool_fetch_passage(spark, sf_dir):
    return articles.passages(_articles(spark, sf_dir)).where("section = 'p1'")
