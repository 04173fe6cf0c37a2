"""Profiles of tables: types, keys, functional dependencies, sampling grids."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.values import is_number, text, unit_from_label

INTEGER = r"^[+-]?\d+$"
DATE, DATETIME = r"^\d{4}-\d\d-\d\d$", r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$"


def _distinct_cells(df: DataFrame) -> DataFrame:
    """(column, value, n): how often each filled cell stands in its column. Equal cells meet on the map side, so what is
    shuffled is the distinct cells, once, however many columns there are."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(text(F.col(f"`{c}`"))).alias("value")) for c in df.columns]))
    return df.select(cells).where("value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _kind(v: Column) -> Column:
    """Most specific type that one cell fits."""
    plain = F.when(v.rlike(INTEGER), "integer").when(is_number(v), "double").when(v.rlike(DATE), "date").when(v.rlike(DATETIME), "dateTime")
    shape = F.when(v.rlike(r"^[\[{]"), F.substring(F.schema_of_variant(F.try_parse_json(v)), 1, 5))
    return plain.when(shape == "ARRAY", "json-array").when(shape == "OBJEC", "json-object").when(F.lower(v).isin("true", "false"), "boolean").otherwise("string")


def _common(kinds: Column) -> Column:
    """The narrowest type that takes all the kinds of a column's cells; mixed ones are string."""
    only = lambda *names: F.size(F.array_except(kinds, F.array(*map(F.lit, names)))) == 0
    found = F.when(F.size(kinds) == 0, "string")
    for kind, below in (("integer", ()), ("double", ("integer",)), ("date", ()), ("dateTime", ("date",)), ("json-array", ()), ("json-object", ()), ("boolean", ())):
        found = found.when(only(kind, *below), kind)
    return found.otherwise("string")


def summaries(df: DataFrame) -> DataFrame:
    """(column, total, filled, distinct, type, mixed, element, unit, samples): one row for each column.

    filled: cells with text; distinct: their different texts, trimmed. type: integer, double, date, dateTime, boolean,
    json-array, json-object or string, the narrowest that all filled cells fit; mixed: whether they are of kinds that only
    string takes together. element: object, number or string if the first elements of all JSON arrays are such. unit: what
    the column's name says in brackets. samples: the smallest, the most frequent and the largest cell. All cells count,
    nothing is sampled. Two grouped sums: distinct cells, then a state a column; a column without filled cells is string.
    """
    cells = _distinct_cells(df).withColumn("kind", _kind(F.col("value")))
    first = F.substring(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$[0]", "variant")), 1, 3)
    element = F.when(F.col("kind") == "json-array", F.when(first == "OBJ", "object").when(first.isin("BIG", "DEC", "DOU", "FLO", "INT"), "number").when(first == "STR", "string"))
    often = F.max_by("value", F.struct("n", "value"))
    state = cells.groupBy("column").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct"), F.collect_set("kind").alias("kinds"), F.collect_set(element).alias("elements"), F.min("value").alias("low"), often.alias("often"), F.max("value").alias("high"))
    names = df.agg(F.count(F.lit(1)).alias("total")).select("total", F.explode(F.array(*map(F.lit, df.columns))).alias("column"))
    rows = names.join(state, "column", "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    kind = _common(kinds)
    said = F.array_compact(F.array_distinct(F.array("low", "often", "high")))
    one = F.when((kind == "json-array") & (F.size("elements") == 1), F.get("elements", F.lit(0)))
    mixed = (kind == "string") & (F.size(kinds) > 1)
    return rows.select("column", "total", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("distinct", F.lit(0)).alias("distinct"), kind.alias("type"), mixed.alias("mixed"), one.alias("element"), unit_from_label(F.col("column")).alias("unit"), said.alias("samples"))


def columns(df: DataFrame) -> DataFrame:
    """(column, filled, distinct, type) of summaries()."""
    return summaries(df).select("column", "filled", "distinct", "type")


def _full(key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.trim(text(F.col(c))) != "" for c in key])


def uniqueness(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows considered (all key parts filled), distinct keys, collisions and whether the key is unique."""
    groups = df.where(_full(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    out = groups.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
    return out.select("rows", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("collisions"), (F.col("rows") == F.col("distinct_keys")).alias("is_unique"))


def collisions(df: DataFrame, key: tuple[str, ...], n: int = 10) -> DataFrame:
    """The largest groups of rows that share a key."""
    return df.where(_full(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), *key).limit(n)


def dependencies(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """For each other column whether the key determines it: no key group shows two filled values."""
    others = [c for c in df.columns if c not in key]
    cell = lambda c: F.when(F.trim(text(F.col(c))) != "", F.trim(text(F.col(c))))
    groups = df.where(_full(key)).groupBy(*key).agg(*[F.coalesce(F.min(cell(c)) == F.max(cell(c)), F.lit(True)).alias(f"d{i}") for i, c in enumerate(others)])
    row = groups.agg(*[F.coalesce(F.bool_and(f"d{i}"), F.lit(True)).alias(f"d{i}") for i in range(len(others))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("determined")) for i, c in enumerate(others)])).alias("r")).select("r.*")


def foreign_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Overlap of distinct values of column pairs, and its share of the left side."""
    out = None
    for a, b in pairs:
        x = left.select(F.col(a).cast("string").alias("v")).where("v is not null").distinct()
        y = right.select(F.col(b).cast("string").alias("v"), F.lit(1).alias("hit")).where("v is not null").distinct()
        row = x.join(y, "v", "left").agg(F.count("hit").alias("overlap"), F.count(F.lit(1)).alias("n"))
        row = row.select(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), "overlap", (F.col("overlap") / F.col("n")).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def _steps(rows: DataFrame, order: str, share: int) -> DataFrame:
    """rows (order, v) with step: v less the v before it by order. Ranges of order of about `share` rows each, 1,024 at
    most, are taken apart; the last row of each is carried over to the next."""
    n = rows.count()
    parts = min(1024, -(-n // share))
    keys = rows.where(F.col(order).isNotNull()).select(order).sample(min(1.0, 20 * parts / n), 17) if parts > 1 else None
    edges = sorted({r[0] for r in keys.collect()})[20::20] if keys is not None else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)
    rows = rows.withColumn("part", part)
    lasts = rows.groupBy("part").agg(F.max(F.struct(order, "v")).alias("last"))
    lasts = lasts.select("part", F.lag("last.v").over(Window.orderBy("part")).alias("carried"))  # a row for each range
    own = Window.partitionBy("part").orderBy(order)
    before = F.when(F.row_number().over(own) > 1, F.lag("v").over(own)).otherwise(F.col("carried"))
    return rows.join(F.broadcast(lasts), "part").select(order, "v", (F.col("v") - before).alias("step"))


def sampling_grid(df: DataFrame, order: str, value: str, first: int | None = None, share: int = 10_000) -> DataFrame:
    """Whether a column rises or falls by steps within 1 % of their upper median, over all rows or the first ones.
    The median is exact; it counts the distinct steps in one task."""
    rows = df.select(F.col(order), F.col(value).alias("v"))
    steps = _steps(rows if first is None else rows.orderBy(order).limit(first), order, share)
    out = steps.agg(F.count("v").alias("n"), F.expr("percentile_disc(0.5) within group (order by step desc)").alias("median"))
    near = F.bool_and(F.abs(F.col("step") - F.col("median")) <= 0.01 * F.abs("median")).alias("near")
    even = steps.select("step").where("step is not null").crossJoin(F.broadcast(out.select("median"))).agg(near)
    return out.crossJoin(even).select("n", (F.col("near") & (F.col("median") != 0) & (F.col("n") >= 8)).alias("is_grid"))


def composite_keys(df: DataFrame, candidates: list[str], hints: list[str] | None = None, depth: int = 3) -> DataFrame:
    """uniqueness() and key (names joined by commas) of each candidate alone and with up to depth - 1 of the hints and other candidates, each set once.

    The sets come from column names; each is one grouped count over the whole table. Keep the lists short: their number
    grows with the power `depth`. Without candidates this is an error.
    """
    pool = list(dict.fromkeys([*(hints or []), *candidates]))
    keys = dict.fromkeys(tuple(sorted((c, *more))) for k in range(depth) for c in candidates for more in combinations([p for p in pool if p != c], k))
    if not keys:
        raise ValueError("no candidate columns")
    return reduce(DataFrame.unionByName, [uniqueness(df, key).withColumn("key", F.lit(",".join(key))) for key in keys])


#: Names that speak of an identifier.
ID_NAME = r"(?i)(^|[^a-z])(id|key|code|no|number|doi|uuid|sku)([^a-z]|$)|key$|id$"


def id_candidates(df: DataFrame, least: float = 0.95) -> DataFrame:
    """(column, rate, candidate) for each column: its share of distinct among filled cells; a candidate has `least` of it,
    or the name of an identifier and whole numbers or text."""
    rows = columns(df).withColumn("rate", F.when(F.col("filled") > 0, F.col("distinct") / F.col("filled")).otherwise(0.0))
    named = F.col("column").rlike(ID_NAME) & F.col("type").isin("integer", "string")
    return rows.select("column", "rate", ((F.col("filled") > 0) & ((F.col("rate") >= least) | named)).alias("candidate"))


def key_choice(df: DataFrame, candidates: list[str], measures: tuple[str, ...] = (), depth: int = 2) -> DataFrame:
    """Unique keys among composite_keys(), best first (key, parts, rows, place): not of measures alone, fewer columns, more
    rows, then by name."""
    parts = F.split("key", ",")
    keys = composite_keys(df, candidates, depth=depth).where("is_unique and rows > 0")
    only = F.size(F.array_except(parts, F.array(*map(F.lit, measures)).cast("array<string>"))) == 0
    keys = keys.select("key", F.size(parts).alias("parts"), "rows", only.alias("only"))
    order = Window.partitionBy(F.lit(0)).orderBy("only", "parts", F.desc("rows"), "key")  # a row for each set of columns
    return keys.withColumn("place", F.row_number().over(order)).select("key", "parts", "rows", "place")


def column_owner(df: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """(column, owner): of the keys that determine a column, the one with the fewest entities; null where none does or two
    have equally few. One grouped pass for each key, whose list is the caller's."""
    out = None
    for key in keys:
        size = uniqueness(df, key).select("distinct_keys")
        rows = dependencies(df, key).where("determined").crossJoin(F.broadcast(size)).select("column", F.lit(",".join(key)).alias("owner"), F.col("distinct_keys").alias("entities"))  # size is one row
        out = rows if out is None else out.unionByName(rows)
    best = out.groupBy("column").agg(F.min("entities").alias("entities"))
    fewest = out.join(best, ["column", "entities"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return every.join(fewest, "column", "left").select("column", F.when(F.col("n") == 1, F.col("owner")).alias("owner"))


def growth_overlap(df: DataFrame, file: str) -> DataFrame:
    """(column, files, constant, shared): for each column the files in which it has one value, and how many values stand in
    two such files or more. Appending by a key with such a column mixes files up."""
    others = [c for c in df.columns if c != file]
    cells = df.select(file, *[text(F.col(f"`{c}`")).alias(c) for c in others]).unpivot([file], others, "column", "value")
    per = cells.groupBy("column", file).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    fixed = per.where("low = high and low <> ''").groupBy("column", "low").agg(F.count(F.lit(1)).alias("k"))
    shared = fixed.groupBy("column").agg(F.sum("k").alias("constant"), F.count_if(F.col("k") > 1).alias("shared"))
    files = per.groupBy("column").agg(F.count(F.lit(1)).alias("files"))
    return files.join(shared, "column", "left").select("column", "files", F.coalesce("constant", F.lit(0)).alias("constant"), F.coalesce("shared", F.lit(0)).alias("shared"))


def scope_risk(df: DataFrame, key: tuple[str, ...], file: str) -> DataFrame:
    """One row (key, safe, scoped): whether a key without the file's own key is unique over all files, and whether it is once
    the file's key stands in front."""
    alone, scoped = uniqueness(df, key).select(F.col("is_unique").alias("safe")), uniqueness(df, (file, *key)).select(F.col("is_unique").alias("scoped"))
    return alone.crossJoin(scoped).select(F.lit(",".join(key)).alias("key"), "safe", "scoped")  # one row each


def missing_row_kind(df: DataFrame, mapped: list[tuple[str, ...]], candidates: list[str]) -> DataFrame:
    """(column, key, entities): columns that no mapped key determines, with the smallest unique key that would mint an entity
    for each row. No rows where all are determined or no key is unique."""
    owned = None
    for key in mapped:
        rows = dependencies(df, key).where("determined").select("column")
        owned = rows if owned is None else owned.unionByName(rows)
    named = df.sparkSession.createDataFrame([(c,) for c in df.columns if not any(c in k for k in mapped)], "column string")
    open_ = named.join(owned.distinct(), "column", "left_anti") if owned is not None else named
    best = key_choice(df, candidates).where("place = 1").select("key", F.col("rows").alias("entities"))
    return open_.crossJoin(F.broadcast(best))  # best is one row


def entity_preview(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(column, values, least, verdict) of one entity of a key: the one with most rows, ties by key. verdict: stable (one
    value), empty, or varying."""
    sizes = df.where(_full(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    one = sizes.orderBy(F.desc("n"), *key).limit(1).select(*key)
    rows = df.join(F.broadcast(one), list(key))  # one row
    others = [c for c in df.columns if c not in key]
    cell = lambda c: F.when(F.trim(text(F.col(f"`{c}`"))) != "", F.trim(text(F.col(f"`{c}`"))))
    row = rows.agg(*[F.struct(F.lit(c).alias("column"), F.size(F.collect_set(cell(c))).alias("values"), F.min(cell(c)).alias("least")).alias(f"c{i}") for i, c in enumerate(others)])
    verdict = F.when(F.col("values") == 0, "empty").when(F.col("values") == 1, "stable").otherwise("varying")
    return row.select(F.explode(F.array(*row.columns)).alias("r")).select("r.*").withColumn("verdict", verdict)


# Spellings that ask for a cleaning function, in the order in which they are tried.
DEMAND = (
    ("epoch", r"^-?\d{10}(\d{3})?$"),
    ("percent", r"^[+-]?\d+(\.\d+)?\s*%$"),
    ("range", r"^\d+(\.\d+)?\s*(-|to|\.\.|~)\s*\d+(\.\d+)?$"),
    ("currency", r"^[$€£¥]\s*[\d,]+(\.\d+)?$"),
    ("value_unit", r"^[+-]?\d+(\.\d+)?\s*[A-Za-zµ°Ω/%][A-Za-z0-9µ°Ω/^-]*$"),
    ("doi", r"(?i)^(https?://(dx\.)?doi\.org/|doi:)?10\.\d{3,9}/\S+$"),
    ("url", r"(?i)^https?://\S+$"),
    ("boolean", r"(?i)^(true|false|yes|no|y|n|t|f)$"),
    ("messy_date", r"^(\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})$"),
    ("json", r"^\s*[\[{].*[\]}]\s*$"),
)


def demand(df: DataFrame, least: float = 0.6) -> DataFrame:
    """(column, category): which cleaning a column asks for, by the first spelling that `least` of its filled cells have; null
    for none. All columns in one pass."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(text(F.col(f"`{c}`")))
        full = F.count_if(v != "")
        which = F.lit(None).cast("string")
        for name, pattern in reversed(DEMAND):
            which = F.when((full > 0) & (F.count_if((v != "") & v.rlike(pattern)) >= least * full), name).otherwise(which)
        aggs.append(F.struct(F.lit(c).alias("column"), which.alias("category")).alias(f"c{i}"))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*row.columns)).alias("r")).select("r.*")


def source_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """(column, values): the `n` smallest distinct filled values of each column (a report's limit)."""
    cells = df.select(*[F.trim(text(F.col(f"`{c}`"))).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value").where("value <> ''")
    first = cells.groupBy("column", "value").agg(F.lit(1)).withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("place") <= n)
    return first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values"))


def numeric_datatypes(df: DataFrame) -> DataFrame:
    """(column, datatype): xsd:integer or xsd:double for columns whose every filled cell is a number."""
    rows = columns(df).where("filled > 0 and type in ('integer', 'double')")
    return rows.select("column", F.when(F.col("type") == "integer", "xsd:integer").otherwise("xsd:double").alias("datatype"))


def source_rows(df: DataFrame) -> DataFrame:
    """Number of rows of which some cell is filled (n)."""
    some = reduce(lambda a, b: a | b, [F.trim(text(F.col(f"`{c}`"))) != "" for c in df.columns])
    return df.agg(F.count_if(some).alias("n"))


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """`n` rows spread evenly over the order (the operator's own number), the first and the last among them, without chance.
    Rows are numbered by ranges of the order, not in one task."""
    total = df.count()
    if total <= n:
        return df
    want = sorted({int(j * (total - 1) / (n - 1) + 0.5) for j in range(n)})
    ranged = df.select(F.col(order)).orderBy(order).withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(2**33 - 1))
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    chosen = ranged.withColumn("part", part).join(F.broadcast(starts), "part").where((F.col("before") + place).isin(*want)).select(order)
    return df.join(chosen, order, "left_semi").select(order)


def subset(table: DataFrame, labelled: DataFrame, key: str, n: int) -> DataFrame:
    """Every row of a table whose key is among the first `n` keys of the labelled rows."""
    first = labelled.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return table.join(F.broadcast(first), key, "left_semi")  # n keys


def column_order(rows: DataFrame, order: str, names: str) -> DataFrame:
    """(name, row, position) of each name in the arrays `names` of sparse rows: where it comes first by the column `order`.
    Sorted by row and position this is the order of the columns of a table of all rows. Null names are left out."""
    each = rows.select(F.col(order).alias("row"), F.posexplode(names).alias("position", "name")).where("name is not null")
    return each.groupBy("name").agg(F.min(F.struct("row", "position")).alias("first")).select("name", "first.row", "first.position")


def transform_coverage(maps: DataFrame, gate: float = 0.05) -> DataFrame:
    """(dataset, total, functions, raws, directs, raw_rate, passes), a row a dataset and one with null for all. maps: dataset,
    kind (function, raw or direct; others count in total alone). raw_rate: raws of raws and functions, null without any;
    passes: of the pooled row alone, whether its rate is under the gate."""
    each = maps.where("dataset is not null").groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    out = each.rollup("dataset").agg(F.grouping("dataset").alias("all"), F.sum("n").alias("total"), of("function").alias("functions"), of("raw").alias("raws"), of("direct").alias("directs"))
    rate = F.when(F.col("raws") + F.col("functions") > 0, F.col("raws") / (F.col("raws") + F.col("functions")))
    out = out.withColumn("raw_rate", rate).where("total is not null")
    return out.select("dataset", "total", "functions", "raws", "directs", "raw_rate", F.when(F.col("all") == 1, F.col("raw_rate") < gate).alias("passes"))
