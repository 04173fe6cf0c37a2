"""Data-shape checks over quads and data-quality rules over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.values import is_number, text
from linkspark.operators.mapping import TYPE, Map
from linkspark.operators.profile import dependencies, numeric_datatypes


def dangling(q: DataFrame) -> DataFrame:
    """Links whose target is never a subject: (p, n, example). Links to one target are one row when it is looked for."""
    links = q.where((F.col("kind") == "iri") & (F.col("p") != TYPE)).groupBy("o", "p").agg(F.count(F.lit(1)).alias("n"))
    lost = links.join(q.select(F.col("s").alias("o")).distinct(), "o", "left_anti")
    return lost.groupBy("p").agg(F.sum("n").alias("n"), F.min("o").alias("example"))


def missing_predicate(q: DataFrame, declared: list[tuple[str, str]]) -> DataFrame:
    """Declared (class, predicate) that no instance carries although there are instances. Quads of declared predicates and
    types of declared classes are all that is read."""
    spark = q.sparkSession
    want = spark.createDataFrame(declared, "class string, p string")
    types = q.where((F.col("p") == TYPE) & F.col("o").isin(*{c for c, _ in declared})).select("s", F.col("o").alias("class"))
    have = q.where(F.col("p").isin(*{p for _, p in declared})).join(types, "s").select("class", "p").distinct()
    return want.join(types.select("class").distinct(), "class", "left_semi").join(have, ["class", "p"], "left_anti")


def wrong_class(q: DataFrame, predicate: str, expected: str) -> DataFrame:
    """Targets of a predicate that have classes, but not the expected one."""
    types = q.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("class"))
    got = q.where(F.col("p") == predicate).select("o").distinct().join(types, "o")
    return got.groupBy("o").agg(F.bool_or(F.col("class") == expected).alias("ok"), F.min("class").alias("class")).where("not ok").select("o", "class")


def wrong_datatype(q: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Literals whose datatype is not the declared one, by predicate."""
    want = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    rows = q.where("kind = 'literal'").withColumn("want", F.try_element_at(want, F.col("p"))).where("want is not null and want <> 'xsd:string' and dt <> want")
    return rows.groupBy("p", "dt").agg(F.count(F.lit(1)).alias("n"))


def audit(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(severity, rule, n) of each rule (severity, name, condition), all in one pass."""
    row = df.agg(*[F.count_if(c).alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    parts = [F.struct(F.lit(s).alias("severity"), F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, (s, name, _) in enumerate(rules)]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def audit_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_all(q: DataFrame, declared: list[tuple[str, str]], datatypes: dict[str, str]) -> DataFrame:
    """(check, subject, n) of all shape checks of one graph: missing predicates, dangling links and wrong datatypes. An
    advice, never an error; a clean graph gives no rows."""
    missing = missing_predicate(q, declared).select(F.lit("missing_predicate").alias("check"), F.concat_ws(" ", "class", "p").alias("subject"), F.lit(1).cast("long").alias("n"))
    lost = dangling(q).select(F.lit("dangling").alias("check"), F.col("p").alias("subject"), "n")
    wrong = wrong_datatype(q, datatypes).groupBy("p").agg(F.sum("n").alias("n")).select(F.lit("datatype").alias("check"), F.col("p").alias("subject"), "n")
    return audit_all(missing, lost, wrong)


def _read(m: Map) -> set[str]:
    """Columns that a map's properties read as values."""
    return {c for p in m.properties for c in ((p.column,) if p.column else p.columns)}


def _key(m: Map) -> tuple[str, ...]:
    import re

    return tuple(re.findall(r"\{([^{}]+)\}", m.subject))


def untyped_numeric(df: DataFrame, maps: dict[str, Map]) -> DataFrame:
    """(map, column, datatype): columns whose every filled cell is a number but that a map writes untyped."""
    plain = [(name, p.column) for name, m in maps.items() for p in m.properties if p.column and not p.datatype and not p.language and not p.iri]
    named = df.sparkSession.createDataFrame(plain, "map string, column string")
    return named.join(numeric_datatypes(df.select(*sorted({c for _, c in plain}))), "column").select("map", "column", "datatype")


def duplicate_columns(df: DataFrame, maps: dict[str, Map]) -> DataFrame:
    """(column, maps, owners): columns that several maps write, and those of the maps whose key determines the column."""
    rows = [(c, name, ",".join(_key(m))) for name, m in maps.items() for c in sorted(_read(m))]
    many = {c for c, _, _ in rows if sum(1 for r in rows if r[0] == c) > 1}
    out = df.sparkSession.createDataFrame([r for r in rows if r[0] in many], "column string, map string, key string")
    held = None
    for key in sorted({_key(m) for m in maps.values() if _read(m) & many}):
        part = dependencies(df, key).where("determined").select("column", F.lit(",".join(key)).alias("key"), F.lit(True).alias("holds"))
        held = part if held is None else held.unionByName(part)
    if held is None:
        return out.groupBy("column").agg(F.array_sort(F.collect_list("map")).alias("maps"), F.array_sort(F.collect_list("map")).alias("owners"))
    out = out.join(held, ["column", "key"], "left")
    return out.groupBy("column").agg(F.array_sort(F.collect_list("map")).alias("maps"), F.array_sort(F.collect_list(F.when(F.col("holds"), F.col("map")))).alias("owners"))


def empty_shell(df: DataFrame, maps: dict[str, Map]) -> DataFrame:
    """(map, column): maps with an entity for each row and no value column, and the columns that no map writes or that are
    written by a map whose key does not determine them: what such an entity could carry."""
    shells = [name for name, m in maps.items() if not _read(m)]
    written = set().union(*[_read(m) | set(_key(m)) for m in maps.values()])
    lost = [(c,) for c in df.columns if c not in written]
    spark = df.sparkSession
    free = spark.createDataFrame(lost, "column string")
    for m in maps.values():
        if _read(m):
            parked = dependencies(df, _key(m)).where(~F.col("determined") & F.col("column").isin(*sorted(_read(m)))).select("column")
            free = free.unionByName(parked)
    return spark.createDataFrame([(s,) for s in shells], "map string").crossJoin(free.distinct())  # names of maps and columns


def no_literal(maps: dict[str, Map]) -> list[str]:
    """Maps that read columns but write no literal; the whole design's line where none writes any."""
    silent = [name for name, m in maps.items() if m.properties and not any((p.column or p.function or p.constant) and not p.iri for p in m.properties)]
    return [*silent, *(["no map writes a literal"] if maps and len(silent) == len(maps) else [])]


def connectivity(maps: dict[str, Map]) -> list[list[str]]:
    """Entity kinds that links join, group by group: one group means that all are connected. A link is a property whose
    template is another map's subject up to the names of its columns."""
    import re

    shape = lambda t: re.sub(r"\{[^{}]+\}", "{}", t)
    home = {shape(m.subject): name for name, m in maps.items()}
    group = {name: {name} for name in maps}
    for name, m in maps.items():
        for p in m.properties:
            other = home.get(shape(p.template)) if p.template else None
            if other:
                joined = group[name] | group[other]
                for member in joined:
                    group[member] = joined
    return sorted({tuple(sorted(g)) for g in group.values()})


def untyped_compare(result: DataFrame, compared: list[str]) -> DataFrame:
    """(column, n): columns that a query orders, compares or takes extremes of, but that hold numbers as text."""
    found = [c for c in compared if dict(result.dtypes).get(c) == "string"]
    if not found:
        return result.sparkSession.createDataFrame([], "column string, n long")
    row = result.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(is_number(F.col(f"`{c}`"))).alias("n"), F.count_if(text(F.col(f"`{c}`")) != "").alias("filled")).alias(f"c{i}") for i, c in enumerate(found)])
    return row.select(F.explode(F.array(*row.columns)).alias("r")).select("r.*").where("n > 0 and n = filled").select("column", "n")


def ceiling(value: Column, most: float, band: float | None = None) -> list[tuple[str, str, Column]]:
    """Audit rules: impossible over the ceiling or below zero; with a band, suspicious between the two."""
    rules = [("impossible", "over_ceiling", (value > most) | (value < 0))]
    return rules + ([("suspicious", "questionable", (value > band) & (value <= most))] if band is not None else [])


def aggregate_order(low: Column, high: Column, count: Column) -> list[tuple[str, str, Column]]:
    """Audit rules: a minimum over its maximum, a count of none."""
    return [("impossible", "min_over_max", low > high), ("impossible", "count_not_positive", count <= 0)]


# The lowest temperature in degrees Celsius with its tolerance, and a size beyond any quantity.
ABSOLUTE_ZERO, ABSURD = -273.16, 1e25
NON_NEGATIVE = ("thermal conductivity", "electrical conductivity", "resistivity", "carrier concentration", "carrier density", "power factor")
SIGNED = ("log(", "ln(", "coefficient")


def domain_limits(name_x: Column, low_x: Column, name_y: Column, low_y: Column, high_y: Column) -> list[tuple[str, str, Column]]:
    """Audit rules: temperatures below absolute zero, absurd sizes, negative values of quantities that have none."""
    holds = lambda c, words: reduce(lambda a, b: a | b, [F.lower(text(c)).contains(w) for w in words])
    return [
        ("impossible", "below_absolute_zero", F.lower(text(name_x)).contains("temp") & (low_x < ABSOLUTE_ZERO)),
        ("impossible", "absurd_size", F.abs(high_y) > ABSURD),
        ("impossible", "negative", (low_y < 0) & holds(name_y, NON_NEGATIVE) & ~holds(name_y, SIGNED)),
    ]


def missing(**cells: Column) -> list[tuple[str, str, Column]]:
    """Audit rules: rows without a value."""
    return [("suspicious", f"missing_{name}", F.trim(text(c)) == "") for name, c in cells.items()]


def examples_have_rows(examples: dict[str, DataFrame]) -> DataFrame:
    """(name, has_rows): whether each example query gives a row. Each runs to its first row, all in one job. No
    examples are an error."""
    if not examples:
        raise ValueError("no examples")
    found = [df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), (F.col("n") > 0).alias("has_rows")) for name, df in examples.items()]
    return reduce(DataFrame.unionByName, found)
