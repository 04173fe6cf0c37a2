"""Which columns of which datasets share values: normalized keys, overlaps, clusters and their scores."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.values import NUMBER, is_null_token, text
from linkspark.operators.crosswalk import element_canonical, normalize

#: From the most conservative to the loosest reading of a value.
LADDER = {
    "identity": lambda c: F.trim(text(c)),
    "nfkc": lambda c: normalize(c, "nfkc,strip"),
    "loose_text": lambda c: normalize(c, "nfkc,casefold,collapse_ws"),
    "element_canonical": element_canonical,
}
# Datatypes that are trusted before any pattern.
NUMERIC = ("xsd:integer", "xsd:double", "xsd:decimal", "xsd:float")
TEMPORAL = ("xsd:date", "xsd:dateTime", "xsd:gYear")


def ladder(values: DataFrame, rungs: tuple[str, ...] = tuple(LADDER)) -> DataFrame:
    """(rung, dataset, predicate, key, raw, n) of values (dataset, predicate, value): every value under every rung, with its
    smallest spelling and how often it stands. Null, empty and no-value keys are dropped. One shuffle, after map-side sums."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rung"), LADDER[r](F.col("value")).alias("key")) for r in rungs]))
    rows = values.where(~is_null_token(F.col("value"))).select("dataset", "predicate", "value", each.alias("e")).select("dataset", "predicate", "value", "e.*")
    return rows.where(~is_null_token(F.col("key"))).groupBy("rung", "dataset", "predicate", "key").agg(F.min("value").alias("raw"), F.count(F.lit(1)).alias("n"))


def classify(values: DataFrame, longest: int = 120, drop_share: float = 0.5, share: float = 0.95) -> DataFrame:
    """(dataset, predicate, excluded): why a slot cannot carry a join, or null; the first that holds of free_text, empty,
    constant, numeric, temporal, boolean by datatype, numeric and temporal by pattern. values may have a column dt."""
    v = F.trim(text(F.col("value")))
    full, long = ~is_null_token(v), F.length(v) > longest
    kept = full & ~long
    dt = F.col("dt") if "dt" in values.columns else F.lit("")
    all_of = lambda kinds: F.coalesce(F.bool_and(F.when(kept, dt.isin(*kinds))), F.lit(False))
    like = lambda pattern: F.count_if(kept & v.rlike(pattern)) >= share * F.count_if(kept)
    date = r"^\d{4}-\d\d(-\d\d([T ].*)?)?$"
    total, n_long = F.count_if(full), F.count_if(full & long)
    # two values or one: the least and the largest tell, no set of values is made
    why = F.when((total > 0) & (n_long >= drop_share * total), "free_text").when(F.count_if(kept) == 0, "empty").when(F.min(F.when(kept, v)) == F.max(F.when(kept, v)), "constant")
    why = why.when(all_of(NUMERIC), "numeric").when(all_of(TEMPORAL), "temporal").when(all_of(("xsd:boolean",)), "boolean").when(like(NUMBER), "numeric").when(like(date), "temporal")
    return values.groupBy("dataset", "predicate").agg(why.alias("excluded"))


def patterns(keys: DataFrame) -> DataFrame:
    """(rung, slots, n): for each set of slots (dataset and predicate) the number of keys that just these slots share. Keys
    are added up to sets of slots, of which there are few."""
    sets = keys.groupBy("rung", "key").agg(F.array_sort(F.collect_set(F.struct("dataset", "predicate"))).alias("slots"))
    return sets.groupBy("rung", "slots").agg(F.count(F.lit(1)).alias("n"))


def clusters(held: dict[str, dict[frozenset, int]], rungs: tuple[str, ...], least: int) -> dict[tuple, str]:
    """Groups of slots, one for each dataset, that share keys, with the rung that matches most (of equal ones the most
    conservative). held: for each rung the number of keys of each set of slots.

    On each rung the strongest pair opens a group; it takes the slot of a further dataset that shares most keys with any
    of its slots, as long as there are `least`; a slot is used once. Groups inside others are left out.
    """
    found: dict[tuple, None] = {}
    for rung in rungs:
        pairs: dict[tuple, int] = defaultdict(int)
        for slots, n in held.get(rung, {}).items():
            for a, b in combinations(sorted(slots), 2):
                if a[0] != b[0]:
                    pairs[a, b] += n
        used: set = set()
        for (a, b), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if n < least or a in used or b in used:
                continue
            group = [a, b]
            while True:
                gain: dict[tuple, int] = defaultdict(int)
                for slots, k in held[rung].items():
                    if slots & set(group):
                        for s in slots:
                            if s not in used and s[0] not in {g[0] for g in group}:
                                gain[s] += k
                best = min(((-k, s) for s, k in gain.items() if k >= least), default=None)
                if best is None:
                    break
                group.append(best[1])
            used |= set(group)
            found[tuple(sorted(group))] = None
    top = [g for g in found if not any(set(g) < set(o) for o in found)]
    return {g: max(rungs, key=lambda r: (matched(held.get(r, {}), g), -rungs.index(r))) for g in top}


def matched(held: dict[frozenset, int], group: tuple, slot: tuple | None = None) -> int:
    """Keys that two or more slots of a group share; with slot, those of them that this slot has."""
    return sum(n for slots, n in held.items() if len(slots & set(group)) > 1 and (slot is None or slot in slots))


def flags(held: dict[str, dict[frozenset, int]], group: tuple, rung: str, distinct: dict, statements: dict) -> list[str]:
    """Cautions about a group."""
    shared = matched(held[rung], group)
    reach = [matched(held[rung], group, s) / distinct[s] for s in group if distinct.get(s)]
    rules = {
        "single_value_overlap": shared == 1,
        "low_cardinality": min(distinct.get(s, 0) for s in group) < 8,
        "high_fanout": any(distinct.get(s) and statements[s] / distinct[s] > 1000 for s in group),
        "fold_only_match": rung != "identity" and matched(held.get("identity", {}), group) == 0,
        "asymmetric_coverage": bool(reach) and min(reach) < 0.01 and max(reach) > 0.5,
    }
    return [name for name, holds in rules.items() if holds]


def discover(values: DataFrame, least: int = 3, rungs: tuple[str, ...] = tuple(LADDER)) -> DataFrame:
    """(datasets, predicates, rung, matched, score, flags): groups of columns that can be joined, best score first.

    values: dataset, predicate, value. Slots that classify() excludes are left out. All keys are counted; the driver gets
    one number for each combination of slots, not keys, and groups those. score: log10(1 + matched) times the largest
    share of a slot's values that matches, times the number of further datasets.
    """
    spark = values.sparkSession
    open_ = classify(values).where("excluded is null").select("dataset", "predicate")
    keys = ladder(values.join(F.broadcast(open_), ["dataset", "predicate"], "left_semi"), rungs)  # a row for each slot
    held: dict[str, dict[frozenset, int]] = defaultdict(dict)
    for r in patterns(keys).collect():
        held[r["rung"]][frozenset((s["dataset"], s["predicate"]) for s in r["slots"])] = r["n"]
    sizes = keys.where(F.col("rung") == rungs[0]).groupBy("dataset", "predicate").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()
    distinct, statements = ({(r["dataset"], r["predicate"]): r[c] for r in sizes} for c in ("d", "n"))
    out = []
    for group, rung in clusters(held, rungs, least).items():
        n = matched(held[rung], group)
        reach = max((matched(held[rung], group, s) / distinct[s] for s in group if distinct.get(s)), default=0.0)
        out.append(([s[0] for s in group], [s[1] for s in group], rung, n, math.log10(1 + n) * reach * (len(group) - 1), flags(held, group, rung, distinct, statements)))
    out.sort(key=lambda r: (-r[4], r[0], r[1]))
    return spark.createDataFrame(out, "datasets array<string>, predicates array<string>, rung string, matched long, score double, flags array<string>")


def samples(keys: DataFrame, rung: str, n: int = 10) -> DataFrame:
    """(key, spellings, raw): shared keys of a rung as evidence, those with most different spellings first, then by key."""
    each = keys.where(F.col("rung") == rung).groupBy("key").agg(F.count_distinct("dataset").alias("k"), F.size(F.collect_set("raw")).alias("spellings"), F.array_sort(F.collect_set(F.concat_ws(": ", "dataset", "raw"))).alias("raw"))
    return each.where("k > 1").orderBy(F.desc("spellings"), "key").limit(n).select("key", "spellings", "raw")


def compound_key(parts: list[Column]) -> tuple[Column, Column]:
    """Key of several normalized parts joined by the unit separator, and how it is shown; null where a part has no value."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & ~is_null_token(p)
    return F.when(whole, F.concat_ws("\u001f", *parts)), F.when(whole, F.concat_ws(" | ", *parts))
