"""Links between datasets through normalized shared values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from linkspark.functions.values import is_null_token, text, trim_collapse

SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")


@pandas_udf(T.StringType())
def _nfkc(values):
    import unicodedata

    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalize(c: Column, recipe: str) -> Column:
    """A key under a comma-separated recipe of casefold, strip, collapse_ws, nfkc, fold_subscripts and remove_ws."""
    steps = {
        "casefold": lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss")),
        "strip": F.trim,
        "collapse_ws": trim_collapse,
        "nfkc": _nfkc,
        "fold_subscripts": lambda x: F.translate(x, *SUBSCRIPTS),
        "remove_ws": lambda x: F.regexp_replace(x, r"(?U)\s+", ""),
    }
    out = text(c)
    for step in recipe.split(","):
        if step not in steps:
            raise ValueError(f"unknown step {step!r}")
        out = steps[step](out)
    return out


# Symbols of the chemical elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc "
    "Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi "
    "Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
_PART = rf"(?:{'|'.join(sorted(ELEMENTS, key=lambda e: -len(e)))})(?![a-z])\d*\.?\d*"


def composition(c: Column) -> Column:
    """Subscript digits as digits, no blanks; order and case stay."""
    return F.replace(F.translate(text(c), *SUBSCRIPTS), F.lit(" "))


def element_canonical(c: Column) -> Column:
    """A formula of element symbols and counts with its elements in order of symbol; other text as composition()."""
    plain = composition(c)
    parts = F.transform(F.regexp_extract_all(plain, F.lit(_PART), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, "^[A-Za-z]+", 0).alias("symbol"), p.alias("part")))
    ordered = F.array_sort(parts, lambda a, b: F.when(a["symbol"] < b["symbol"], -1).when(a["symbol"] > b["symbol"], 1).otherwise(0))
    return F.when(plain.rlike(rf"^(?:{_PART})+\z"), F.array_join(F.transform(ordered, lambda p: p["part"]), "")).otherwise(plain)


def shared_keys(values: DataFrame, least: int = 2, recipe: str = "casefold,collapse_ws") -> DataFrame:
    """(key, participants, entities) of keys that `least` participants report. values: participant, entity, value. Keys
    that are empty or mean no value are left out. One shuffle by key; a participant counts once however often it has it."""
    keyed = values.where(~is_null_token(F.col("value"))).withColumn("key", normalize(F.col("value"), recipe)).where(~is_null_token(F.col("key")))
    each = keyed.groupBy("key", "participant").agg(F.count_distinct("entity").alias("entities"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("participants"), F.sum("entities").alias("entities")).where(F.col("participants") >= least)


def hub(values: DataFrame, concept: str, least: int = 2, recipe: str = "casefold,collapse_ws") -> DataFrame:
    """Links (hub, participant, entity, raw): each entity to the hub entity of its key."""
    keys = shared_keys(values, least, recipe).select("key")
    keyed = values.withColumn("key", normalize(F.col("value"), recipe))
    links = keyed.join(keys, "key").select(F.concat(F.lit(f"hub/{concept}/"), F.col("key")).alias("hub"), "participant", "entity", F.col("value").alias("raw"))
    return links.distinct()


def pair_overlap(values: DataFrame, recipe: str = "casefold,collapse_ws") -> DataFrame:
    """Shared keys between each two participants, over the distinct keys: participants are few, keys are many."""
    keyed = values.where(~is_null_token(F.col("value"))).select("participant", normalize(F.col("value"), recipe).alias("key")).distinct()
    sets = keyed.groupBy("key").agg(F.array_sort(F.collect_set("participant")).alias("who")).where("size(who) > 1")
    ways = sets.groupBy("who").agg(F.count(F.lit(1)).alias("n"))  # a row for each combination, not for each key
    two = F.explode("who")
    rows = ways.select("who", "n", two.alias("a")).select("a", "n", F.explode("who").alias("b")).where("a < b")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def classify(values: DataFrame) -> DataFrame:
    """Why the values of a participant cannot serve as keys, or null: free_text, empty, constant, numeric."""
    v = F.trim(text(F.col("value")))
    full = ~is_null_token(v)
    out = values.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.count_if(full).alias("filled"), F.count_distinct(F.when(full, v)).alias("distinct"), F.count_if(full & (F.length(v) > 120)).alias("long"), F.count_if(full & v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias("numbers"))
    why = F.when(F.col("long") >= 0.5 * F.greatest("filled", F.lit(1)), "free_text").when(F.col("filled") == 0, "empty").when(F.col("distinct") == 1, "constant").when(F.col("numbers") >= 0.95 * F.col("filled"), "numeric")
    return out.select("participant", "filled", "distinct", why.alias("excluded"))


def link_counts(links: DataFrame) -> DataFrame:
    """(participant, links, hubs) of the links of hub(); participant null: all of them. Two steps, so no row is copied."""
    each = links.groupBy("hub", "participant").agg(F.count(F.lit(1)).alias("links"))
    own = each.groupBy("participant").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("hubs"))
    every = each.groupBy("hub").agg(F.sum("links").alias("links")).agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("hubs"))
    return own.unionByName(every.where("hubs > 0").select(F.lit(None).cast("string").alias("participant"), "links", "hubs"))
