"""Chemical formulas: amounts, formulas of the host material to try, and the quads that tell how a sample was linked."""

from __future__ import annotations

from collections.abc import Callable
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from linkspark.functions.values import text
from linkspark.operators.mapping import ROWS

# An element with its amount; the atomic share below which an element is a dopant; elements that stand for
# one another; the names of the ways to a candidate.
PART = r"[A-Z][a-z]?(?:\d+\.\d+|\d+|\.\d+)?"
DILUTE = 0.06
QUADS = 12  # of a sample, about
GROUPS = ("O S Se Te Po", "N P As Sb Bi", "F Cl Br I", "Ti Zr Hf", "V Nb Ta", "Cr Mo W", "Li Na K Rb Cs", "Be Mg Ca Sr Ba")
WAYS = (("MaterialFamily(curator)", "high"), ("exact integer formula", "medium"), ("rounded stoichiometry", "low"), ("solid-solution collapsed", "low"))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total + p["amount"])


def parsed(c: Column) -> Column:
    """array<struct<element, amount>> of a formula, elements in order of first appearance, repeated ones added up. Null for
    null and for text that is none: empty, with a blank, a bracket or two small letters in a row, or read to less than
    nine tenths."""
    s = F.regexp_replace(text(c), r"^\s+|\s+$", "")
    found = F.regexp_extract_all(s, F.lit(PART), F.lit(0))
    symbol = lambda p: F.regexp_extract(p, "^[A-Z][a-z]?", 0)
    amount = lambda p: F.coalesce(F.regexp_replace(p, "^[A-Z][a-z]?", "").try_cast("double"), F.lit(1.0))
    each = F.transform(found, lambda p: F.struct(symbol(p).alias("element"), amount(p).alias("amount")))
    names = F.array_distinct(F.transform(found, symbol))
    sums = F.transform(names, lambda e: F.struct(e.alias("element"), _sum(F.filter(each, lambda p: p["element"] == e)).alias("amount")))
    plain = (s != "") & ~s.rlike(r"[ (]|[a-z]{2,}") & (F.size(names) > 0)
    return F.when(plain & (F.length(F.array_join(found, "")) >= 0.9 * F.length(s)), sums)


def _whole(parts: dict[str, float], exact: bool) -> str | None:
    """Formula of whole amounts without a common divisor, those that round to 0 left out; None if exact and an amount is
    off a whole number by over 0.02, or if nothing is left."""
    import math

    ints = {e: n for e, a in parts.items() if (n := round(a)) > 0}
    if not ints or (exact and any(abs(a - round(a)) > 0.02 for a in parts.values())):
        return None
    div = math.gcd(*ints.values())
    return "".join(e if n == div else f"{e}{n // div}" for e, n in ints.items())


def _amounts(s: str | None) -> dict[str, float]:
    """As parsed(), of one text inside a task; empty where that is null."""
    s = (s or "").strip()
    found = [] if re.search("[ (]|[a-z]{2,}", s) else re.findall(PART, s)
    out: dict[str, float] = {}
    for p in found if sum(map(len, found)) >= 0.9 * len(s) else []:
        e = re.match("[A-Z][a-z]?", p)[0]
        out[e] = out.get(e, 0.0) + float(p[len(e) :] or 1)
    return out


_MADE = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("formulas", T.StringType()), ("ways", T.IntegerType()), ("dopants", T.StringType()), ("rates", T.DoubleType()), ("substituents", T.StringType()))])


@pandas_udf(_MADE)
def _split(compositions: pd.Series, families: pd.Series) -> pd.DataFrame:
    """Of each composition: the formulas of its host with the way (1 to 4) that gave each first, its dopants with their amounts,
    and the elements that lose to one of their group. Without amounts only the family can be a candidate."""
    group = {e: g for g in GROUPS for e in g.split()}

    def one(composition, family):
        parts, label = _amounts(composition), family.strip() if _amounts(family) else None
        share = sum(parts.values()) or 1.0
        main = {e: a for e, a in parts.items() if a / share >= DILUTE} or parts
        kin: dict[str, list[str]] = {}
        for e in sorted(main, key=lambda e: -main[e]):
            kin.setdefault(group.get(e, e), []).append(e)
        losers = {e for same in kin.values() for e in same[1:]}
        merged = {e: sum(main[o] for o in kin[group.get(e, e)]) for e in main if e not in losers}
        tried = [label, _whole(main, True), _whole(main, False), _whole(merged, False) if losers else None]
        first = {f: way for way, f in reversed(list(enumerate(tried, 1))) if f}
        order = sorted(first, key=first.get)
        rare = [e for e in parts if e not in main]
        return order, [first[f] for f in order], rare, [float(parts[e]) for e in rare], [e for e in main if e in losers]

    return pd.DataFrame([one(*row) for row in zip(compositions, families)], columns=_MADE.names)


def hosts(df: DataFrame, composition: str, family: str) -> DataFrame:
    """df and candidates array<struct<formula, method, confidence>> in the order to try, dopants array<struct<element,
    amount>> and substituents array<string>. Elements under DILUTE of the atoms are dopants, unless all are. candidates is
    null where neither text is a formula; the arrays of others are empty then. Columns of df by these names are replaced."""
    made = F.col("__made")
    once = _split.asNondeterministic()  # so Spark neither repeats it nor moves it into a filter below a later explode
    out = df.withColumn("__made", once(F.col(f"`{composition}`").cast("string"), F.col(f"`{family}`").cast("string")))
    ways, sure = (F.array(*[F.lit(w[i]) for w in WAYS]) for i in (0, 1))
    tried = F.zip_with(made["formulas"], made["ways"], lambda f, w: F.struct(f.alias("formula"), F.element_at(ways, w).alias("method"), F.element_at(sure, w).alias("confidence")))
    out = out.withColumn("candidates", F.when(F.size(made["formulas"]) > 0, tried))
    out = out.withColumn("dopants", F.zip_with(made["dopants"], made["rates"], lambda e, a: F.struct(e.alias("element"), a.alias("amount"))))
    return out.withColumn("substituents", made["substituents"]).drop("__made")


def link_quads(matched: DataFrame, base: str, at: str) -> DataFrame:
    """(s, p, o, kind, dt), a set. matched: sample (an IRI), key, formula (null: no host was found), method, confidence,
    dopants, substituents, reference_id. Each sample has its match activity, found or not; a structure is one node for
    all samples of its formula; a dopant is a defect of its sample. Rows without a sample or key give nothing. What is
    said of a structure alone is made once for each; the rest is dealt into as many parts as it has rows for, which are
    counted first."""
    act, node, there = F.concat(F.lit(f"{base}activity/"), "key"), F.concat(F.lit(f"{base}structure/"), "formula"), F.col("formula").isNotNull()

    def quad(s: Column, p: str, o: Column, kind: str = "literal", dt: str = "", where: Column | None = None) -> Column:
        made = F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind"), F.lit(dt).alias("dt"))
        return made if where is None else F.when(where, made)

    always = F.array(
        quad(act, "rdf:type", F.lit("sd:StructureMatchActivity"), "iri"),
        quad(act, "prov:used", F.col("sample"), "iri"),
        quad(act, "sd:matchMethod", F.when(there, F.col("method")).otherwise("no host resolvable")),
        quad(act, "sd:matchConfidence", F.when(there, F.col("confidence")).otherwise("unresolved")),
        quad(act, "prov:endedAtTime", F.lit(at), "literal", "xsd:dateTime"),
        quad(F.col("sample"), "sd:hasHostStructure", node, "iri", "", there),
        quad(node, "prov:wasGeneratedBy", act, "iri", "", there),
    )
    shared = F.array(
        quad(node, "rdf:type", F.lit("sd:CrystalStructure"), "iri"),
        quad(node, "sd:reducedHostFormula", F.col("formula")),
        quad(node, "sd:idealizedFrom", F.col("reference_id"), "iri", "", F.col("reference_id").isNotNull()),
    )
    mixed = F.transform("substituents", lambda e: quad(node, "sd:solidSolutionElement", e, "literal", "", there))
    defect = lambda d: F.concat(F.lit(f"{base}defect/"), "key", F.lit("/"), d["element"])
    defects = F.flatten(F.transform("dopants", lambda d: F.array(
        quad(F.col("sample"), "sd:hasPointDefect", defect(d), "iri", "", there),
        quad(defect(d), "sd:dopantElement", d["element"], "literal", "", there),
        quad(defect(d), "sd:siteAmount", d["amount"], "literal", "xsd:double", there),
    )))
    empty = F.array().cast("array<struct<s:string,p:string,o:string,kind:string,dt:string>>")
    rows = matched.where(F.col("sample").isNotNull() & F.col("key").isNotNull())
    of = lambda d, *each: d.select(F.explode_outer(F.concat(*each)).alias("q")).where("q is not null").select("q.*")
    structures = rows.where(there).select("formula", "reference_id", "substituents").distinct()
    own = of(rows, always, F.coalesce(defects, empty))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * QUADS // ROWS))
    return own.repartition(parts, *own.columns).dropDuplicates().unionByName(of(structures, shared, F.coalesce(mixed, empty)).distinct())


def _pairs(q: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return q.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _about(q: DataFrame, names: dict[str, str]) -> DataFrame:
    """s and a column for each predicate, of one pass: its least object, null where s has none."""
    asked = q.where(F.col("p").isin(*names))
    return asked.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in names.items()])


def bridge(q: DataFrame) -> DataFrame:
    """(sample, structure, method, confidence, at, reference, dopants): how each link of link_quads() was made. Legs that
    are missing are null; dopants, "element amount" in order, is empty then. Only the predicates asked for are read."""
    links = _pairs(q, "sd:hasHostStructure", "sample", "structure")
    acts = _about(q, {"prov:used": "sample", "sd:matchMethod": "method", "sd:matchConfidence": "confidence", "prov:endedAtTime": "at"}).where("sample is not null")
    parts = _about(q, {"sd:dopantElement": "element", "sd:siteAmount": "amount"}).where("element is not null and amount is not null")
    defects = _pairs(q, "sd:hasPointDefect", "sample", "s").join(parts, "s")
    defects = defects.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "element", "amount"))), ",").alias("dopants"))
    out = links.join(acts.drop("s"), "sample", "left").join(_pairs(q, "sd:idealizedFrom", "structure", "reference"), "structure", "left").join(defects, "sample", "left")
    return out.select("sample", "structure", "method", "confidence", "at", "reference", F.coalesce("dopants", F.lit("")).alias("dopants"))


def fusion(q: DataFrame | Callable[[str], DataFrame], composition: str | None = None, parts: int | None = None) -> DataFrame:
    """(curve, composition, property, value, figure, label, caption, sentence, condition, paper, title): each measured
    curve with its figure and the sentence that states how it was measured. property, value, caption and title may be
    null; curves without the other parts are left out. composition: only curves of this one.

    q: quads, or a function that gives those of one predicate, so that quads that are made anew are made for the predicates
    asked for alone. What is said of a curve meets first, then what is said of samples, figures and sentences; curves move
    for their sample and figure alone. parts: into how many they are dealt for their sample (as the session says unless
    given)."""
    pairs = lambda p, s, o: _pairs(q(p) if callable(q) else q, p, s, o)
    made = pairs("sd:compositionString", "sample", "composition")
    if composition is not None:
        made = made.where(F.col("composition") == composition)
    curves = pairs("rdf:type", "curve", "class").where("class = 'sd:Curve'").select("curve")
    curves = curves.join(pairs("sd:ofSample", "curve", "sample"), "curve").join(pairs("prov:wasDerivedFrom", "curve", "figure"), "curve")
    curves = curves.join(pairs("sd:propertyY", "curve", "property"), "curve", "left").join(pairs("sd:yMax", "curve", "value"), "curve", "left")
    captions = pairs("po:contains", "figure", "c").join(pairs("nif:isString", "c", "caption"), "c").drop("c")
    figures = pairs("rdfs:label", "figure", "label").join(captions, "figure", "left")
    stated = pairs("nif:anchorOf", "sentence", "condition").join(pairs("prov:wasQuotedFrom", "sentence", "paper"), "sentence")
    stated = stated.join(pairs("dcterms:title", "paper", "title"), "paper", "left")
    samples = made.join(pairs("lit:conditionStatedIn", "sample", "sentence"), "sample").join(stated, "sentence")
    if parts is not None:
        curves, samples = curves.repartition(parts, "sample"), samples.repartition(parts, "sample")
    out = curves.join(samples, "sample").join(figures, "figure")
    return out.select("curve", "composition", "property", F.col("value").try_cast("double").alias("value"), "figure", "label", "caption", "sentence", "condition", "paper", "title")
