"""Labels matched against the terms of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.values import text
from linkspark.operators.graph import cut

#: Grams by which a text is found inside another: the first one of the inner text is among those of the outer.
GRAM = 3
#: First words that a label may leave out of a property (fixed values).
LEADS = ("has", "is", "was")
#: What a query asks for, and the vocabulary terms that it is held to.
SCOPE = ["asked_kind", "asked_domain"]
QUERY = ["label", *SCOPE]


def plain(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{Nd}]+", "")


def _parts(c: Column) -> Column:
    """Lower-case words in their order; camelCase, the end of an acronym and other signs part them."""
    parted = F.regexp_replace(text(c), r"(?<=\p{Ll}|\p{Nd})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(parted), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def words(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(_parts(c))


def _grams(c: Column) -> Column:
    """All grams of 1 to GRAM characters."""

    def of(k: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)))
        return F.when(F.length(c) >= k, F.transform(at, lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array())

    each = [of(k) for k in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*each))


def _judged(pairs: DataFrame) -> DataFrame:
    """Score and kind of match of pairs of a label (p plain, w words) and a term (np, lp, cp: name, label and name without
    its lead, plain; y words)."""
    p, w, y = F.col("p"), F.col("w"), F.col("y")
    common = F.size(F.array_intersect(w, y))
    inside = (common == F.size(w)) & (F.size(w) > 0)
    tight = F.greatest(F.lit(0), F.lit(10) - (F.size(y) - F.size(w)))
    ways = [
        ("exact", p.isin(F.col("np"), F.col("lp"), F.col("cp")), F.lit(100)),
        ("exact_tokens", inside & (F.size(w) == F.size(y)), F.lit(90)),
        ("tokens_subset", inside, 70 + tight),
        ("substring", F.col("np").contains(p) | p.contains(F.col("np")) | F.col("lp").contains(p), F.lit(50)),
        ("overlap", common > 0, 20 + common),
    ]
    score, match = F.lit(0), F.lit("")
    for name, holds, points in reversed(ways):
        score, match = F.when(holds, points).otherwise(score), F.when(holds, F.lit(name)).otherwise(match)
    return pairs.select(*QUERY, "t", score.cast("int").alias("score"), match.alias("match")).where("score > 0").distinct()


def _first(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; a group is cut to n rows before it is shuffled."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def _rarest(inner: DataFrame, x: str, outer: DataFrame) -> DataFrame:
    """inner and `gram`: of the grams of the text x the one that stands in the fewest rows of outer (scope and gram); a
    text of GRAM characters or fewer is its own gram. Texts with a gram that outer does not have are left out."""
    short = inner.where(F.length(x) <= GRAM).withColumn("gram", F.col(x))
    whole = inner.where(F.length(x) > GRAM)
    rows = outer.groupBy(*SCOPE, "gram").agg(F.count(F.lit(1)).alias("rows"))
    each = whole.select(*SCOPE, x).distinct().withColumn("gram", F.explode(F.filter(_grams(F.col(x)), lambda g: F.length(g) == GRAM)))
    least = _met(each, rows, [*SCOPE, "gram"], "left").groupBy(*SCOPE, x).agg(F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram")).alias("gram"), F.count_if(F.col("rows").isNull()).alias("gone"))
    return short.unionByName(_met(whole, least.where("gone = 0").drop("gone"), [*SCOPE, x]))


def _met(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined with b by a shuffle. Words and groups of letters make many rows of few, which Spark's sizes do not tell: it
    would send such a side whole to the driver and to every task."""
    return a.join(b.hint("merge"), on, how)


def _text_columns(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [(F.coalesce(text(F.col(c)), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in names]


def candidates(queries: DataFrame, terms: DataFrame, n: int = 8) -> DataFrame:
    """(label, asked_kind, asked_domain, prefix, name, kind, domain, score, match, place): the n best terms of a vocabulary
    for each distinct query, best first.

    queries: label, and if wanted kind and domain to which the terms are held (null, empty or no such column: any).
    terms: name, and if known prefix, kind, label, domain. A property is also known without its lead (`has`, `is`, `was`).
    100: the same letters and digits as the name, the label or the name without its lead; 90: the same words as name and
    label have together; 70 to 80: all words of the query among them, fewer others first; 50: the query inside name or
    label, or the name inside the query; 20 and the number of common words. Equal scores: the shorter name, then prefix,
    name, kind, label, domain. Queries and names without letters or digits match nothing; repeated rows count once.

    A term is met only if it can still enter the n best:
    1. Of the terms that a query shares but one word with, or that have its spelling, only the first n of that word or
       spelling can enter, and these do not depend on the query: lists of n are joined.
    2. Terms that hold all words of a query hold its rarest one: one posting list a query.
    3. The n-th score of these is the bound. To reach it by common words alone, a term needs c of them, so it has one of
       the k - c + 1 rarest of k; the most common word of a query is never joined by.
    4. Texts inside of each other are looked for only where the bound is 50 or less, by the rarest group of GRAM letters
       of the inner text; texts of GRAM letters or fewer by lists of n.

    Queries, terms and what steps 1 and 2 hold are checkpoints, for the later steps ask them several times.
    """
    q = queries.select(*_text_columns(queries, ("label", "kind", "domain"))).distinct()
    q = q.select("label", F.col("kind").alias("asked_kind"), F.col("domain").alias("asked_domain"), plain(F.col("label")).alias("p"), words(F.col("label")).alias("w")).where("p <> ''")
    q = cut(q)
    t = terms.select(*_text_columns(terms, ("prefix", "name", "kind", "label", "domain"))).distinct()
    parts = _parts(F.col("name"))
    led = (F.col("kind") == "property") & F.coalesce(F.get(parts, F.lit(0)).isin(*LEADS), F.lit(False))
    core = F.when(led, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "")).otherwise(plain(F.col("name")))
    own = F.struct(F.length("name").alias("length"), "prefix", "name", "kind", "label", "domain")
    t = t.select(own.alias("t"), plain(F.col("name")).alias("np"), plain(F.col("label")).alias("lp"), core.alias("cp"), F.array_union(words(F.col("name")), words(F.col("label"))).alias("y")).where("np <> ''")
    any_of = lambda c: F.array_distinct(F.array(F.col(c), F.lit("")))
    t = cut(t).withColumn("asked_kind", F.explode(any_of("t.kind"))).withColumn("asked_domain", F.explode(any_of("t.domain"))).join(q.select(*SCOPE).distinct(), SCOPE, "left_semi")
    both = ["p", "w", "t", "np", "lp", "cp", "y"]
    pairs = lambda df: df.select(*QUERY, *both)

    # 1: lists of n by word and by spelling
    posting = t.withColumn("word", F.explode("y"))
    listed = [*SCOPE, "word"]
    few = _first(posting, listed, n, F.col("t")).unionByName(_first(posting, listed, n, F.least(F.size("y"), F.lit(11)), F.col("t"))).drop("place").distinct()
    asked = q.withColumn("word", F.explode("w"))
    spelt = t.withColumn("p", F.explode(F.array_distinct(F.array("np", "lp", "cp"))))
    spelt = _first(spelt, [*SCOPE, "p"], n, F.col("t")).drop("place")
    met = pairs(_met(asked, few, listed)).unionByName(pairs(_met(q, spelt, [*SCOPE, "p"])))

    # 2: the rarest word
    frequency = posting.groupBy(*listed).agg(F.count(F.lit(1)).alias("rows"))
    ranked = _met(asked, frequency, listed).groupBy(*QUERY, "p", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("rows", "word"))), lambda r: r["word"]).alias("known")).where(F.size("known") >= 2)
    met = met.unionByName(pairs(_met(ranked.withColumn("word", F.col("known")[0]), posting, listed)))
    scored = _judged(met)
    best = [F.desc("score"), F.col("t")]
    held = cut(_first(scored, QUERY, n, *best))
    bound = held.groupBy(*QUERY).agg(F.when(F.count(F.lit(1)) == n, F.min("score")).otherwise(0).alias("bound"))

    # 3: common words that can still reach the bound
    need = F.greatest(F.lit(2), F.col("bound") - 20)
    more = _met(ranked, bound, QUERY).withColumn("left", F.size("known") - need).where("left > 0")
    wider = pairs(_met(more.withColumn("word", F.explode(F.slice("known", F.lit(2), F.col("left")))), posting, listed))

    # 4: texts inside of each other
    open_ = _met(q, bound.where("bound > 50"), QUERY, "left_anti")
    key = [*SCOPE, "gram"]
    of_terms = t.withColumn("gram", F.explode(F.array_union(_grams(F.col("np")), _grams(F.col("lp")))))
    brief = _first(of_terms.where(F.length("gram") <= GRAM), key, n, F.col("t")).drop("place")
    inner = _rarest(open_, "p", of_terms)
    tiny, larger = F.length("p") <= GRAM, F.length("p") > GRAM
    within = pairs(_met(inner.where(tiny), brief, key)).unionByName(pairs(_met(inner.where(larger), of_terms, key)))
    of_queries = open_.withColumn("gram", F.explode(_grams(F.col("p"))))
    names = _rarest(_first(t, [*SCOPE, "np"], n, F.col("t")).drop("place"), "np", of_queries)
    around = pairs(_met(of_queries, names, key))

    rest = _judged(wider.unionByName(within).unionByName(around))
    out = _first(held.drop("place").unionByName(rest).distinct(), QUERY, n, *best)
    return out.select(*QUERY, "t.prefix", "t.name", "t.kind", "t.domain", "score", "match", "place")


def ground(labels: DataFrame, terms: DataFrame, n: int = 8) -> DataFrame:
    """(label, name, score, place): for each distinct label its `n` best terms, as candidates() finds them by name alone.
    labels: label; terms: name. Labels and terms without letters or digits match nothing."""
    return candidates(labels.select("label"), terms.select("name"), n).select("label", "name", "score", "place")


def term_iri(df: DataFrame, column: str, terms: DataFrame, fold: bool = False) -> DataFrame:
    """df and `iri`, that of the term named in the column; null for null and unknown names. terms: name, iri; of a name
    that comes twice the least IRI. fold: case does not count, for quantities; it counts for units (m is not M)."""
    key = (lambda c: F.lower(F.trim(c))) if fold else F.trim
    known = terms.groupBy(key(F.col("name")).alias("__key")).agg(F.min("iri").alias("iri"))
    return df.drop("iri").withColumn("__key", key(F.col(f"`{column}`"))).join(known, "__key", "left").drop("__key")


def _within(a: DataFrame, x: str, b: DataFrame, y: str, keep: tuple[str, ...]) -> DataFrame:
    """Pairs of rows of which the text x of a may stand inside the text y of b."""
    inner = a.where(F.col(x) != "").withColumn("__by", F.substring(x, 1, GRAM))
    outer = b.where(F.col(y) != "").withColumn("__by", F.explode(_grams(F.col(y))))
    return _met(inner, outer, ["__by"]).select(*keep)


def units(queries: DataFrame, catalog: DataFrame, spellings: DataFrame, n: int = 6) -> DataFrame:
    """(query, name, matched_on, place, resolved): units for each distinct text, best first.

    catalog: name, label, symbol, ucum array<string>, si boolean; spellings: spelling, name. The first of these that hits
    counts alone: a spelling, a spelling in any case, a symbol, a code, a name, a label in any case. Of several hits the
    only SI unit comes first and resolves the text, as a single hit does. Texts without a hit get up to n suggestions
    whose symbol or label holds the text, or whose label is in it. Empty and null texts give nothing."""
    q = queries.select(F.trim("query").alias("query")).where("query <> ''").distinct()
    si = catalog.select("name", F.coalesce("si", F.lit(False)).alias("si"))
    low = F.lower(F.trim("spelling"))
    keys = [
        spellings.groupBy(F.col("spelling").alias("key")).agg(F.min("name").alias("name")).select(F.lit(0).alias("rank"), F.lit("alias").alias("matched_on"), F.lit(False).alias("folded"), "key", "name"),
        spellings.groupBy(low.alias("key")).agg(F.min_by("name", "spelling").alias("name")).select(F.lit(1), F.lit("alias"), F.lit(True), "key", "name"),
        catalog.select(F.lit(2), F.lit("symbol"), F.lit(False), "symbol", "name"),
        catalog.select(F.lit(3), F.lit("ucum"), F.lit(False), F.explode("ucum"), "name"),
        catalog.select(F.lit(4), F.lit("name"), F.lit(False), "name", F.col("name").alias("n")),
        catalog.select(F.lit(5), F.lit("label"), F.lit(True), F.lower(F.trim("label")), "name"),
    ]
    table = keys[0]
    for k in keys[1:]:
        table = table.union(k)
    asked = q.select("query", F.explode(F.array(F.struct(F.lit(False).alias("folded"), F.col("query").alias("key")), F.struct(F.lit(True).alias("folded"), F.lower("query").alias("key")))).alias("k")).select("query", "k.*")
    hits = asked.join(table, ["folded", "key"]).join(si, "name").select("query", "name", "matched_on", "rank", "si").distinct()
    of = Window.partitionBy("query")
    hits = hits.withColumn("best", F.min("rank").over(of)).where("rank = best")
    hits = hits.withColumn("hits", F.count(F.lit(1)).over(of)).withColumn("sis", F.count_if("si").over(of))
    one = F.col("sis") == 1
    place = F.row_number().over(of.orderBy(F.when(one & F.col("si"), 0).otherwise(1), "name"))
    hits = hits.withColumn("place", place).select("query", "name", "matched_on", "place", ((F.col("hits") == 1) | one).alias("resolved"))
    rest = q.join(hits.select("query").distinct(), "query", "left_anti").withColumn("low", F.lower("query"))
    lower = catalog.select("name", F.lower(F.coalesce("label", F.lit(""))).alias("label"), F.lower(F.coalesce("symbol", F.lit(""))).alias("symbol"))
    keep = ("query", "low", "name", "label", "symbol")
    near = _within(rest, "low", lower, "label", keep).union(_within(rest, "low", lower, "symbol", keep)).union(_within(lower, "label", rest, "low", keep)).distinct()
    a, label, symbol = F.col("low"), F.col("label"), F.col("symbol")
    rank = F.when(symbol == a, 0).when(label.startswith(a) | symbol.startswith(a), 1).when(label.contains(a) | symbol.contains(a), 2).when((label != "") & a.contains(label), 3)
    near = near.withColumn("rank", rank).where("rank is not null")
    near = near.withColumn("place", F.row_number().over(of.orderBy("rank", F.length("name"), "name"))).where(F.col("place") <= n)
    return hits.union(near.select("query", "name", F.lit("suggestion").alias("matched_on"), "place", F.lit(False).alias("resolved")))


def quantity_kinds(queries: DataFrame, kinds: DataFrame, n: int = 8) -> DataFrame:
    """(query, unit, name, score, unit_fits, place): quantities for each distinct column name with its unit, best first.

    queries: query, unit (the name of a resolved unit, null: none known); kinds: name, label, units array<string>. Scores are
    those of ground(), for names of 4 letters or more; shorter ones match as a whole only. A unit that fits adds 15, alone it
    is 25; quantities that it does not fit are left out unless their name is the same. A single answer of 100 or more stands
    alone. Of equal scores those that fit come first, then the shorter name, then the name."""
    text_of = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    q = queries.select(text_of("query").alias("query"), text_of("unit").alias("unit")).distinct().where("query <> '' or unit <> ''")
    q = q.select("query", "unit", plain(F.col("query")).alias("q"), words(F.col("query")).alias("q_words"))
    k = kinds.select("name", plain(F.col("name")).alias("k"), plain(F.col("label")).alias("l"), F.array_union(words(F.col("name")), words(F.col("label"))).alias("k_words"), F.coalesce("units", F.array().cast("array<string>")).alias("units"))
    keep = ("query", "unit", "name")
    met = q.select("query", "unit", F.explode("q_words").alias("w"))
    met = _met(met, k.select("name", F.explode("k_words").alias("w")), ["w"]).select(*keep)
    met = met.union(_within(q, "q", k, "k", keep)).union(_within(k, "k", q, "q", keep)).union(_within(q, "q", k, "l", keep))
    met = met.union(_met(q.where("unit <> ''"), k.select("name", F.explode("units").alias("unit")), ["unit"]).select(*keep)).distinct()
    both = met.join(q, ["query", "unit"]).join(k, "name")
    a, b, c, x, y = (F.col(i) for i in ("q", "k", "l", "q_words", "k_words"))
    common = F.size(F.array_intersect(x, y))
    inside = (common == F.size(x)) & (F.size(x) > 0)
    name = F.when((a != "") & ((a == b) | (a == c)), 100).when(F.length(a) < 4, 0).when(inside & (F.size(x) == F.size(y)), 90).when(inside, 70 + F.greatest(F.lit(0), 10 - (F.size(y) - F.size(x)))).when(b.contains(a) | a.contains(b) | c.contains(a), 50).when(common > 0, 20 + common).otherwise(0)
    fits = (F.col("unit") != "") & F.array_contains("units", F.col("unit"))
    both = both.withColumn("s", name).withColumn("unit_fits", fits)
    score = F.when((F.col("s") < 30) & F.col("unit_fits"), 25).when(F.col("s") < 30, None).when((F.col("unit") != "") & ~F.col("unit_fits") & (F.col("s") < 100), None).otherwise(F.col("s") + F.when(F.col("unit_fits"), 15).otherwise(0))
    of = Window.partitionBy("query", "unit")
    out = both.withColumn("score", score).where("score is not null").withColumn("sure", F.count_if(F.col("score") >= 100).over(of)).where("sure <> 1 or score >= 100")
    place = F.row_number().over(of.orderBy(F.desc("score"), F.desc("unit_fits"), F.length("name"), "name"))
    return out.select("query", "unit", "name", "score", "unit_fits", place.alias("place")).where(F.col("place") <= n)


def schema_terms(minted: DataFrame, terms: DataFrame, known: tuple[str, ...], n: int = 3, least: int = 40) -> DataFrame:
    """(kind, term, name, score, place): up to n terms of a vocabulary, of `least` score or more, for each minted class or
    property. minted: kind, term (prefix:local, or local); terms: name, kind. Terms under a known prefix are in use already
    and left out, as are terms without candidates, empty and null ones."""
    local = F.regexp_replace("term", "^[^:]*:", "")
    new = minted.where(~F.when(F.col("term").contains(":"), F.substring_index("term", ":", 1)).otherwise("").isin(*known)).select("kind", "term", local.alias("label")).where("label <> ''").distinct()
    out = candidates(new.where(F.col("kind").isin("class", "property")), terms.select("name", "kind"), n).select(F.col("asked_kind").alias("kind"), "label", "name", "score", "place")
    return new.join(out, ["kind", "label"]).where(F.col("score") >= least).select("kind", "term", "name", "score", "place")
