"""URL filters: rules by host and path, and empirical-Bayes host reputation where no rule fits. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import save

#: Rules of the query's contract: verdict and host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A country's suffix has two labels where the second is one of these (co.uk, com.br); every other suffix is the last label.
SECOND = ("ac", "co", "com", "ed", "edu", "gob", "go", "gov", "gouv", "govt", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or holds no '://'."""
    host, path = (F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and that host's subdomains
    where the path starts with the rule's; of rules of one length the one with the longer host, then the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    fits = []
    for verdict, rule in ordered:
        name, slash, rest = rule.partition("/")
        on = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(on, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Public suffix, and registered domain (the suffix and one label more) of a host. suffixes: more suffixes of two
    labels. User names and ports are left aside; all numeric addresses have one suffix and are domains of their own."""
    plain = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    address = plain.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[")
    last, two = F.substring_index(plain, ".", -1), F.substring_index(plain, ".", -2)
    long = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND) & two.contains(".")
    long = long | two.isin(*suffixes) if suffixes else long
    suffix = F.when(long, two).otherwise(last)
    domain = F.when(long, F.substring_index(plain, ".", -3)).otherwise(two)
    return F.when(address, "[address]").otherwise(suffix), F.when(address, plain).otherwise(domain)


def _strength(groups: DataFrame, parent: str, least: float = 2.0, most: float = 1000.0) -> Column:
    """Pseudo-count of a beta prior by the method of moments, over all groups with two or more outcomes: how far their
    rates spread around their parents' rates beyond what chance gives. One row comes of it."""
    rate = F.col("bad") / F.col("n")
    some = groups.where("n >= 2")
    spread = F.sum(F.col("n") * F.pow(rate - F.col(parent), 2))
    chance = F.sum(F.col(parent) * (1 - F.col(parent)))
    top = F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent)))
    rows = some.agg(spread.alias("spread"), chance.alias("chance"), top.alias("top"), F.count(F.lit(1)).alias("k")).first()
    if not rows["k"] or rows["top"] <= rows["chance"]:
        return F.lit(most)
    between = (rows["spread"] - rows["chance"]) / (rows["top"] - rows["chance"])  # share of the variance between groups
    return F.lit(most if between <= 0 else min(max(1 / between - 1, least), most))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each host of pages (host): n and bad (its labelled outcomes), mean and sd of the beta posterior of
    its share of bad pages.

    pages has page_id and host, outcomes page_id and bad (0 or 1; null rows are left out, repeated ids count each). The
    suffix's rate is shrunk towards the rate of all outcomes, the registered domain's towards its suffix, the host's
    towards its domain. Counts are added up by host first, so a host with a third of all pages is one row after map-side
    sums and written once. The beta posterior's tail is taken as normal (mean and sd). Without any outcome all rates are 1/2.
    """
    known = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts, _ = save(hosts.withColumns({"suffix": suffix, "domain": domain}))  # the four sums below read this table, not the pages
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.5
    up = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(overall))
    s = _strength(up, "prior")
    up = up.select("suffix", ((F.col("bad") + s * overall) / (F.col("n") + s)).alias("suffix_rate"))
    middle = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(up, "suffix")
    s = _strength(middle, "suffix_rate")
    middle = middle.select("domain", "suffix", ((F.col("bad") + s * F.col("suffix_rate")) / (F.col("n") + s)).alias("domain_rate"))
    hosts = hosts.join(middle, ["suffix", "domain"])
    s = _strength(hosts, "domain_rate")
    a, b = F.col("bad") + s * F.col("domain_rate"), F.col("n") - F.col("bad") + s * (1 - F.col("domain_rate"))
    return hosts.select("host", "n", "bad", (a / (a + b)).alias("mean"), F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1))).alias("sd"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: float = 0.3, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, mean and bound.

    A fitting rule decides. Else a page is blocked where the lower bound (mean - z * sd) of its host's share of bad
    pages is over `most`: hosts of which little is known are allowed. Null urls and urls without '://' have an empty
    host and path, share one reputation and fit no rule. Repeated page ids give repeated rows.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(seen.select("page_id", "host"), outcomes, suffixes)
    bound = F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd"))
    known = known.select("host", "mean", bound.alias("bound"))
    out = seen.join(known, "host").withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("bound") > most, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "mean", "bound")


def op10_url_filter(spark, sf_dir):
    """Every page judged. A page's outcome is the label of the document with its number: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
