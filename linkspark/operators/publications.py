"""Fixed maps: tables of papers, samples and digitized curves to quads, with the activities that made them.

Rows are texts as read from files; columns that a table lacks count as empty, further ones are ignored. Rows without the
parts of their key have no quads (`keyless` lists them). Each function gives a set of quads; null cells, cells that do not
parse and repeated rows are allowed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import values as V
from linkspark.operators.mapping import Map, Property, all_quads, keyed_set, quads, several

# Keys and columns of the three tables.
PAPER_KEY, SAMPLE_KEY, CURVE_KEY = ("SID",), ("SID", "sample_id"), ("SID", "figure_id", "sample_id")
PAPER = (*PAPER_KEY, "DOI", "URL", "title", "container_title", "container_title_short", "issued", "volume", "issue", "page", "publisher", "project_names", "author", "created_at")
SAMPLE = (*SAMPLE_KEY, "sample_name", "composition", "composition_details", "sample_info", "created_at", "updated_at")
CURVE = (*CURVE_KEY, "figure_name", "prop_x", "prop_y", "unit_x", "unit_y", "comments", "x", "y", "project_names", "created_at", "updated_at")
AGENT = "https://automeris.io/WebPlotDigitizer"


def _cells(rows: DataFrame, columns: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """The columns as texts, those of the key trimmed; the empty text for a column that is not there."""
    held = set(rows.columns)
    cell = lambda c: V.text(F.col(f"`{c}`")) if c in held else F.lit("")
    return rows.select(*[(F.trim(cell(c)) if c in key else cell(c)).alias(c) for c in columns])


def keyless(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows that a map leaves out: a part of their key is null or blank."""
    held = [c for c in key if c in rows.columns]
    return rows if len(held) < len(key) else rows.where(F.array_contains(F.array(*[F.trim(V.text(F.col(f"`{c}`"))) == "" for c in held]), True))


def _held(rows: DataFrame, spec: Map) -> Map:
    """The map without properties of a column that rows do not have: these are empty."""
    lacks = (set(PAPER) | set(SAMPLE) | set(CURVE)) - set(rows.columns)
    return replace(spec, properties=tuple(p for p in spec.properties if p.column not in lacks))


def _said(predicate: str, column: str) -> Property:
    return Property(predicate, function="strip_quoted", column=column)


def _made_by(ns: str, run: str | None) -> tuple[Property, ...]:
    return () if run is None else (Property("prov:wasGeneratedBy", constant=f"{ns}ingestion/{run}", iri=True),)


def papers(rows: DataFrame, ns: str, graph: str, run: str | None = None) -> DataFrame:
    """Papers by SID, their periodical (one for all spellings of a slug, each a name of it), persons by place in the list of
    those who have a name, projects, date, and the run that made them."""
    own = _cells(rows, PAPER, PAPER_KEY).where("SID <> ''")
    own = own.withColumn("journal", V.strip_quoted(F.col("container_title"))).withColumn("slug", F.when(F.col("journal") != "", V.slug(F.col("journal"))))
    paper = Map(f"{ns}paper/{{SID}}", ("x:Paper", "schema:ScholarlyArticle", "prov:Entity"), (
        Property("dcterms:identifier", column="SID"), *_made_by(ns, run), Property("schema:identifier", column="doi"),
        Property("schema:url", function="iri_safe", column="URL", iri=True), _said("schema:name", "title"),
        Property("schema:isPartOf", template=f"{ns}periodical/{{slug}}"), Property("schema:datePublished", function="date_iso", column="issued", datatype="xsd:date"),
        _said("bibo:volume", "volume"), _said("bibo:issue", "issue"), _said("bibo:pages", "page"), _said("schema:publisher", "publisher"),
        Property("x:projectName", function="projects", column="project_names"), _said("dcterms:created", "created_at")))
    periodical = Map(f"{ns}periodical/{{slug}}", ("schema:Periodical",), (Property("schema:name", column="journal"), _said("schema:alternateName", "container_title_short")))
    person = Map(f"{ns}person/{{SID}}/{{place}}", ("schema:Person", "prov:Agent"), (Property("schema:givenName", column="given"), Property("schema:familyName", column="family")))
    link = Map(f"{ns}paper/{{SID}}", (), (Property("schema:author", template=f"{ns}person/{{SID}}/{{place}}"),))
    own = own.withColumn("doi", F.trim("DOI"))
    key, paper = V.percent_encode(F.col("SID")), _held(rows, paper)
    journals = own.where("slug is not null").select("slug", "journal", "container_title_short").distinct()
    people = lambda d: d.select("SID", F.posexplode_outer(V.authors(F.col("author"))).alias("place", "who")).where("place is not null").select("SID", "place", "who.*")
    made = keyed_set(own, key, lambda d: several(d, (paper,), graph).unionByName(several(people(d), (person, link), graph)))
    return made.unionByName(quads(journals, periodical, graph))


def descriptors(info: Column) -> Column:
    """Array of struct(name, category, comment, extracted) of a JSON object of objects, in its order; entries that are no
    objects or have three empty fields are dropped."""
    entries = F.map_entries(F.from_json(V.text(info), "map<string,string>"))
    field = lambda e, c: F.trim(F.coalesce(F.get_json_object(e["value"], f"$.{c}"), F.lit("")))
    made = F.transform(F.filter(entries, lambda e: V.json_kind(e["value"]) == "object"), lambda e: F.struct(F.trim(e["key"]).alias("name"), *[field(e, c).alias(c) for c in ("category", "comment", "extracted")]))
    return F.filter(made, lambda d: F.concat(d["category"], d["comment"], d["extracted"]) != "")


def samples(rows: DataFrame, ns: str, graph: str, run: str | None = None) -> DataFrame:
    """Samples by SID and sample_id (sample_id alone is not unique), linked to their paper, with descriptors by place."""
    own = _cells(rows, SAMPLE, SAMPLE_KEY).where("SID <> '' and sample_id <> ''").withColumn("key", F.concat_ws("-", *SAMPLE_KEY))
    sample = Map(f"{ns}sample/{{key}}", ("x:Sample", "prov:Entity"), (
        Property("dcterms:identifier", column="key"), Property("x:rawSampleId", column="sample_id"), *_made_by(ns, run), _said("schema:name", "sample_name"),
        _said("x:compositionString", "composition"), _said("x:compositionDetails", "composition_details"), Property("x:fromPaper", template=f"{ns}paper/{{SID}}"),
        _said("dcterms:created", "created_at"), _said("dcterms:modified", "updated_at")))
    descriptor = Map(f"{ns}descriptor/{{key}}/{{place}}", ("x:Descriptor",), tuple(Property(f"x:descriptor{c.capitalize()}", column=c) for c in ("name", "category", "comment", "extracted")))
    link = Map(f"{ns}sample/{{key}}", (), (Property("x:hasDescriptor", template=f"{ns}descriptor/{{key}}/{{place}}"),))
    key, sample = V.percent_encode(F.col("key")), _held(rows, sample)
    parts = lambda d: d.select("key", F.posexplode_outer(descriptors(F.col("sample_info"))).alias("place", "d")).where("place is not null").select("key", "place", "d.*")
    return keyed_set(own, key, lambda d: several(d, (sample,), graph).unionByName(several(parts(d), (descriptor, link), graph)))


def curves(rows: DataFrame, ns: str, graph: str, run: str | None = None, quantities: dict[str, str] | None = None, units: dict[str, str] | None = None) -> DataFrame:
    """Curves by SID, figure and sample: labels as said, quantities and units also as IRIs where the given tables know them,
    both arrays as they are with their bounds, and the number of points that both have."""
    own = _cells(rows, CURVE, CURVE_KEY).where("SID <> '' and figure_id <> '' and sample_id <> ''")
    said = lambda d: d.withColumns({"key": F.concat_ws("-", *CURVE_KEY), "sample": F.concat_ws("-", *SAMPLE_KEY), **{c: V.strip_quoted(F.col(c)) for c in ("prop_x", "prop_y", "unit_x", "unit_y")}})
    parsed = lambda d: said(d).withColumns({"xs": V.floats(F.col("x")), "ys": V.floats(F.col("y"))})  # each array once
    bound = {**{f"{a}_{b}": of(F.col(f"{a}s")) for a in "xy" for b, of in (("min", V.lowest), ("max", V.highest))}, "points": V.points(F.col("xs"), F.col("ys"))}
    known = [(f"x:property{a.upper()}Quantity", f"prop_{a}", quantities) for a in "xy"] + [(f"x:unit{a.upper()}", f"unit_{a}", units) for a in "xy"]
    bounds = [Property(f"x:{a}{b.capitalize()}", column=f"{a}_{b}", datatype="xsd:double") for a in "xy" for b in ("min", "max")]
    curve = Map(f"{ns}curve/{{key}}", ("x:Curve", "prov:Entity"), (
        Property("dcterms:identifier", column="key"), Property("x:rawFigureId", column="figure_id"), *_made_by(ns, run), _said("x:figureName", "figure_name"),
        Property("x:ofSample", template=f"{ns}sample/{{sample}}"), Property("x:propertyX", column="prop_x"), Property("x:propertyY", column="prop_y"),
        Property("x:unitXString", column="unit_x"), Property("x:unitYString", column="unit_y"), _said("x:comments", "comments"),
        *[Property(p, function="lookup", column=c, args=(t,), iri=True) for p, c, t in known if t],
        Property("x:xValuesJSON", column="x"), Property("x:yValuesJSON", column="y"), *bounds,
        Property("x:pointCount", column="points", datatype="xsd:integer"),
        Property("x:projectName", function="projects", column="project_names"), _said("dcterms:created", "created_at"), _said("dcterms:modified", "updated_at"),
        Property("prov:wasGeneratedBy", template=f"{ns}digitization/{{key}}")))
    curve = _held(rows, curve)
    return keyed_set(own, V.percent_encode(F.concat_ws("-", *CURVE_KEY)), lambda d: several(parsed(d).withColumns(bound), (curve,), graph))


def digitization(rows: DataFrame, ns: str, graph: str, agent: str = AGENT, name: str = "WebPlotDigitizer") -> DataFrame:
    """The activity by which each curve was read off its figure, at the UTC moment of created_at where that names a zone, and
    the software that all of them share."""
    own = _cells(rows, CURVE, CURVE_KEY).where("SID <> '' and figure_id <> '' and sample_id <> ''")
    own = own.select(F.concat_ws("-", *CURVE_KEY).alias("key"), "created_at")
    activity = Map(f"{ns}digitization/{{key}}", ("x:DigitizationActivity", "prov:Activity"), (
        Property("prov:wasAssociatedWith", constant=agent, iri=True), Property("prov:atTime", function="curator_ts", column="created", datatype="xsd:dateTime")))
    software = Map(agent, ("prov:SoftwareAgent",), (Property("schema:name", constant=name), Property("schema:url", constant=agent, iri=True)))
    made = keyed_set(own, V.percent_encode(F.col("key")), lambda d: several(d.withColumn("created", V.strip_quoted(F.col("created_at"))), (activity,), graph))
    return made.unionByName(quads(own.select("key").limit(1), software, graph))


def activity(spark: SparkSession, ns: str, graph: str, run: str, started: str, file: str, agent: str) -> DataFrame:
    """The run itself: when it began (an ISO moment), the file it used, the software that did it. Its entities name it by the
    run that papers, samples and curves are given."""
    row = spark.range(1).select(F.lit(run).alias("run"), F.lit(file).alias("file"), F.lit(started).alias("started"))
    own = Map(f"{ns}ingestion/{run}", ("x:IngestionActivity", "prov:Activity"), (
        Property("prov:atTime", column="started", datatype="xsd:dateTime"), Property("prov:used", template=f"{ns}source/{{file}}"), Property("prov:wasAssociatedWith", constant=agent, iri=True)))
    source = Map(f"{ns}source/{{file}}", ("prov:Entity",), (Property("schema:name", column="file"),))
    return all_quads(quads(row, own, graph, distinct=False), quads(row, source, graph, distinct=False))
