"""Cleaning functions: text column to text (or array) column. "" means no value; list functions give null for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, and tokens that mean "no value" once trimmed and lower-cased.
CURRENCY = "$€£¥₩₹฿₫₴₪₦"
NULL_TOKENS = ("", "-", "--", "---", "?", "n/a", "n.a.", "na", "null", "none", "nan", "nil", "#n/a", "unknown")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_number(c: Column) -> Column:
    return F.trim(text(c)).rlike(NUMBER)


def to_double(c: Column) -> Column:
    """Double where the text is a plain number, else null ("1d" and "0x1" are not)."""
    return F.when(is_number(c), F.trim(text(c)).try_cast("double"))


def is_null_token(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin(*NULL_TOKENS)


def number_clean(c: Column) -> Column:
    """A number without separators, currency signs and accounting brackets; its digits stay as written."""
    raw = F.trim(text(c))
    minus = raw.rlike(r"^\(.*\)$")
    body = F.regexp_replace(F.regexp_replace(raw, r"^\((.*)\)$", "$1"), rf"[{CURRENCY},'_\s\u00A0]", "")
    out = F.when(minus & ~body.startswith("-"), F.concat(F.lit("-"), body)).otherwise(F.regexp_replace(body, r"^\+", ""))
    return F.when(out.rlike(NUMBER), out).otherwise("")


# Two numbers around "..", "to", a hyphen, a tilde, or a figure, en or em dash or minus sign.
_RANGE = "(?i)^\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*(?:\\.\\.|to|[\u2012\u2013\u2014\u2212~-])\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*$"


def range_min(c: Column) -> Column:
    return F.regexp_extract(text(c), _RANGE, 1)


def range_max(c: Column) -> Column:
    return F.regexp_extract(text(c), _RANGE, 2)


_LEADING = r"(?s)^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"


def value_of(c: Column) -> Column:
    return F.regexp_extract(text(c), _LEADING, 1)


def unit_of(c: Column) -> Column:
    return F.regexp_extract(text(c), _LEADING, 2)


def number_text(d: Column) -> Column:
    """A double as its shortest digits: plain from 0.0001 up to 1e16, else with an exponent of two digits or more."""
    raw = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(raw.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    power = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.abs(power).cast("string")
    wide = F.concat(F.regexp_replace(F.regexp_extract(raw, "^(.*)E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    return F.when(~raw.contains("E"), raw).when((F.abs(d) >= 1e-4) & (F.abs(d) < 1e16), plain).otherwise(wide)


def percent_to_ratio(c: Column) -> Column:
    """A cleaned number before a closing % as a share of one; "" without the sign or a number."""
    t = F.trim(text(c))
    n = number_clean(F.regexp_replace(t, "%$", ""))
    return F.when(t.endswith("%"), F.coalesce(number_text(n.try_cast("double") / 100), F.lit(""))).otherwise("")


def bool_norm(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t.isin(*TRUE), "true").when(t.isin(*FALSE), "false").otherwise("")


def year_only(c: Column) -> Column:
    t = text(c)
    return F.when(F.trim(t).rlike(r"^\d{5,}$"), "").otherwise(F.regexp_extract(t, r"(?<!\d)([12]\d{3})(?!\d)", 1))


def date_iso(c: Column) -> Column:
    """ISO date of {"date_parts": [[year, month, day]]}; a missing month or day is 1."""
    parts = F.get(F.from_json(text(c), "date_parts array<array<int>>")["date_parts"], F.lit(0))
    part = lambda i: F.get(parts, F.lit(i))
    day = F.format_string("%04d-%02d-%02d", part(0), F.coalesce(part(1), F.lit(1)), F.coalesce(part(2), F.lit(1)))
    return F.coalesce(F.when(part(0).isNotNull(), day.try_cast("date").cast("string")), F.lit(""))


# Spellings of a moment other than ISO, in the order in which they are tried (US before European dates).
_SPELLINGS = ("yyyy/M/d H:m:s", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")
_ISO = r"^(\d{4}-\d\d-\d\d)(?:[T ]((?:[01]\d|2[0-3]):[0-5]\d)(:[0-5]\d)?(\.\d{1,6})?(Z|z|[+-]\d\d:?\d\d)?)?$"


def _utc(ts: Column, pattern: str) -> Column:
    """A timestamp's UTC reading, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def datetime_iso(c: Column) -> Column:
    """Epoch seconds (10 to 12 digits) or milliseconds (13) as UTC with Z; ISO dates and moments with all their parts, an
    offset as +hh:mm; other spellings as naive moments; else "" """
    t = F.trim(text(c))
    epoch = F.when(t.rlike(r"^-?\d{13}$"), F.timestamp_millis(t.try_cast("bigint"))).when(t.rlike(r"^-?\d{10,12}$"), F.timestamp_seconds(t.try_cast("bigint")))
    part = lambda i: F.regexp_extract(t, _ISO, i)
    fraction = F.when(part(4) != "", F.rpad(part(4), 7, "0")).otherwise("")
    fraction = F.when(fraction == ".000000", "").otherwise(fraction)
    offset = F.when(F.lower(part(5)) == "z", "+00:00").otherwise(F.regexp_replace(part(5), r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
    iso = F.concat(part(1), F.lit("T"), F.when(part(2) == "", "00:00").otherwise(part(2)), F.when(part(3) == "", ":00").otherwise(part(3)), fraction, offset)
    naive = F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in _SPELLINGS])
    ms = F.when(F.unix_millis(epoch) % 1000 == 0, "").otherwise(_utc(epoch, "'.'SSSSSS"))
    return F.coalesce(F.concat(_utc(epoch, "yyyy-MM-dd'T'HH:mm:ss"), ms, F.lit("Z")), F.when(part(1).try_cast("date").isNotNull(), iso), F.date_format(naive, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def curator_ts(c: Column) -> Column:
    """UTC moment of a browser's date text (Fri Sep 01 2017 09:19:39 GMT+0900 (JST)); null without a zone."""
    form = r"^[A-Za-z]{3} ([A-Za-z]{3} \d{1,2} \d{4} \d\d:\d\d:\d\d) (?:GMT)?\s*([+-]\d{4})(?:\s*\(.*\))?$"
    t = F.trim(text(c))
    moment = F.try_to_timestamp(F.when(t.rlike(form), F.concat_ws(" ", F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2))), F.lit("MMM d yyyy HH:mm:ss Z"))
    return F.concat(_utc(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def trim_collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip_footnote(c: Column) -> Column:
    return F.regexp_replace(F.trim(text(c)), r"(?:\s*(?:\[\d+\]|[*†‡§¹²³⁴-⁹⁰]))+$", "")


def slug(c: Column) -> Column:
    plain = F.regexp_replace(F.trim(text(c)), r'^"(.*)"$', "$1")
    s = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 80), "-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def doi_norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(text(c), r"(10\.\d{4,9}/\S+)", 1), r"[.,;)]+$", ""))


def url_canonical(c: Column) -> Column:
    """Scheme and host lower-cased; default port, user, fragment and trailing slashes gone; "" without scheme or host."""
    parts = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    get = lambda i: F.regexp_extract(text(c), parts, i)
    scheme, host = F.lower(get(1)), F.lower(get(2))
    port = F.when(((scheme == "http") & (get(3) == ":80")) | ((scheme == "https") & (get(3) == ":443")), "").otherwise(get(3))
    path = F.regexp_replace(get(4), "/+$", "")
    path = F.when((path == "") & (get(4) != ""), "/").otherwise(path)
    return F.when(host == "", "").otherwise(F.concat(scheme, F.lit("://"), host, port, path, get(5)))


def percent_encode(c: Column) -> Column:
    out = F.url_encode(text(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def local_name(c: Column) -> Column:
    return F.regexp_extract(text(c), r"([^#/]*)$", 1)


def nt_escape(c: Column) -> Column:
    out = text(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tokens(c: Column) -> Column:
    """Lower words of a camel-case or separated name, without a leading has or is."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(text(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.when((F.size(words) > 1) & F.get(words, F.lit(0)).isin("has", "is"), F.slice(words, 2, 1000)).otherwise(words)


def floats(c: Column) -> Column:
    """Numbers of a JSON array cell; null, NaN and other elements skipped."""
    return F.filter(F.transform(F.from_json(text(c), "array<string>"), to_double), lambda x: x.isNotNull() & ~F.isnan(x))


def highest(a: Column) -> Column:
    return F.coalesce(number_text(F.array_max(a)), F.lit(""))


def lowest(a: Column) -> Column:
    return F.coalesce(number_text(F.array_min(a)), F.lit(""))


def points(a: Column, b: Column) -> Column:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))  # noqa: E731  least() would pass over a null
    n = F.least(size(a), size(b))
    return F.when(n > 0, n.cast("string")).otherwise("")


def float_array_max(c: Column) -> Column:
    return highest(floats(c))


def float_array_min(c: Column) -> Column:
    return lowest(floats(c))


def float_array_count(x: Column, y: Column) -> Column:
    return points(floats(x), floats(y))


def _elements(c: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text(c)), "$", "array<variant>")


def json_array(c: Column) -> Column:
    """Scalars of a JSON array; null where there are none."""
    kept = F.filter(_elements(c), lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    out = F.transform(kept, lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(F.size(out) > 0, out)


def json_array_single(c: Column) -> Column:
    out = json_array(c)
    return F.when((F.size(_elements(c)) == 1) & (F.size(out) == 1), F.get(out, F.lit(0))).otherwise("")


def json_pluck(c: Column, field: str) -> Column:
    objects = F.filter(_elements(c), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    out = F.filter(F.transform(objects, lambda v: F.try_variant_get(v, f"$.{field}", "string")), lambda s: s.isNotNull())
    return F.when(F.size(out) > 0, out)


def array_at(c: Column, at: int) -> Column:
    element = F.try_element_at(_elements(c), F.lit(at + 1 if at >= 0 else at))
    return F.coalesce(F.try_variant_get(element, "$", "string"), F.lit(""))


def split(c: Column, by: str) -> Column:
    out = F.filter(F.transform(F.split(text(c), r"\Q" + by + r"\E"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(out) > 0, out)


def template(pattern: str, *columns: Column) -> Column:
    """{1}, {2}, ... of the pattern replaced once by the columns; a missing one is empty."""
    import re

    parts = re.split(r"(\{\d+\})", pattern)
    made = [text(columns[int(p[1:-1]) - 1]) if re.fullmatch(r"\{\d+\}", p) and 0 < int(p[1:-1]) <= len(columns) else F.lit("" if re.fullmatch(r"\{\d+\}", p) else p) for p in parts]
    return F.concat(*made)


def template_of(*args) -> Column:
    """template() as a mapping names it: columns first, the pattern last."""
    return template(args[-1], *args[:-1])


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of the trimmed, lower-cased key; a miss is "". The table is part of the plan, so it is small."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k.strip().lower(), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(text(c)))), F.lit(""))


def structural_slug(c: Column) -> Column:
    """Leading dotted number of a heading with dashes; "" without one."""
    return F.replace(F.regexp_extract(text(c), r"^\s*(\d+(?:\.\d+)*)", 1), F.lit("."), F.lit("-"))


def strip_quoted(c: Column) -> Column:
    """Text of a JSON string in quotes, else the trimmed cell."""
    t = F.trim(text(c))
    return F.coalesce(F.when(t.rlike(r'(?s)^".*"$'), F.try_variant_get(F.try_parse_json(t), "$", "string")), t)


def iri_safe(c: Column) -> Column:
    """An IRI with a scheme, the ten characters that may not stand in one percent-encoded; else "" """
    out = strip_quoted(c)
    for ch in ' <>"{}|\\^`':
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return F.when(out.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), out).otherwise("")


def regex_extract(c: Column, pattern: str) -> Column:
    """Group v of the first match, else its first group, else all of it; "" for no match, a text over 4,096 characters or a
    pattern that does not compile (which is judged once, on the driver)."""
    import re

    try:
        groups = re.compile(pattern)
    except re.error:
        return F.lit("")
    at = groups.groupindex.get("v", 1 if groups.groups else 0)
    found = F.regexp_extract(text(c), re.sub(r"\(\?P<", "(?<", pattern), at)
    return F.when(F.length(text(c)) > 4096, "").otherwise(found)


def humanize_term(c: Column) -> Column:
    """Local name of an IRI read as words; null where that changes nothing."""
    name = local_name(c)
    words = F.array_join(F.filter(F.split(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "), " "), lambda w: w != ""), " ")
    return F.when((words != name) & (words != ""), words)


_UNIT = r"^(.*\S)\s*\(([^()]{1,24})\)\s*$"


def unit_from_label(c: Column) -> Column:
    """Unit in the closing brackets of a heading; null where they hold words of prose or digits alone."""
    unit = F.trim(F.regexp_extract(text(c), _UNIT, 2))
    prose = unit.rlike(r"^[A-Za-z]{6,}$") | unit.rlike(r"\s") | unit.rlike(r"^\d+$")
    return F.when((unit != "") & ~prose, unit)


def label_from_column(c: Column) -> Column:
    """A heading without the brackets of its unit."""
    return F.when(unit_from_label(c).isNotNull(), F.regexp_extract(text(c), _UNIT, 1)).otherwise(F.trim(text(c)))


def doc_id(pmcid: Column, doi: Column, name: Column) -> Column:
    """Id of an article: its PMC id, else its DOI with _ for /, else the slug of its file name."""
    d = F.replace(doi_norm(doi), F.lit("/"), F.lit("_"))
    return F.when(F.trim(text(pmcid)) != "", F.trim(text(pmcid))).when(d != "", d).otherwise(slug(F.regexp_replace(F.regexp_extract(text(name), "([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")))


def array_slice(x: Column, y: Column, most: int) -> Column:
    """First points of two number cells: struct(x, y, truncated)."""
    a, b = floats(x), floats(y)
    return F.struct(F.slice(a, 1, most).alias("x"), F.slice(b, 1, most).alias("y"), F.coalesce(F.greatest(F.size(a), F.size(b)) > most, F.lit(False)).alias("truncated"))


def authors(c: Column) -> Column:
    """Array of struct(given, family) of a JSON list of persons; those without both are dropped; null for none."""
    made = F.transform(F.from_json(text(c), "array<struct<given:string,family:string>>"), lambda a: F.struct(F.trim(text(a["given"])).alias("given"), F.trim(text(a["family"])).alias("family")))
    kept = F.filter(made, lambda a: (a["given"] != "") | (a["family"] != ""))
    return F.when(F.size(kept) > 0, kept)


def projects(c: Column) -> Column:
    """Trimmed texts of a JSON list that are not empty; null for none."""
    kept = F.filter(F.transform(json_array(c), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.size(kept) > 0, kept)


def json_kind(c: Column) -> Column:
    """array, object or null for a cell that is neither."""
    kind = F.schema_of_variant(F.try_parse_json(text(c)))
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")


#: The closed set of functions that a mapping may name.
REGISTRY = {f.__name__: f for f in (number_clean, range_min, range_max, value_of, unit_of, percent_to_ratio, bool_norm, year_only, date_iso, datetime_iso, trim_collapse, strip_footnote, slug, doi_norm, url_canonical, percent_encode, local_name, tokens, float_array_max, float_array_min, float_array_count, json_array, json_array_single, json_pluck, array_at, split, template, lookup, structural_slug, iri_safe, strip_quoted, regex_extract, curator_ts, projects, template_of)}


def function(name: str):
    """A function of the closed set; any other name is an error before anything runs."""
    if name not in REGISTRY:
        raise ValueError(f"unknown function {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
