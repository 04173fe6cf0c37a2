"""Cleaning functions over the driver tables: literal shapes are made from columns on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.functions import values as V
from linkspark.operators.crosswalk import normalize
from linkspark.operators.discovery import LADDER, compound_key
from linkspark.plans.registry import query
from linkspark.plans.registry import table as _t

_P = "select p_partkey as k, p_partkey % 7 as m, p_size as z, p_name as name, p_brand as brand, p_retailprice as price from part"


def _parts(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("m"), F.col("p_size").alias("z"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def _case(*texts):
    """A column that takes one of several SQL-like texts by k % 7; {k} stands for the key."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        pieces = t.split("{k}")
        made = F.concat(*[x for j, p in enumerate(pieces) for x in ((F.col("k").cast("string"), F.lit(p)) if j else (F.lit(p),))])
        out = F.when(F.col("m") == i, made).otherwise(out)
    return out


def _sql(expected: list[str]) -> str:
    """The expected texts by k % 7; {k} stands for the key, null for no text."""
    whens = " ".join(f"when {i} then " + ("null" if e is None else " || ".join(["''", *[("k::varchar || " if j else "") + "'" + p.replace("'", "''") + "'" for j, p in enumerate(e.split("{k}"))]])) for i, e in enumerate(expected))
    return f"with p as ({_P}) select k, case m {whens} end as v from p"


def _shapes(name: str, function, given: list[str], expected: list[str | None]) -> None:
    @query(name, _sql(expected))
    def run(spark, sf_dir):
        return _parts(spark, sf_dir).select("k", function(_case(*given)).alias("v"))


_shapes("fn_percent_to_ratio", V.percent_to_ratio, ["50%", "12.5 %", "1,200%", "n{k}%", "{k}", "-3%", "0.001%"], ["0.5", "0.125", "12.0", "", "", "-0.03", "1e-05"])
_shapes("fn_range_bounds", lambda c: F.concat_ws("|", V.range_min(c), V.range_max(c)), ["1-{k}", "2 to {k}", "3..{k}", "4‒{k}", "-5−{k}", "{k}", "1.5 ~ {k}"], ["1|{k}", "2|{k}", "3|{k}", "4|{k}", "-5|{k}", "|", "1.5|{k}"])
_shapes("fn_value_and_unit", lambda c: F.concat_ws("|", V.value_of(c), V.unit_of(c)), ["{k} K", "{k}. x", ".5 m{k}", "-3.2e-4 V{k}", "{k}", "about {k}", "{k}.25mm/s"], ["{k}|K", "{k}|. x", "|", "-3.2e-4|V{k}", "{k}|", "|", "{k}.25|mm/s"])
_shapes("fn_datetime_spellings", V.datetime_iso, ["03/04/2020", "1 Jan 2020", "2020-02-31", "1577836800123", "2020-01-01", "2020-01-01T10:00:00Z", "-1577836800"], ["2020-03-04T00:00:00", "2020-01-01T00:00:00", "", "2020-01-01T00:00:00.123000Z", "2020-01-01T00:00:00", "2020-01-01T10:00:00+00:00", "1920-01-02T00:00:00Z"])
_shapes("fn_curator_ts", V.curator_ts, ["Fri Sep 01 2017 09:19:39 GMT+0900 (JST)", "Fri Sep 01 2017 09:19:39", "Mon Jan 01 2018 00:00:00 +0000", "{k}", "", "Fri Sep 01 2017 09:19:39 GMT-0130", "Sat Feb 29 2020 23:59:59 GMT+0000 (UTC)"], ["2017-09-01T00:19:39+00:00", None, "2018-01-01T00:00:00+00:00", None, None, "2017-09-01T10:49:39+00:00", "2020-02-29T23:59:59+00:00"])
_shapes("fn_structural_slug", V.structural_slug, ["3.2 Heading {k}", " 2.1. The Series", "Acknowledgments", "10.4.1", "{k}.7 x", "Appendix A", ""], ["3-2", "2-1", "", "10-4-1", "{k}-7", "", ""])
_shapes("fn_strip_quoted", V.strip_quoted, ['"quoted {k}"', " plain {k} ", '"a\\"b"', '"', "", '"open', '""'], ["quoted {k}", "plain {k}", 'a"b', '"', "", '"open', ""])
_shapes("fn_iri_safe", V.iri_safe, ["http://x/a b{k}", "no scheme {k}", "urn:x:{k}", '"http://x/<{k}>"', "http://x/{k}|y", "", "HTTP://x/`{k}^"], ["http://x/a%20b{k}", "", "urn:x:{k}", "http://x/%3C{k}%3E", "http://x/{k}%7Cy", "", "HTTP://x/%60{k}%5E"])
_shapes("fn_regex_extract", lambda c: V.regex_extract(c, r"no\.(?P<v>\d+)"), ["no.{k}", "x no.{k} y", "no.", "", "no.7 no.8", "NO.{k}", "ano.{k}b"], ["{k}", "{k}", "", "", "7", "", "{k}"])
_shapes("fn_humanize_term", V.humanize_term, ["http://x/hasCompositionString", "http://x#zt", "x/my_name", "plain", "http://x/peakValue{k}", "", "http://x/a-b"], ["has Composition String", None, "my name", None, "peak Value{k}", None, "a b"])
_shapes("fn_unit_from_label", V.unit_from_label, ["Beak Length (mm)", "Body Mass (g)", "Rate (see text)", "Name", "Speed (m/s)", "Col (12)", "Mass (kilograms)"], ["mm", "g", None, None, "m/s", None, None])
_shapes("fn_label_from_column", V.label_from_column, ["Beak Length (mm)", "Body Mass (g)", "Rate (see text)", " Name ", "Speed (m/s)", "Col (12)", "Mass (kilograms)"], ["Beak Length", "Body Mass", "Rate (see text)", "Name", "Speed", "Col (12)", "Mass (kilograms)"])
_shapes("fn_bool_norm", V.bool_norm, [" YES ", "f", "1", "0", "maybe", "", "True"], ["true", "false", "true", "false", "", "", "true"])
_shapes("fn_year_only", V.year_only, ["March 5, 2014", "12345", "0999", "3000", "in 1998 and 2001", "", "y2020z"], ["2014", "", "", "", "1998", "", "2020"])
_shapes("fn_doi_norm", V.doi_norm, ["https://doi.org/10.1000/ABC{k}", "doi:10.1000/x.", "none", "10.12345/a;b)", "", "see 10.1021/Z{k},", "10.1/x"], ["10.1000/abc{k}", "10.1000/x", "", "10.12345/a;b", "", "10.1021/z{k}", ""])
_shapes("fn_strip_footnote", V.strip_footnote, ["Hello[1]", "World*", "x¹", "y (2014)", "z[1][2]", "", "w †‡"], ["Hello", "World", "x", "y (2014)", "z", "", "w"])
_shapes("fn_json_shapes", lambda c: F.concat_ws("|", V.json_kind(c), F.array_join(V.projects(c), "+")), ['["a", " b ", ""]', '{"a": 1}', "[]", "text {k}", '["x{k}"]', "", "[1, null]"], ["array|a+b", "object", "array", "", "array|x{k}", "", "array|1"])
_shapes("fn_authors", lambda c: F.array_join(F.transform(V.authors(c), lambda a: F.concat_ws(" ", a["given"], a["family"])), "; "), ['[{"given": "A", "family": "B{k}"}]', '[{"given": "", "family": " "}]', "[]", "no json", '[{"given": "C"}, {"family": "D"}]', "", '[{"given": " E ", "family": "F", "x": 1}]'], ["A B{k}", None, None, None, "C ;  D", None, "E F"])
_shapes("fn_float_array_text", lambda c: F.concat_ws("|", V.float_array_min(c), V.float_array_max(c)), ["[1, 2.5, -1{k}]", "[]", '["3", null, "x"]', "[1e20, 1e-7]", "[NaN]", "", "[0.0005]"], ["-1{k}.0|2.5", "|", "3.0|3.0", "1e-07|1e+20", "|", "|", "0.0005|0.0005"])
_shapes("fn_doc_id", lambda c: V.doc_id(F.when(F.col("m") == 0, c), F.when(F.col("m") == 1, c), c), ["PMC{k}", "10.1000/A{k}", "dir/My File {k}.xml", "x.txt", "", "/a/b/C d.pdf", "10.1000/z"], ["PMC{k}", "10.1000_a{k}", "my-file-{k}", "x", "unknown", "c-d", "z"])
_shapes("nrm_recipe_steps", lambda c: normalize(c, "nfkc,fold_subscripts,remove_ws,casefold"), ["Bi₂Te₃", " A B ", "ＡＢ{k}", "Straße", "", "x\ty", "ﬁn"], ["bi2te3", "ab", "ab{k}", "strasse", "", "xy", "fin"])
_shapes("nrm_loose_text", LADDER["loose_text"], ["  A   b{k} ", "Ａ", "Straße", "a b", "", "Café", "X"], ["a b{k}", "a", "strasse", "a b", "", "café", "x"])
_shapes("nrm_identity", LADDER["identity"], [" a {k} ", "B", "", " ", "c  d", "é", "x"], ["a {k}", "B", "", "", "c  d", "é", "x"])
_shapes("fn_nt_escape", V.nt_escape, ['a"b', "a\\b", "a\nb", "a\tb", "{k}", "", "a\rb"], ['a\\"b', "a\\\\b", "a\\nb", "a\\tb", "{k}", "", "a\\rb"])
_shapes("fn_tokens", lambda c: F.array_join(V.tokens(c), " "), ["hasCompositionString", "is_open", "has", "p-value{k}", "", "ABC def", "x"], ["composition string", "open", "has", "p value{k}", "", "abc def", "x"])


@query("nrm_compound_key", f"with p as ({_P}) select k, case when name = '' or brand = '' then null else lower(name) || chr(31) || lower(brand) end as key, case when name = '' or brand = '' then null else lower(name) || ' | ' || lower(brand) end as shown from p")
def nrm_compound_key(spark, sf_dir):
    key, shown = compound_key([normalize(F.col("name"), "casefold"), normalize(F.col("brand"), "casefold")])
    return _parts(spark, sf_dir).select("k", key.alias("key"), shown.alias("shown"))


@query("fn_array_slice", "select vec_id, embedding[1:3] as x, len(embedding) > 3 as truncated from embeddings")
def fn_array_slice(spark, sf_dir):
    cell = F.to_json("embedding")
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", V.array_slice(cell, cell, 3).alias("s"))
    return rows.select("vec_id", F.col("s.x").cast("array<float>").alias("x"), "s.truncated")
