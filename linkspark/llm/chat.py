"""Chat formatting: records of any known layout become canonical turns, then one string under a template. DataFrame
functions only."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """How records with these nested field paths become turns.

    fields: for each turn of a flat record (role, columns whose texts are joined by a blank line). messages: path of the
    array of turns, with the names of its role and text fields.
    """

    paths: tuple[str, ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout(("messages", "messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout(("turns", "turns[].role", "turns[].text"), messages=("turns", "role", "text")),
    Layout(("conversations", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout(("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout(("instruction", "output", "system"), (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
)
#: Names that some sources give to the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: The template: what opens and closes a turn. Every control string in it begins with '<' or '['.
OPEN, AFTER_ROLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>\n"
#: Escapes in the order in which they are made; they are undone in the reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def fingerprint(paths: tuple[str, ...]) -> int:
    """Hash of a set of nested field paths."""
    return zlib.crc32("\n".join(sorted(paths)).encode())


def _paths(kind: T.DataType, at: str) -> list[str]:
    out = []
    if isinstance(kind, T.ArrayType):
        return _paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            name = f"{at}.{f.name}" if at else f.name
            out += [name, *_paths(f.dataType, name)]
    return out


def _by_print(layouts: tuple[Layout, ...]) -> dict[int, Layout]:
    return {fingerprint(x.paths): x for x in layouts}


def typed_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a DataFrame whose columns are the records' fields. The layout is found once, from the schema:
    columns that no layout names (ids, extra columns) are not part of the fingerprint."""
    known = {p for x in layouts for p in x.paths}
    found = _by_print(layouts).get(fingerprint(tuple(p for p in _paths(df.schema, "") if p in known)))
    if found is None:
        raise ValueError(f"no layout for the columns {df.columns}")
    if found.messages:
        path, role, text = found.messages
        turns = F.transform(F.col(path), lambda m: F.struct(m[role].cast("string").alias("role"), m[text].cast("string").alias("text")))
        return _canonical(turns)
    return _canonical(_flat(found, lambda name: F.col(name).cast("string")))


def json_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a JSON record; each row has a layout of its own. The field paths of the row's variant schema
    are hashed, those of all elements of a list together; an empty list has no turns. A turn without a role or text has
    an empty one. Null where the text is not JSON or no layout has that fingerprint (such rows can be told and kept)."""
    value = F.try_parse_json(record)
    known = sorted({p.split("[]")[0] for x in layouts for p in x.paths})
    parts = []
    for name in known:
        here = F.try_variant_get(value, f"$.{name}", "variant")
        inner = sorted({p.split("[].")[1] for x in layouts for p in x.paths if p.startswith(name + "[].")})
        elements = F.try_variant_get(value, f"$.{name}", "array<variant>")
        each = [F.when(F.exists(elements, _has(i)) | (F.size(elements) == 0), f"{name}[].{i}") for i in inner]
        parts += [F.when(here.isNotNull(), name), *each]
    paths = F.array_sort(F.array_compact(F.array(*parts)))
    shape = F.crc32(F.array_join(paths, "\n"))
    out = F.lit(None).cast(f"array<{TURN}>")
    for print_, layout in _by_print(layouts).items():
        if layout.messages:
            turns = _messages(value, *layout.messages)
        else:
            turns = _flat(layout, lambda name: F.try_variant_get(value, f"$.{name}", "string"))
        out = F.when(shape == print_, turns).otherwise(out)
    return _canonical(out)


def _has(field: str):
    return lambda m: F.try_variant_get(m, f"$.{field}", "variant").isNotNull()


def _messages(value: Column, path: str, role: str, text: str) -> Column:
    def turn(m: Column) -> Column:
        return F.struct(F.try_variant_get(m, f"$.{role}", "string").alias("role"), F.try_variant_get(m, f"$.{text}", "string").alias("text"))

    return F.transform(F.try_variant_get(value, f"$.{path}", "array<variant>"), turn)


def _flat(layout: Layout, get) -> Column:
    made = []
    for role, names in layout.fields:
        texts = [F.when(get(n) != "", get(n)) for n in names] if len(names) > 1 else [get(n) for n in names]
        made.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text")))
    return F.array(*made)


def _canonical(turns: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(m: Column) -> Column:
        role = F.coalesce(m["role"], F.lit(""))
        return F.struct(F.coalesce(F.try_element_at(names, role), role).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))

    return F.transform(turns, turn)


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def formatted(turns: Column) -> Column:
    """One string: each turn as <s>[ROLE]role[/ROLE]text</s> and a line feed, with role and text escaped, so that no text
    can hold a control string. No turns (an empty array) give an empty string, null gives null."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(AFTER_ROLE), escape(m["text"]), F.lit(CLOSE))), "")


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """Where the loss applies in a formatted string: array<struct<start,length>> in code points (start from 1), one for
    the text of each turn of that role, without the control strings around it."""
    parts = F.split(text, r"\Q" + CLOSE + r"\E")
    head = F.lit(OPEN + role + AFTER_ROLE)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, part: Column) -> Column:
        span = F.struct((acc["at"] + F.length(head)).alias("start"), (F.length(part) - F.length(head)).alias("length"))
        spans = F.when(part.startswith(head), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, add, lambda acc: acc["spans"])


def read_turns(text: Column) -> Column:
    """The turns of a formatted string, unescaped: what formatted() was given."""
    parts = F.filter(F.split(text, r"\Q" + CLOSE + r"\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        cut = F.instr(body, AFTER_ROLE)
        return F.struct(unescape(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + len(AFTER_ROLE))).alias("text"))

    return F.transform(parts, turn)


def from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation (conv, turns) of a table with a row for each turn; other columns are left out.

    Rows stand by turn (null first), then role and text, so ties have one order; null roles and texts are empty. A null
    conversation id is one conversation. A conversation is one string in the end, so its rows meet in one task; the
    longest conversation bounds that, however many rows the table has.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    packed = F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    ordered = F.array_sort(F.collect_list(packed))
    return rows.groupBy(F.col(conv)).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


#: A conversation whose texts hold control strings, in the message layout.
EXTRA = (-7, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}')


def op5_chat_format(spark, sf_dir):
    """Every conversation formatted, and what is read back from the formatted string."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    records = from_rows(rows)
    own = records.select("conv_id", typed_turns(records).alias("turns"))
    extra = spark.range(1).select(F.lit(EXTRA[0]).cast("long").alias("conv_id"), json_turns(F.lit(EXTRA[1])).alias("turns"))
    made = own.unionByName(extra).select("conv_id", formatted(F.col("turns")).alias("formatted"))
    spans = loss_spans(F.col("formatted"))
    masked = F.transform(spans, lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"])))
    made = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
e as (select *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length('<s>[ROLE][/ROLE]</s>') + 1 as n from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id"""
