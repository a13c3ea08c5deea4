"""Chat formatting by schema fingerprints (native).

A record is JSON of any layout, or a struct. Its fingerprint is a hash of its nested field paths
(names and nesting, not value types), computed row by row from the inferred schema, or from the
struct's own; it selects a declarative mapping that turns the record into canonical turns. The
template then marks turns, and escapes what could be read as a mark; both can be undone from the
formatted string alone.

A text may be as long as a string column holds. Variants end at 20 million characters of a string
and 128 MiB of a record, so the layout of a JSON record beyond is found with its string values
emptied; should that not fit either, the query fails. Structs are never parsed.

Template of a turn: OPEN role MIDDLE text CLOSE. Escaping puts `\\` behind every `[` and `<`, the
characters that marks begin with, so no mark can occur inside a text or role, and taking out that
one character restores them.

Cases: null text and null role are empty; a record of unknown layout or that is not JSON has null
turns and fingerprint's mapping is null; no turns give an empty string; rows with null conversation
id form one conversation; turns with equal numbers are ordered by role and text, repeated rows
repeat; empty tables work. Columns of records, whatever their names, stay, but for `mapping`,
`formatted` and `loss_mask`, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """How records with these field paths become turns.

    paths: field paths with `[]` behind arrays. items: the path of the turn array with its role and
    text fields; or fixed: (role, field paths joined by a blank line) in order.
    """

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("shares", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping("instruction", ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("short instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system prompt", ("completion", "prompt", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: Role names of some layouts and their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _shape(paths: tuple[str, ...]) -> str:
    """The inferred schema that these paths give, without value types."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def text(node: dict) -> str:
        if not node:
            return ""
        inner = lambda k, v: f"{k.removesuffix('[]')}:" + (f"ARRAY<OBJECT<{text(v)}>>" if k.endswith("[]") else f"OBJECT<{text(v)}>" if v else "")
        return ",".join(inner(k, v) for k, v in sorted(node.items()))

    return f"OBJECT<{text(tree)}>"


def _kind_shape(kind: DataType) -> str:
    """The same of a column's type."""
    if isinstance(kind, StructType):
        return "OBJECT<" + ",".join(f"{f.name}:{_kind_shape(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, ArrayType):
        return f"ARRAY<{_kind_shape(kind.elementType) or kind.elementType.simpleString()}>"
    return "MAP" if isinstance(kind, MapType) else ""


#: Records of fewer characters reach no limit of variants.
LONG = 1 << 20
#: Reads strings of any length.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "__malformed"}
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'


def _skeleton(record: Column) -> Column:
    """A JSON record with its string values emptied; field names stay."""
    return F.regexp_replace(record, rf"({_STRING}\s*+:)|(\"){_STRING[1:-1]}(\")", "$1$2$3")


def _long_kinds(record: Column) -> Column:
    """The inferred schema of a long record that is no variant; null if it is not JSON."""
    whole = F.from_json(record, "`__none` string, `__malformed` string", ANY_LENGTH)["__malformed"].isNull()
    kinds = F.schema_of_variant(F.try_parse_json(_skeleton(record)))
    return F.when(whole, F.coalesce(kinds, F.raise_error(F.lit("a chat record is too large for its layout to be found")).cast("string")))


def shape(record: Column) -> Column:
    """Names and nesting of a JSON record's fields; null if it is not JSON."""
    kinds = F.schema_of_variant(F.try_parse_json(record))
    kinds = F.coalesce(kinds, F.when(F.length(record) >= LONG, _long_kinds(record)))
    return F.regexp_replace(F.regexp_replace(kinds, r"\s", ""), r":(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\(\d+,\d+\))(?=[,>]|$)", ":")


def fingerprint(record: Column) -> Column:
    return F.sha2(shape(record), 256)


def _turns(record: Column, m: Mapping, roles: dict[str, str], native: bool) -> Column:
    read = lambda kind: record if native else F.from_json(record, kind, ANY_LENGTH)
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if m.items:
        path, role, text = m.items
        kind = f"struct<`{path}`:array<struct<`{role}`:string,`{text}`:string>>>"
        items = read(kind)[path]
        named = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
        return F.transform(items, lambda x: turn(F.coalesce(named[x[role].cast("string")], x[role].cast("string")), x[text].cast("string")))
    fields = sorted({f for _, fs in m.fixed for f in fs})
    parsed = read("struct<" + ",".join(f"`{f}`:string" for f in fields) + ">")
    blank = lambda f: F.when(parsed[f].cast("string") != "", parsed[f].cast("string"))
    return F.array(*[turn(F.lit(role), F.concat_ws("\n\n", *[blank(f) for f in fs])) for role, fs in m.fixed])


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """Adds `mapping` and `turns` (array of role and text)."""
    own, kind = F.col(f"`{record}`"), records.schema[record].dataType
    native = isinstance(kind, StructType)
    held = records.withColumn("__fingerprint", F.when(own.isNotNull(), F.sha2(F.lit(_kind_shape(kind)), 256)) if native else fingerprint(own))
    same = lambda m: F.col("__fingerprint") == F.sha2(F.lit(_shape(m.paths)), 256)
    name = turns = F.lit(None)
    fits = [m for m in mappings if not native or _shape(m.paths) == _kind_shape(kind)]
    for m in reversed(fits):
        name = F.when(same(m), F.lit(m.name)).otherwise(name)
        turns = F.when(same(m), _turns(own, m, roles, native)).otherwise(turns.cast(f"array<{TURN}>"))
    return held.withColumn("mapping", name.cast("string")).withColumn("turns", turns.cast(f"array<{TURN}>")).drop("__fingerprint")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("["), F.lit("[\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def formatted(turns: Column) -> Column:
    mark = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, mark), "")


def loss_mask(turns: Column, learned: str = "assistant") -> Column:
    """array<struct<start, length>>: code points of the formatted string that loss is taken on."""
    size = lambda t: F.length(escape(t["role"])) + F.length(escape(t["text"])) + (len(OPEN) + len(MIDDLE) + len(CLOSE))
    span = lambda at, t: F.struct((at + len(OPEN) + F.length(escape(t["role"])) + len(MIDDLE)).alias("start"), F.length(escape(t["text"])).alias("length"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, t: F.struct((a["at"] + size(t)).alias("at"), F.when(t["role"] == learned, F.concat(a["spans"], F.array(span(a["at"], t)))).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(turns, start, step)["spans"]


def read_turns(text: Column) -> Column:
    """The turns that a formatted string holds."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    return F.transform(
        F.transform(parts, body),
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(1), _at(p) - 1)).alias("role"),
            unescape(F.substring(p, _at(p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def _at(p: Column) -> Column:
    return F.position(F.lit(MIDDLE), p)


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds `mapping`, `formatted` and `loss_mask` to records of any known layout."""
    held = canonical(records, record, mappings)
    return held.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns"))).drop("turns")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows (conv_id, turn, role, text) of a conversation as one record, a struct."""
    turn = F.struct("turn", "role", "text")
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("content")))
    return gathered.select("conv_id", F.struct(messages.alias("messages")).alias("record"))
