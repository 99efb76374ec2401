"""Chat formatting: schema fingerprints select declarative mappings to canonical turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code letters that stand for the first character of a control string, and for the escape itself.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))


def fingerprint(record: Column) -> Column:
    """64-bit hash of a JSON record's nested field paths.

    Texts are emptied, and of equal flat objects in a row one stays, so that no parser's or variant's size limit
    is met. What is left is parsed to a variant; its schema string, with scalar types struck out, lists each
    field path once whatever the values, so records of one layout share one fingerprint.
    """
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    bare = F.regexp_replace(plain, r'"(?:([^"]*+)(?="\s*+:)|[^"]*+)"', '"$1"')
    bare = F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})\s*+,\s*+(?=\1)", "")
    shape = F.schema_of_variant(F.try_parse_json(bare))
    for scalar in (r"DECIMAL\(\d+,\d+\)", "VOID|STRING|BIGINT|DOUBLE|BOOLEAN|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID"):
        shape = F.regexp_replace(shape, rf"(?<=[ <]|^)(?:{scalar})(?=[,>]|$)", "_")
    return F.xxhash64(F.coalesce(shape, F.lit("")))


@dataclass(frozen=True)
class Mapping:
    """One layout: a sample record (which fixes its fingerprint) and the SQL expression that makes
    ARRAY<STRUCT<role, text>> of `r`, the record as read with `schema`."""

    name: str
    sample: str
    schema: str
    turns: str


_TURN = "struct(coalesce({r}, 'user') as role, coalesce({t}, '') as text)"
#: Layouts known from public instruction and chat data sets.
MAPPINGS = (
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', "messages array<struct<role string, content string>>", f"transform(r.messages, m -> {_TURN.format(r='m.role', t='m.content')})"),
    Mapping("turns", '{"turns": [{"role": "", "text": ""}]}', "turns array<struct<role string, text string>>", f"transform(r.turns, m -> {_TURN.format(r='m.role', t='m.text')})"),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', "conversations array<struct<`from` string, value string>>", f"transform(r.conversations, m -> {_TURN.format(r='''case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end''', t='m.value')})"),
    Mapping("instruction", '{"instruction": "", "input": "", "output": ""}', "instruction string, input string, output string", f"array({_TURN.format(r=chr(39) + 'user' + chr(39), t='concat_ws(chr(10), r.instruction, nullif(r.input, ' + chr(39) * 2 + '))')}, {_TURN.format(r=chr(39) + 'assistant' + chr(39), t='r.output')})"),
    Mapping("prompt", '{"prompt": "", "completion": ""}', "prompt string, completion string", f"array({_TURN.format(r=chr(39) + 'user' + chr(39), t='r.prompt')}, {_TURN.format(r=chr(39) + 'assistant' + chr(39), t='r.completion')})"),
    Mapping("question", '{"question": "", "answer": ""}', "question string, answer string", f"array({_TURN.format(r=chr(39) + 'user' + chr(39), t='r.question')}, {_TURN.format(r=chr(39) + 'assistant' + chr(39), t='r.answer')})"),
)


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds `layout` and `turns` ARRAY<STRUCT<role, text>>, chosen by the record's fingerprint.

    Records whose fingerprint no mapping has (unknown layouts, broken JSON, nulls) get nulls in both,
    and so are kept for another mapping. Null roles become 'user', null texts the empty text.
    """
    known = records.sparkSession.createDataFrame([(m.name, m.sample) for m in mappings], "n string, s string")
    marks = {r["n"]: r["f"] for r in known.select("n", fingerprint(F.col("s")).alias("f")).collect()}
    out = records.withColumn("__f", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        read = f"from_json(`{record}`, '{m.schema}, __bad string', map('columnNameOfCorruptRecord', '__bad', 'maxStringLen', '{2**31 - 1}'))"
        here = F.col("__f") == F.lit(marks[m.name])
        layout = F.when(here, F.lit(m.name)).otherwise(layout)
        turns = F.when(here, F.expr(f"get(transform(filter(array({read}), r -> r.__bad is null), r -> {m.turns}), 0)")).otherwise(turns)
    return out.withColumn("turns", turns).withColumn("layout", F.when(F.col("turns").isNotNull(), layout)).drop("__f")


@dataclass(frozen=True)
class Template:
    """A turn is start + role + mid + text + end; texts and roles are escaped, so neither marker nor any
    other string that starts with < or [ can occur in them."""

    start: str = "<|im_start|>"
    mid: str = "\n"
    end: str = "<|im_end|>\n"
    loss_role: str = "assistant"

    def escape(self, text: Column, role: bool = False) -> Column:
        for raw, code in ESCAPES if role else ESCAPES[:3]:
            text = F.replace(text, F.lit(raw), F.lit(code))
        return text

    def unescape(self, text: Column, role: bool = False) -> Column:
        for raw, code in reversed(ESCAPES if role else ESCAPES[:3]):
            text = F.replace(text, F.lit(code), F.lit(raw))
        return text

    def format(self, turns: Column) -> Column:
        one = lambda t: F.concat(F.lit(self.start), self.escape(t["role"], True), F.lit(self.mid), self.escape(t["text"]), F.lit(self.end))
        return F.array_join(F.transform(turns, one), "")

    def spans(self, turns: Column) -> Column:
        """The loss mask: (start, length) in code points of each `loss_role` text in the formatted string."""
        head = len(self.start) + len(self.mid)
        sizes = F.transform(turns, lambda t: F.struct((F.char_length(self.escape(t["role"], True)) + head).cast("long").alias("h"), F.char_length(self.escape(t["text"])).cast("long").alias("n"), (t["role"] == self.loss_role).alias("on")))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("got"))

        def step(s: Column, x: Column) -> Column:
            here = F.array(F.struct((s["at"] + x["h"]).alias("start"), x["n"].alias("length")))
            return F.struct((s["at"] + x["h"] + x["n"] + len(self.end)).alias("at"), F.when(x["on"], F.concat(s["got"], here)).otherwise(s["got"]).alias("got"))

        return F.aggregate(sizes, zero, step, lambda s: s["got"])

    def parse(self, formatted: Column) -> Column:
        """The turns back from a formatted string."""
        pieces = F.filter(F.split(formatted, "\\Q" + self.start + "\\E"), lambda p: p != "")
        strip = lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(self.end))
        return F.transform(pieces, lambda p: F.struct(
            self.unescape(F.substring_index(p, self.mid, 1), True).alias("role"),
            self.unescape(F.substring(strip(p), F.char_length(F.substring_index(p, self.mid, 1)) + 1 + len(self.mid), F.char_length(p))).alias("text"),
        ))

    def masked(self, formatted: Column, spans: Column) -> Column:
        """All text under the loss mask, unescaped, in order, nothing between."""
        return F.array_join(F.transform(spans, lambda s: self.unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def nest_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to one JSON record a conversation, in order of turn, then role, then text.

    A conversation is one value (its digest needs all of it in order), so its size is bounded by what a
    string holds: 2**31 - 1 bytes of JSON; beyond that the job fails, rather than lose a turn. Nulls: turn sorts first,
    role becomes '', text becomes ''; a null id is one conversation. Equal rows are turns each. An empty table gives
    no records; other columns are ignored, whatever their names.
    """
    part = F.struct(F.col(turn).alias("k"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.to_json(F.struct(turns.alias("turns"))).alias("record"))


def format_chats(records: DataFrame, template: Template = Template()) -> DataFrame:
    """`formatted` and `loss_mask` for each record with known layout (see canonical_turns); records without one
    keep their row, with nulls. Other columns stay, but for `turns` and `record`; an empty table gives no rows."""
    out = canonical_turns(records)
    return out.withColumn("formatted", template.format(F.col("turns"))).withColumn("loss_mask", template.spans(F.col("turns"))).drop("turns", "record")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read back from `formatted` and `loss_mask` alone: counts and SHA-256 digests. A record without layout
    keeps its conv_id, with nulls; an empty table gives no rows."""
    out = formatted.withColumn("__turns", template.parse(F.col("formatted"))).withColumn("__loss", template.masked(F.col("formatted"), F.col("loss_mask")))
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )
