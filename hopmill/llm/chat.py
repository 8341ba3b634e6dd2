"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns; a template with reversible escapes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout by its field paths, and how it becomes turns.

    fields: (path in the record, role) in order, where a record holds one text per field; or, with each, the path of a
    list whose items hold the role at role_path and the text at text_path, roles being renamed by rename. Items (or, with
    no list, the record) may have the optional fields, too, some of them or all; they are not part of the turns.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role_path: str = ""
    text_path: str = ""
    optional: tuple[str, ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


#: Field paths in code point order; [] steps into a list.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), each="messages", role_path="role", text_path="content", optional=("name", "weight")),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), each="conversations", role_path="from", text_path="value", optional=("weight",), rename=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction-input", ("input", "instruction", "output"), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("system-instruction", ("instruction", "output", "system"), fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
)


def _shapes(m: Mapping) -> list[str]:
    """The schema texts of records in this layout, types left out; a record's own is brought to the same form. One for each choice of optional fields."""
    shapes = []
    for more in chain.from_iterable(combinations(m.optional, n) for n in range(len(m.optional) + 1)):
        names = sorted([p.split("[].")[-1] for p in m.paths] + list(more))
        inner = f"OBJECT<{','.join(f'{p}:_' for p in names)}>"
        shapes.append(f"OBJECT<{m.each}:ARRAY<{inner}>>" if m.each else inner)
    return shapes


def fingerprint(record: Column) -> Column:
    """64-bit hash (long) of a variant record's nested field names and list levels, without the types of its values.

    A field that has different types in a list, and so the type variant, is a field like others.

    Variant objects keep their fields sorted, so the order of fields in the source does not matter. Null for null.
    """
    shape = F.regexp_replace(F.schema_of_variant(record), r"\s+", "")
    return F.xxhash64(F.regexp_replace(shape, r":[A-Z_]+(?:\(\d+,\d+\))?(?=[,>])", ":_"))


def _turns(record: Column, m: Mapping) -> Column:
    if m.each:
        items = F.try_variant_get(record, f"$.{m.each}", f"array<struct<`{m.role_path}`: string, `{m.text_path}`: string>>")
        role = lambda x: F.coalesce(x[m.role_path], F.lit(""))
        named = lambda x: F.create_map(*(F.lit(v) for pair in m.rename for v in pair))[role(x)]
        return F.transform(items, lambda x: F.struct((F.coalesce(named(x), role(x)) if m.rename else role(x)).alias("role"), F.coalesce(x[m.text_path], F.lit("")).alias("text")))
    return F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text")) for path, role in m.fields))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout (string) and turns (array of role and text), from a variant column of mixed layouts.

    The record's fingerprint is compared with those of the mappings; the one that fits is applied. Null texts and roles
    become empty; numbers and truth values in their place are spelled out. A record that no mapping fits, or a null one, keeps layout and turns null: no row is dropped. An empty
    list of messages has no fields to tell it by and counts as unknown. Columns named like the new ones are replaced.
    """
    rows = records.drop("layout", "turns").withColumn("_print", fingerprint(F.col(record)))
    layout = turns = None
    for m in mappings:
        fits = F.col("_print").isin(*(F.xxhash64(F.lit(x)) for x in _shapes(m)))
        layout = F.when(fits, m.name) if layout is None else layout.when(fits, m.name)
        turns = F.when(fits, _turns(F.col(record), m).cast(TURNS)) if turns is None else turns.when(fits, _turns(F.col(record), m).cast(TURNS))
    return rows.withColumns({"layout": layout, "turns": turns}).drop("_print")


def escape(text: Column) -> Column:
    r"""Backslashes doubled, then a backslash between every < and |: no control string is left in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""Undo escape: one backslash between < and | stands only where escape put it, since those of the text are in pairs."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<|", "<%7C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("<|", "<%7C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render(turns: Column) -> Column:
    """The formatted text of the turns: each is BEGIN, role, line feed, text, END, line feed."""
    one = lambda t: F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def _bodies(formatted: Column) -> Column:
    """What stands between BEGIN and END of each turn, still escaped. Escaped texts hold no BEGIN."""
    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.left(p, F.length(p) - len(END) - 1))


def parse(formatted: Column) -> Column:
    """The turns, read back from a formatted text."""
    body = lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text"))
    return F.transform(_bodies(formatted), body)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Array of (start, length) in code points of formatted: the escaped text of each turn of the role, nothing of its frame."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        head = len(BEGIN) + F.instr(p, F.lit("\n"))
        n = F.length(p) - F.instr(p, F.lit("\n"))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), n.cast("int").alias("length"))
        mine = F.substring_index(p, "\n", 1) == escape_role(F.lit(role))
        spans = F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + len(BEGIN) + F.length(p) + len(END) + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(_bodies(formatted), start, step, lambda acc: acc["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout, turns, formatted (string) and spans (array of start and length: what the loss is taken on).

    All work is in built-in expressions over one row at a time; there is no shuffle. Records of an unknown layout get
    nulls. Columns named like the new ones are replaced.
    """
    rows = canonical(records, record, mappings).drop("formatted", "spans")
    rows = rows.withColumn("formatted", render(F.col("turns")))
    return rows.withColumn("spans", loss_spans(F.col("formatted")))


def gather(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): the turns of each conversation, by turn (null first, ties by role and text), as one variant record.

    The record takes the plainest layout that holds it without loss: prompt and response, system, instruction and output,
    else messages. Null roles and texts become empty; a null key is a conversation of its own. A conversation is one
    value of the result, so its turns meet in one row; the rows of one conversation are what bounds that row.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    g = rows.groupBy(key).agg(turns.alias("_turns"))
    roles, content = F.array_join(F.transform("_turns", lambda x: F.to_json(F.struct(x["role"]))), ","), lambda i: F.get("_turns", F.lit(i))["content"]
    named = lambda *names: F.lit(",".join(f'{{"role":"{n}"}}' for n in names))
    record = (
        F.when(roles == named("user", "assistant"), F.to_variant_object(F.struct(content(0).alias("prompt"), content(1).alias("response"))))
        .when(roles == named("system", "user", "assistant"), F.to_variant_object(F.struct(content(0).alias("system"), content(1).alias("instruction"), content(2).alias("output"))))
        .otherwise(F.to_variant_object(F.struct(F.col("_turns").alias("messages"))))
    )
    return g.select(key, record.alias("record"))
