"""String helpers that built-in functions lack: overlapping hits, NFKC surfaces, name guards, logged replacement."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Keys whose values are no names.
STRUCTURAL = ("relation", "fact_id", "quote_ids", "provenance", "label")
CHANGES = "array<struct<path string, start int, `end` int, before string, after string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, chunk: int = 256) -> Column:
    """Sums of an array up to each element. Chunks are summed by themselves and moved by the sums of those before, so no long array is copied for each element."""

    def sums(some: Column) -> Column:
        kind = "array<int>"
        step = lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))).cast(kind))
        return F.aggregate(some, F.array().cast(kind), step)

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda x: x + b - F.element_at(p, -1))))

    def cut(all_: Column) -> Column:
        firsts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(firsts, lambda i: sums(F.slice(all_, i, F.lit(chunk)))), joined)

    return let(numbers, cut)


def literally(text: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, needle: Column) -> Column:
    """Starts (code points from 0) of all occurrences, overlapping ones included; none for null or empty.

    The text is split before each occurrence, and lengths are summed up.
    """
    none = F.array().cast("array<int>")
    before = F.split(text, F.concat(F.lit("(?="), literally(needle), F.lit(")")), -1)
    ends = let(running(F.transform(before, F.length)), lambda e: F.slice(e, F.lit(1), F.size(e) - 1))
    return F.when(text.contains(needle) & (needle != ""), F.concat(F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(none), ends)).otherwise(none)


@F.arrow_udf(StringType())
def _surface(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if v is None else unicodedata.normalize("NFKC", v).strip() for v in batch.to_pylist()], pa.string())


def surface(name: Column) -> Column:
    """NFKC form without outer white space."""
    return _surface(name)


def only_spans(quote: Column, names: Column) -> Column:
    """Whether a quote in NFKC is only names, one at least, white space, punctuation and 和, 与, 及.

    names: array of (start, end), where registered names stand in it. Read from the left: the longest name that starts at a
    place counts before what may stand between names.
    """
    between = lambda a, b: F.regexp_like(F.substring(quote, a + 1, b - a), F.lit(r"\A(?U)[\s\p{P}和与及]*\z"))
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))
    each = F.array_sort(F.transform(names, lambda n: F.struct(n["start"].alias("start"), (-n["end"]).alias("end"))))
    step = lambda s, n: F.when(n["start"] < s["at"], s).otherwise(F.struct((-n["end"]).alias("at"), (s["ok"] & between(s["at"], n["start"])).alias("ok")))
    return (F.size(names) > 0) & F.aggregate(each, start, step, lambda s: s["ok"] & between(s["at"], F.length(quote)))


def identity_only(quote: Column, names: Column) -> Column:
    """only_spans of a quote in NFKC and a short array of names; for many names see operators.text.identity_guard."""
    at = lambda n: F.transform(occurrences(quote, n), lambda s: F.struct(s.alias("start"), (s + F.length(n)).alias("end")))
    return only_spans(quote, F.flatten(F.transform(names, at)))


def replace_all(text: Column, mapping: Column) -> Column:
    """struct(text, changes): the keys of a map replaced at once, from the left, the longest key at a place first; changes log source offsets.

    The text is taken apart at the keys, and keys and what stands between are put together again. Empty keys count for nothing.
    """
    keys = F.array_sort(F.transform(F.filter(F.map_keys(mapping), lambda k: k != ""), lambda k: F.struct((-F.length(k)).alias("less"), k.alias("key"))))
    change = lambda k, end: F.struct((end - F.length(k)).cast("int").alias("start"), end.cast("int").alias("end"), k.alias("before"), F.element_at(mapping, k).alias("after"))

    def swapped(p: Column) -> Column:
        def of(found: Column) -> Column:
            rest = F.split(text, p, -1)
            lengths = F.zip_with(found, F.slice(rest, F.lit(1), F.size(found)), lambda k, r: F.length(k) + F.length(r))
            new = F.array_join(F.zip_with(rest, found, lambda r, k: F.concat(r, F.coalesce(F.element_at(mapping, k), F.lit("")))), "")
            return F.struct(new.alias("text"), F.zip_with(found, running(lengths), change).alias("changes"))

        return let(F.regexp_extract_all(text, p, F.lit(0)), of)

    pattern = F.array_join(F.transform(keys, lambda k: literally(k["key"])), "|")
    none = F.struct(text.alias("text"), F.array().cast("array<struct<start int, `end` int, before string, after string>>").alias("changes"))
    return F.when(text.isNotNull(), F.when(F.size(keys) > 0, let(pattern, swapped)).otherwise(none))


def _tree(value: Column, kind: DataType, keep: tuple[str, ...], swap: Callable[[Column], Column]) -> Column:
    """value with swap(text) in the place of each text; under a key of keep texts stay, with no changes."""
    plain = lambda t: F.when(t.isNotNull(), F.struct(t.alias("text"), F.array().cast("array<struct<start int, `end` int, before string, after string>>").alias("changes")))
    if isinstance(kind, StringType):
        return swap(value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_tree(value.getField(f.name), f.dataType, keep, plain if f.name in keep else swap).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _tree(x, kind.elementType, keep, swap))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, x: F.when(k.cast("string").isin(*keep), _tree(x, kind.valueType, keep, plain)).otherwise(_tree(x, kind.valueType, keep, swap)))
    return value


def _texts(tree: Column, kind: DataType) -> Column:
    """The value of a tree, with its new texts."""
    if isinstance(kind, StringType):
        return tree.getField("text")
    if isinstance(kind, StructType):
        return F.when(tree.isNotNull(), F.struct(*(_texts(tree.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(tree, lambda x: _texts(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(tree, lambda _, x: _texts(x, kind.valueType))
    return tree


def _log(tree: Column, kind: DataType, path: Column) -> Column:
    """The changes of a tree, each with its path."""
    none = F.array().cast(CHANGES)
    below = lambda name: F.concat(path, F.lit("/"), name.cast("string"))
    if isinstance(kind, StringType):
        return F.coalesce(F.transform(tree.getField("changes"), lambda c: F.struct(path.alias("path"), *(c.getField(n).alias(n) for n in ("start", "end", "before", "after")))), none)
    if isinstance(kind, StructType):
        return F.concat(none, *(_log(tree.getField(f.name), f.dataType, below(F.lit(f.name))) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(tree, lambda x, i: _log(x, kind.elementType, below(i)))), none)
    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(tree), lambda e: _log(e.getField("value"), kind.valueType, below(e.getField("key"))))), none)
    return none


def replace_nested(value: Column, kind: DataType, mapping: Column, keep: tuple[str, ...] = STRUCTURAL) -> Column:
    """struct(value, changes): replace_all in every text of a nested value of that type, but for what lies under a key of keep.

    Structs, arrays and maps keep their shape, nulls stay null; map keys, numbers and the like stay as they are. changes
    log offsets in the source text at each path, such as /documents/0/text. The expression follows the type, so nothing
    is taken apart into rows.
    """
    return let(_tree(value, kind, keep, lambda t: replace_all(t, mapping)), lambda t: F.struct(_texts(t, kind).alias("value"), _log(t, kind, F.lit("")).alias("changes")))


def replay(text: Column, changes: Column) -> Column:
    """The text with a log of changes (by start, not overlapping) applied; null where a logged `before` is not there."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        there = F.substring(text, c["start"] + 1, c["end"] - c["start"]) == c["before"]
        kept = F.substring(text, acc["at"] + 1, c["start"] - acc["at"])
        return F.struct(c["end"].alias("at"), F.concat(acc["out"], kept, c["after"]).alias("out"), (acc["ok"] & there).alias("ok"))

    return F.aggregate(changes, start, step, lambda acc: F.when(acc["ok"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
