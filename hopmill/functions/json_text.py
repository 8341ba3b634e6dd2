"""JSON helpers that built-in functions lack: canonical digests, validity modes, hidden fields, closing-bracket repair.

Each is an Arrow function over a whole column; a row is parsed once, and nothing is kept between rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS, MOST_EDITS = 200_000, 100


def _mapped(kind: str, arrow: pa.DataType, of: Callable[[str], object]) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else of(v) for v in batch.to_pylist()], arrow)

    return mapped


def canonical_digest(text: Column, spaced: bool = False) -> Column:
    """sha256 of the JSON value with sorted keys, without spaces (or with the usual ones); null for null and for text that is not JSON."""

    def of(v: str) -> str | None:
        try:
            value = json.loads(v)
        except ValueError:
            return None
        return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=None if spaced else (",", ":")).encode()).hexdigest()

    return _mapped("string", pa.string(), of)(text)


def _strict(v: str) -> bool:
    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(v, object_pairs_hook=pairs, parse_constant=refuse)
    except ValueError:
        return False
    return True


def _lenient(v: str) -> bool:
    try:
        json.loads(v)
    except ValueError:
        return False
    return True


def is_json(text: Column, strict: bool = False) -> Column:
    """Whether the text is one JSON value. strict refuses repeated keys, NaN and infinities. Null for null."""
    return _mapped("boolean", pa.bool_(), _strict if strict else _lenient)(text)


def forbidden_paths(text: Column, names: list[str]) -> Column:
    """Paths of all keys of those names at any depth, sorted; [] steps into a list. Empty for text that is not JSON."""
    wanted = set(names)

    def of(v: str) -> list[str]:
        try:
            todo = [("$", json.loads(v))]
        except ValueError:
            return []
        out = set()
        while todo:
            at, value = todo.pop()
            if isinstance(value, dict):
                out |= {f"{at}.{k}" for k in value if k in wanted}
                todo += [(f"{at}.{k}", x) for k, x in value.items()]
            elif isinstance(value, list):
                todo += [(f"{at}[]", x) for x in value]
        return sorted(out)

    return _mapped("array<string>", pa.list_(pa.string()), of)(text)


#: A whole string, or a bracket outside of strings.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.DOTALL)


def _repaired(v: str) -> dict | None:
    if _lenient(v):
        return {"text": v, "edits": []}
    if len(v) > MOST_CHARACTERS or '"' in TOKEN.sub("", v):
        return None
    owed = ""  # closers of what is open, the innermost first
    edits = []
    for token in TOKEN.finditer(v):
        if token[0] in "{[":
            owed = ("}" if token[0] == "{" else "]") + owed
        elif token[0] in "}]":
            missing, found, owed = owed.partition(token[0])
            if not found:
                return None
            edits += [{"before": token.start(), "inserted": c} for c in missing]
    edits += [{"before": len(v), "inserted": c} for c in owed]
    cuts = [0, *(e["before"] for e in edits), len(v)]
    pieces = [v[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    text = "".join(p + e["inserted"] for p, e in zip(pieces, edits, strict=False)) + pieces[-1]
    return {"text": text, "edits": edits} if len(edits) <= MOST_EDITS and _lenient(text) else None


def close_brackets(text: Column) -> Column:
    """struct(text, edits of before and inserted): the text with its missing ] and } put in; null where that gives no JSON.

    Refused: open strings, closers that match nothing, more than MOST_EDITS insertions or MOST_CHARACTERS characters.
    """
    edit = pa.struct([("before", pa.int32()), ("inserted", pa.string())])
    return _mapped("struct<text string, edits array<struct<before int, inserted string>>>", pa.struct([("text", pa.string()), ("edits", pa.list_(edit))]), _repaired)(text)
