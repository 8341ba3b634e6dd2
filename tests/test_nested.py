import random

from pyspark.sql import functions as F

from hopmill.functions import strings

KIND = "fact_id string, n int, docs array<struct<title string, relation struct<text string>, parts array<string>>>, notes map<string,string>"
MAPPING = {"ab": "X", "abc": "", "b": "bb", "": "never"}


def _swap(text, path, log):
    out, at = "", 0
    keys = sorted(filter(None, MAPPING), key=len, reverse=True)
    while at < len(text):
        k = next((k for k in keys if text.startswith(k, at)), None)
        if k:
            log.append((path, at, at + len(k), k, MAPPING[k]))
        out, at = out + (MAPPING[k] if k else text[at]), at + (len(k) if k else 1)
    return out


def _plain(value, path, log):
    if isinstance(value, str):
        return _swap(value, path, log)
    if isinstance(value, dict):
        return {k: v if k in strings.STRUCTURAL else _plain(v, f"{path}/{k}", log) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v, f"{path}/{i}", log) for i, v in enumerate(value)]
    return value


def test_nested_values_are_replaced_as_by_recursion(spark):
    rnd = random.Random(4)
    text = lambda: None if rnd.random() < 0.15 else "".join(rnd.choice("abc.\n") for _ in range(rnd.randint(0, 12)))
    doc = lambda: None if rnd.random() < 0.1 else {"title": text(), "relation": {"text": text()}, "parts": None if rnd.random() < 0.2 else [text() for _ in range(rnd.randint(0, 3))]}
    rows = [{"fact_id": text(), "n": i, "docs": [doc() for _ in range(rnd.randint(0, 3))], "notes": {"label": text(), "k": text()} if i % 3 else None} for i in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(60, None)], f"i int, v struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _top(KIND))}>")
    mapping = F.create_map(*(F.lit(x) for kv in MAPPING.items() for x in kv))
    got = {r.i: r.r.asDict(True) for r in df.select("i", strings.replace_nested(F.col("v"), df.schema["v"].dataType, mapping).alias("r")).collect()}
    for i, row in enumerate(rows):
        log = []
        assert got[i]["value"] == _plain(row, "", log)
        assert sorted(tuple(c.values()) for c in got[i]["changes"]) == sorted(log)
    assert got[60] == {"value": None, "changes": []}
    assert any(got[i]["changes"] for i in range(60))


def _top(kind):
    """The parts of a list of fields between commas outside brackets."""
    depth, out = 0, [""]
    for c in kind:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
