import json

from pyspark.sql import functions as F

from hopmill.functions import json_text as J
from hopmill.functions import strings as S
from hopmill.operators import text as T


def test_occurrences_overlap_and_count_code_points(spark):
    rows = [("aaaa", "aa"), ("😀x😀x", "x"), ("", "a"), ("abc", ""), (None, "a"), ("abc", None)]
    df = spark.createDataFrame(rows, "t string, n string")
    got = [r.s for r in df.select(S.occurrences(F.col("t"), F.col("n")).alias("s")).collect()]
    want = [[i for i in range(len(t or "")) if t and n and t.startswith(n, i)] for t, n in rows]
    assert got == want == [[0, 1, 2], [1, 3], [], [], [], []]


def test_segments_keep_every_character(spark):
    texts = ["他说：“好。”走了？！真的", "", "。。", "a\n\nb", "no end", "x,y。z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.segments(F.col("t"), T.SENTENCE_ENDS).alias("s")).collect():
        assert "".join(x.text for x in r.s) == r.t
        assert all(r.t[x.start : x.end] == x.text for x in r.s)
    first = df.where("i = 0").select(T.segments(F.col("t"), T.SENTENCE_ENDS).alias("s")).first().s
    assert [x.text for x in first] == ["他说：“好。”", "走了？！", "真的"]


def test_deletions(spark):
    units = spark.createDataFrame([("f", "u1", "abcdefgh"), ("f", "u2", "xyz"), ("f", "u3", "aXaX"), ("f", "u4", "q r"), ("g", "u1", "all"), ("h", "u1", "")], "family_id string, unit_id string, text string")
    cuts = spark.createDataFrame([("g", "u1", "all"), ("f", "u1", "bc"), ("f", "u1", "de"), ("f", "u2", "xyz"), ("f", "u3", "a"), ("f", "u4", "q"), ("f", "u4", "r")], "family_id string, unit_id string, quote string")
    rest, log, bad = T.delete_quotes(units, cuts, ["family_id", "unit_id"])
    assert {(r.family_id, r.unit_id): r.text for r in rest.collect()} == {("f", "u1"): "afgh", ("f", "u3"): "aXaX", ("f", "u4"): " ", ("h", "u1"): ""}
    assert {(r.unit_id, r.start, r.end, r.removed) for r in log.collect()} >= {("u1", 1, 5, "bcde"), ("u2", 0, 3, "xyz")}
    assert {(r.check, r.key) for r in bad.collect()} == {("quote_not_unique", "f/u3"), ("only_space_left", "f/u4"), ("all_units_lost", "g")}


def test_groups_survive_or_go_whole(spark):
    cites = spark.createDataFrame([("o", "c", "f", 1, 0, 3), ("o", "c", "f", 1, 10, 12), ("o", "c", "f", 2, 12, 14), ("o", "c", "g", 1, 4, 6)], "owner_id string, context_id string, fact_id string, group_no int, start int, `end` int")
    cuts = spark.createDataFrame([("o", "c", 3, 5), ("o", "c", 11, 12)], "owner_id string, context_id string, start int, `end` int")
    kept, status = T.surviving_groups(cites, cuts, ["owner_id", "context_id"], ["owner_id", "fact_id"])
    assert [(r.group_no, r.start, r.end) for r in kept.collect()] == [(2, 9, 11)]
    assert {r.fact_id: r.status for r in status.collect()} == {"f": "support_proposed", "g": "unresolved"}


def test_names(spark):
    e = spark.createDataFrame([("o", "1", "王氏（薛蟠之母）", ["姨妈"]), ("o", "2", "贾母", ["老太太"]), ("o", "3", "史氏", ["老太太"])], "owner_id string, entity_id string, name string, aliases array<string>")
    i = T.identity_index(T.surfaces(e))
    m = spark.createDataFrame([("o", x) for x in ("王氏(薛蟠之母)", "贾母（老太太）", "老太太", "贾母(史氏)", "谁")], "owner_id string, mention string")
    got = {r.mention: (r.status, r.entity_id) for r in T.resolve(m, i).collect()}
    assert got == {"王氏(薛蟠之母)": ("resolved", "1"), "贾母（老太太）": ("ambiguous", None), "老太太": ("ambiguous", None), "贾母(史氏)": ("conflicting", None), "谁": ("unresolved", None)}
    q = spark.createDataFrame([("贾母和姨妈。",), ("贾母来了",), ("",)], "q string")
    assert [r.x for r in q.select(S.identity_only(F.col("q"), F.array(F.lit("贾母"), F.lit("姨妈"))).alias("x")).collect()] == [True, False, False]


def test_replacement_replays(spark):
    df = spark.createDataFrame([("ab abc b",), ("",), (None,)], "t string")
    r = df.select("t", S.replace_all(F.col("t"), F.create_map(F.lit("ab"), F.lit("X"), F.lit("abc"), F.lit("YY"))).alias("r")).select("t", "r.*", S.replay(F.col("t"), F.col("r.changes")).alias("again")).collect()
    assert [(x.text, x.again) for x in r] == [("X YY b", "X YY b"), ("", ""), (None, None)]
    wrong = df.limit(1).select(S.replay(F.col("t"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("z").alias("before"), F.lit("q").alias("after")))).alias("x"))
    assert wrong.first().x is None


def test_json_helpers(spark):
    raw = ['{"b": 1, "a": [1, 2]}', '{"a":[1,2],"b":1}', '{"a": NaN}', '{"a":1,"a":2}', '{"a":1} x', "{", None, '{"a": {"gold": [{"key": 1}]}}', '[{"x": "]"}', '{"a": "', "]", '{"a": [1, 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    r = df.select("i", J.is_json(F.col("t")).alias("lenient"), J.is_json(F.col("t"), strict=True).alias("strict"), J.canonical_digest(F.col("t")).alias("d"), J.forbidden_paths(F.col("t"), ["gold", "key"]).alias("p"), J.close_brackets(F.col("t")).alias("c")).orderBy("i").collect()
    assert [x.lenient for x in r[:6]] == [True, True, True, True, False, False] and [x.strict for x in r[:6]] == [True, True, False, False, False, False]
    assert r[0].d == r[1].d and r[5].d is None and r[6].lenient is None
    assert r[7].p == ["$.a.gold", "$.a.gold[].key"]
    assert json.loads(r[8].c.text) == [{"x": "]"}] and [e.before for e in r[8].c.edits] == [len(raw[8])]
    assert r[9].c is None and r[10].c is None and json.loads(r[11].c.text) == {"a": [1, 2]}


def test_quotes_of_names_alone(spark):
    named = spark.createDataFrame([("o", "甲"), ("o", "甲乙"), ("o", "丙")], "owner_id string, surface string")
    cases = {"甲": True, "甲乙、丙": True, "甲和丙": True, "！？": False, "甲$丙": False, "甲之父丙": False, "": False, " 丙 ": True, "甲（丙）": True}
    rows = spark.createDataFrame([("o", q) for q in cases] + [("o", None), ("p", "甲")], "owner_id string, quote string")
    got = {(r.owner_id, r.quote): r.identity_only for r in T.identity_guard(rows, named).collect()}
    assert got == {("o", q): v for q, v in cases.items()} | {("o", None): False, ("p", "甲"): False}


def test_pure_surfaces_by_rule(spark):
    """贾母 holds the name 贾 of another and a word of kinship; 乙的次子 is described; an alias of another counts like a name."""
    rows = [("o", "1", "贾", True), ("o", "2", "贾母", True), ("o", "3", "乙的次子", False), ("o", "4", "老丙", False), ("o", "5", "老丙之妻", False), ("o", "6", "丁", True), ("o", "7", "丁", False), ("o", "8", "生平", True)]
    named = spark.createDataFrame(rows, "owner_id string, entity_id string, surface string, is_name boolean")
    assert {r.surface for r in T.pure_surfaces(named).collect()} == {"贾", "老丙", "生平"}


def test_marker_guards_keep_titles(spark):
    rows = [("政老爹的长女甲", ["甲"], ["政老爹"], "father"), ("甲见政老爹", ["甲"], ["政老爹"], "father"), ("丙生甲", ["甲"], ["丙"], "other"), ("甲与丙", ["甲"], ["丙"], "mother"), ("太太丙", ["甲"], ["丙"], "mother")]
    df = spark.createDataFrame(rows, "q string, c array<string>, p array<string>, r string")
    got = [tuple(r.m) for r in df.select(T.marker_guards(F.col("q"), F.col("c"), F.col("p"), F.col("r")).alias("m")).collect()]
    assert got == [(True, True, True, True), (True, True, False, False), (True, True, True, True), (True, True, False, False), (False, True, False, True)]


def test_segment_marks(spark):
    """Full and half-width stops, CR and LF together, closers after an end; an ideographic comma ends nothing."""
    one = lambda t, ends: [x.text for x in spark.createDataFrame([(t,)], "t string").select(T.segments(F.col("t"), ends).alias("s")).first().s]
    assert one("a.b．c\r\nd〉。〕e", T.SENTENCE_ENDS) == ["a.", "b．", "c\r\n", "d〉。〕", "e"]
    assert one("a、b，c；d：e", T.CLAUSE_ENDS) == ["a、b，", "c；", "d：", "e"]


def test_closing_brackets_rule(spark):
    cases = {'{"a": [1': '{"a": [1]}', '[{"a": "]"': '[{"a": "]"}]', '{"a": [1}': '{"a": [1]}', "]": None, '{"a": "x': None, '["\\""': '["\\""]', "{}": "{}", "[" * 101: None, '{"a"': None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c and r.c.text for r in df.select("t", J.close_brackets(F.col("t")).alias("c")).collect()} == cases
