"""Text-evidence queries on the driver's tables, and their SQL. A document is the only context of its own owner."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.functions import strings
from hopmill.operators import text as T
from hopmill.plans.bindings import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner_id"), F.col("doc_id").alias("unit_id"), F.lower("text").alias("text"))


def _quotes(spark, sf_dir):
    """Two quotes of each document: characters 11 to 30, and the same with a sign that no text has."""
    q = F.substring("text", 11, 20)
    return _docs(spark, sf_dir).select("owner_id", "unit_id", F.explode(F.array(F.struct(F.lit(1).alias("group_no"), q.alias("quote")), F.struct(F.lit(2).alias("group_no"), F.concat(q, F.lit("☃")).alias("quote")))).alias("_q")).select("owner_id", "unit_id", F.lit("f").alias("fact_id"), "_q.*")


def t01_located(spark, sf_dir):
    return T.quote_located(_quotes(spark, sf_dir), _docs(spark, sf_dir), ["owner_id", "unit_id"]).select("owner_id", "group_no", "located")


def t02_occurrences(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("needle", F.lit("the"))
    return T.all_hits(rows, "text", "needle").select("owner_id", "hit_no", "start", "end")


def t03_unique(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("needle", F.substring("text", 21, 6))
    return T.located_once(rows, "text", "needle").select("owner_id", "start", T.count_apart(F.col("text"), F.col("needle")).alias("apart"))


def t04_sole(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("context_id"), "text")
    q = c.where("context_id = 0").select("owner_id", F.lit(1).alias("quote_id"), F.col("text").alias("quote"))
    return T.sole_context(q, c, "owner_id", "quote_id", "context_id")


def t05_citations(spark, sf_dir):
    n = F.col("owner_id") % 3
    rows = _docs(spark, sf_dir).withColumns({"start": F.when(n == 0, 10).otherwise(5), "end": F.when(n == 1, 10).otherwise(30), "quote": F.substring("text", 11, 20)})
    return rows.select("owner_id", T.citation_valid(F.col("text"), F.col("start"), F.col("end"), F.col("quote")).alias("valid"))


def t06_overlap(spark, sf_dir):
    hits = lambda w: T.all_hits(_docs(spark, sf_dir).withColumn("needle", F.lit(w)), "text", "needle").select("owner_id", "start", "end")
    return T.overlapping(hits("the"), hits("hen"), ["owner_id"])


def t07_segments(spark, sf_dir):
    s = F.explode(T.segments(F.col("text"), T.SENTENCE_ENDS)).alias("s")
    return _docs(spark, sf_dir).select("owner_id", s).select("owner_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def t07_catalog(spark, sf_dir):
    return T.span_catalog(_docs(spark, sf_dir), ["owner_id"]).groupBy("owner_id").agg(F.count("*").alias("spans"), F.count_if(F.col("levels") == "clause,sentence").alias("both"), F.sum(F.when(F.col("levels").contains("sentence"), F.length("quote")).otherwise(0)).alias("characters"))


def t08_windows(spark, sf_dir):
    ctx = _docs(spark, sf_dir).withColumnRenamed("unit_id", "context_id")
    edges = ctx.select("owner_id", F.lit("e").alias("edge_id"), F.lit("x").alias("child"))
    named = ctx.select("owner_id", F.lit("x").alias("entity_id"), F.explode(F.array(F.lit("tion"), F.lit("ation"))).alias("surface"))
    return T.hit_windows(edges, named, ctx).select("owner_id", "start", "end", "matched_surface")


def _entities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("owner_id"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat("p_brand", F.lit(" ")), "p_type").alias("aliases"))


def t09_index(spark, sf_dir):
    i = T.identity_index(T.surfaces(_entities(spark, sf_dir)))
    return i.select("owner_id", "surface", F.size("owners").alias("owners"), "entity_id")


def t10_resolve(spark, sf_dir):
    e = _entities(spark, sf_dir)
    mention = F.element_at(F.array(F.col("name"), F.concat("name", F.lit("("), F.col("aliases")[0], F.lit(")")), F.lit("nobody"), F.concat("name", F.lit("（"), "name", F.lit("）"))), (F.col("entity_id") % 4 + 1).cast("int"))
    return T.resolve(e.select("owner_id", F.col("entity_id").alias("asked"), mention.alias("mention")), T.identity_index(T.surfaces(e))).select("owner_id", "asked", "status", "entity_id")


def t11_pure(spark, sf_dir):
    """Surfaces of customers: their name, and of some the name of another customer of the nation with a word behind it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("entity_id"), "c_name", "c_mktsegment")
    first = c.groupBy("owner_id").agg(F.min("c_name").alias("_f"))
    rows = c.join(first, "owner_id").select("owner_id", "entity_id", F.explode(F.array(F.struct(F.col("c_name").alias("surface"), F.lit(True).alias("is_name")), F.struct(F.concat("_f", F.when(F.col("entity_id") % 2 == 0, " kin ").otherwise(" of "), F.col("entity_id") % 40).alias("surface"), F.lit(False).alias("is_name")))).alias("_s")).select("owner_id", "entity_id", "_s.*")
    return T.pure_surfaces(rows, kin="kin").select("owner_id", "entity_id", "surface")


def t21_defects(spark, sf_dir):
    """A document's fact: its endpoints are two of its first words; some have an unknown parent, some are their own parent."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner_id"), F.col("doc_id").alias("unit_id"), "text")
    n = F.col("owner_id") % 4
    facts = d.select("owner_id", F.lit("f").alias("fact_id"), F.when(n == 1, "zz").when(n == 2, "b").otherwise("a").alias("parent"), F.lit("b").alias("child"))
    entities = d.select("owner_id", F.explode(F.array(F.struct(F.lit("a").alias("entity_id"), F.substring("text", 21, 10).alias("name")), F.struct(F.lit("b").alias("entity_id"), F.substring("text", 101, 10).alias("name")))).alias("_e")).select("owner_id", "_e.*", F.array().cast("array<string>").alias("aliases"))
    quote = F.when(n == 3, F.lit("☃")).otherwise(F.substring("text", 11, 120))
    evidence = d.select("owner_id", F.lit("f").alias("fact_id"), F.lit(1).alias("group_no"), "unit_id", quote.alias("quote"))
    return T.evidence_defects(facts, entities, evidence, d).groupBy("check").agg(F.count("*").alias("facts"))


def t12_display(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("context_id"), F.lower("text").alias("text"))
    e = c.select("owner_id").distinct().select("owner_id", F.lit("x").alias("entity_id"), F.lit("thes the").alias("name"), F.array(F.lit("and"), F.lit("tion"), F.lit("ment")).alias("aliases"))
    return T.display_surface(T.surfaces(e), c)


def t13_visible(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("context_id"), F.lower("text").alias("text"))
    e = c.select("owner_id").distinct().select("owner_id", F.lit("x").alias("entity_id"), F.lit("thes the").alias("name"), F.array(F.lit("and"), F.lit("tion"), F.lit("ment")).alias("aliases"))
    return T.visible_aliases(T.surfaces(e), c, least=2).select("owner_id", "context_id", F.array_join("surfaces", ",").alias("surfaces"))


def t16_markers(spark, sf_dir):
    role = F.when(F.col("owner_id") % 3 == 0, "father").when(F.col("owner_id") % 3 == 1, "mother").otherwise("parent")
    m = T.marker_guards(F.col("text"), F.array(F.lit("then"), F.lit("")), F.array(F.lit("the"), F.lit("tion")), role, "ship|ring", {"father": "ou|ment", "mother": "zz|ght"}, "ness")
    return _docs(spark, sf_dir).select("owner_id", m.alias("m")).select("owner_id", "m.*")


def t14_names(spark, sf_dir):
    """Quotes of parts: the name; two names and a mark; marks alone; a symbol between names; a word that is no name."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("owner_id"), "p_partkey", F.col("p_name").alias("surface"))
    n = F.col("p_partkey") % 5
    quote = F.when(n == 0, F.col("surface")).when(n == 1, F.concat("surface", F.lit("，"), "surface", F.lit("!"))).when(n == 2, F.lit("?!")).when(n == 3, F.concat("surface", F.lit("$"), "surface")).otherwise(F.concat("surface", F.lit(" begat")))
    return T.identity_guard(p.withColumn("quote", quote), p).select("p_partkey", "identity_only")


def t15_shortcuts(spark, sf_dir):
    ctx = _docs(spark, sf_dir).withColumnRenamed("unit_id", "context_id")
    starts = ctx.select("owner_id", F.col("owner_id").alias("query_id"), F.lit("the").alias("start_name"), F.when(F.col("owner_id") % 2 == 0, "a").otherwise("b").alias("roles"))
    terms = spark.createDataFrame([("a", "and"), ("a", "er"), ("b", "ion")], "roles string, term string")
    found = T.shortcut_candidates(ctx, starts, terms, gap=20)
    return found.select("query_id", "term", F.sha2("sentence", 256).alias("sha256"))


def t23_replayed(spark, sf_dir):
    """A logged change of each text; of every third the log names what is not there."""
    before = F.when(F.col("owner_id") % 3 == 0, F.lit("☃☃☃☃")).otherwise(F.substring("text", 11, 4))
    change = F.array(F.struct(F.lit(10).alias("start"), F.lit(14).alias("end"), before.alias("before"), F.lit("<x>").alias("after")))
    return _docs(spark, sf_dir).select("owner_id", F.sha2(strings.replay(F.col("text"), change), 256).alias("sha256"))


def _cuts(spark, sf_dir):
    start = F.col("owner_id") % 7
    return _docs(spark, sf_dir).where("length(text) > 60").select("owner_id", "unit_id", F.explode(F.array(F.struct(start.cast("int").alias("start"), (start + 10).cast("int").alias("end")), F.struct((start + 10).cast("int").alias("start"), (start + 15).cast("int").alias("end")), F.struct((start + 30).cast("int").alias("start"), (start + 40).cast("int").alias("end")))).alias("_c"), "text").select("owner_id", "unit_id", "_c.start", "_c.end", F.substring(F.col("text"), F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")).alias("quote"))


def t17_deleted(spark, sf_dir):
    units = _docs(spark, sf_dir)
    cuts = _cuts(spark, sf_dir).where("start < 10").select("owner_id", "unit_id", "quote")
    rest, _, _ = T.delete_quotes(units, cuts, ["owner_id", "unit_id"])
    return rest.select("owner_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("characters"))


def t18_cut(spark, sf_dir):
    after, _ = T.delete_spans(_docs(spark, sf_dir), _cuts(spark, sf_dir), ["owner_id", "unit_id"])
    return after.select("owner_id", F.sha2("text", 256).alias("sha256"))


def t19_survivors(spark, sf_dir):
    cites = _docs(spark, sf_dir).select("owner_id", "unit_id", F.lit("f").alias("fact_id"), F.explode(F.array(*(F.struct(F.lit(g).alias("group_no"), F.lit(a).alias("start"), F.lit(b).alias("end")) for g, a, b in ((1, 20, 24), (1, 50, 55), (2, 5, 8), (3, 45, 60))))).alias("_c")).select("owner_id", "unit_id", "fact_id", "_c.*")
    kept, _ = T.surviving_groups(cites, _cuts(spark, sf_dir), ["owner_id", "unit_id"], ["owner_id", "fact_id"])
    return kept.select("owner_id", "group_no", "start", "end")


def t20_active(spark, sf_dir):
    return T.active_facts(_quotes(spark, sf_dir), _docs(spark, sf_dir))


def t22_replaced(spark, sf_dir):
    mapping = F.create_map(F.lit("the"), F.lit("<1>"), F.lit("then"), F.lit("<2>"), F.lit("tion"), F.lit(""))
    r = strings.replace_all(F.col("text"), mapping)
    rows = _docs(spark, sf_dir).select("owner_id", "text", r.alias("r"))
    return rows.select("owner_id", F.sha2("r.text", 256).alias("sha256"), F.size("r.changes").alias("changes"), (strings.replay(F.col("text"), F.col("r.changes")) == F.col("r.text")).alias("replays"))


def t22_nested(spark, sf_dir):
    """Documents as nested values: lines, a structural field, and notes under a structural and another key."""
    mapping = F.create_map(F.lit("the"), F.lit("<1>"), F.lit("then"), F.lit("<2>"), F.lit("tion"), F.lit(""))
    source = F.concat(F.lit("then "), F.coalesce("source", F.lit("")))
    tree = F.struct(source.alias("fact_id"), F.split("text", "\n", -1).alias("lines"), F.create_map(F.lit("relation"), source, F.lit("note"), source).alias("notes"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tree.alias("tree"))
    r = rows.select("doc_id", strings.replace_nested(F.col("tree"), rows.schema["tree"].dataType, mapping).alias("r"))
    paths = F.array_distinct(F.transform("r.changes", lambda c: c["path"]))
    return r.select("doc_id", "r.value.fact_id", F.sha2(F.array_join("r.value.lines", "\n"), 256).alias("sha256"), F.col("r.value.notes")["relation"].alias("relation"), F.col("r.value.notes")["note"].alias("note"), F.size("r.changes").alias("changes"), F.size(paths).alias("paths"))


def t24_composed(spark, sf_dir):
    half, whole = F.floor(F.length("text") / 2).cast("int"), F.length("text")
    pieces = _docs(spark, sf_dir).select("owner_id", "unit_id", F.explode(F.array(*(F.struct(F.lit(n).alias("piece_no"), a.alias("start"), b.alias("end")) for n, a, b in ((2, F.lit(0), half), (1, half, whole))))).alias("_p")).select("owner_id", "unit_id", (F.col("owner_id") % 50).alias("target"), ((F.col("owner_id") * 4) + F.col("_p.piece_no")).alias("piece_no"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"))
    return T.composed(pieces, _docs(spark, sf_dir), ["owner_id", "unit_id"], "target").select("target", F.sha2("text", 256).alias("sha256"))


def t25_padded(spark, sf_dir):
    a, b = T.padded(F.col("text"), 1001)
    return _docs(spark, sf_dir).select("owner_id", F.sha2(a, 256).alias("first"), F.length(b).alias("second"))


QUERIES = {f.__name__: f for f in (t01_located, t02_occurrences, t03_unique, t04_sole, t05_citations, t06_overlap, t07_segments, t07_catalog, t08_windows, t09_index, t10_resolve, t11_pure, t12_display, t13_visible, t14_names, t15_shortcuts, t16_markers, t17_deleted, t18_cut, t19_survivors, t20_active, t21_defects, t22_replaced, t22_nested, t23_replayed, t24_composed, t25_padded)}

_D = "d AS (SELECT doc_id AS owner_id, lower(text) AS text FROM documents)"


def _hits(word: str, name: str) -> str:
    """A common table of the places of a word that cannot overlap itself: lengths of what stands between, summed up."""
    parts = f"SELECT owner_id, unnest(string_split(text, '{word}')) AS p, unnest(range(len(string_split(text, '{word}')))) AS n, len(string_split(text, '{word}')) - 1 AS m FROM d"
    return f"{name} AS (SELECT owner_id, n, (sum(length(p)) OVER (PARTITION BY owner_id ORDER BY n) + n * {len(word)})::INT AS s FROM ({parts}) QUALIFY n < m)"


_SENTENCE = r"""[^。！？!?．.\n\r]*[。！？!?．.\n\r][。！？!?．.\n\r”’"''」』）)\]}》〉】〕]*|[^。！？!?．.\n\r]+"""
_CLAUSE = r"""[^。！？!?．.\n\r，,；;：:]*[。！？!?．.\n\r，,；;：:][。！？!?．.\n\r，,；;：:”’"''」』）)\]}》〉】〕]*|[^。！？!?．.\n\r，,；;：:]+"""
_START = "(owner_id % 7)"
_NAMED = """e AS (SELECT p_size AS owner_id, p_partkey AS entity_id, trim(unnest([p_name, p_brand || ' ', p_type])) AS surface FROM part),
i AS (SELECT owner_id, surface, count(DISTINCT entity_id) AS n, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) END AS id FROM e WHERE surface <> '' GROUP BY ALL)"""
_SURFACES = "s(surface, named) AS (VALUES ('thes the', true), ('and', false), ('tion', false), ('ment', false)), c AS (SELECT conv_id AS owner_id, turn AS context_id, lower(text) AS text FROM conversations)"
SQL = {
    "t01_located": f"WITH {_D} SELECT owner_id, g::INT AS group_no, g = 1 AND substr(text, 11, 20) <> '' AS located FROM d, range(1, 3) AS r(g)",
    "t02_occurrences": f"WITH {_D}, {_hits('the', 'h')} SELECT owner_id, n::INT AS hit_no, s AS start, s + 3 AS \"end\" FROM h",
    "t03_unique": f"WITH {_D}, n AS (SELECT owner_id, text, substr(text, 21, 6) AS q FROM d), p AS (SELECT *, instr(text, q) AS pos FROM n) SELECT owner_id, CASE WHEN q <> '' AND pos > 0 AND instr(substr(text, pos + 1), q) = 0 THEN pos - 1 END AS start, CASE WHEN q = '' THEN 0 ELSE (length(text) - length(replace(text, q, ''))) // length(q) END AS apart FROM p",
    "t04_sole": "WITH q AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0), h AS (SELECT c.conv_id, turn FROM conversations c JOIN q ON c.conv_id = q.conv_id WHERE q <> '' AND contains(text, q)) SELECT conv_id AS owner_id, 1 AS quote_id, min(turn) AS context_id FROM h GROUP BY 1 HAVING count(*) = 1",
    "t05_citations": f"WITH {_D} SELECT owner_id, owner_id % 3 = 0 AND length(text) >= 30 AS valid FROM d",
    "t06_overlap": f"WITH {_D}, {_hits('the', 'a')}, {_hits('hen', 'b')} SELECT a.owner_id, a.s AS start, a.s + 3 AS \"end\", b.s AS other_start, b.s + 3 AS other_end FROM a JOIN b ON a.owner_id = b.owner_id AND a.s < b.s + 3 AND b.s < a.s + 3",
    "t07_segments": rf'''WITH {_D}, p AS (SELECT owner_id, regexp_extract_all(text, '{_SENTENCE}') AS p FROM d), u AS (SELECT owner_id, unnest(p) AS t, unnest(range(len(p))) AS n FROM p), r AS (SELECT owner_id, t, sum(length(t)) OVER (PARTITION BY owner_id ORDER BY n) AS e FROM u) SELECT owner_id, (e - length(t))::INT AS start, e::INT AS "end", t AS text FROM r''',
    "t08_windows": rf"""WITH {_D}, p AS (SELECT owner_id, text, regexp_extract_all(text, '[^。！？\n]+[。！？\n]?|[。！？\n]') AS p FROM d), u AS (SELECT owner_id, unnest(p) AS t, unnest(range(len(p))) AS n FROM p), s AS (SELECT owner_id, n, sum(length(t)) OVER w AS e, sum(length(t)) OVER w - length(t) AS b FROM u WINDOW w AS (PARTITION BY owner_id ORDER BY n)),
{_hits('tion', 'h1')}, {_hits('ation', 'h2')}, h AS (SELECT owner_id, 'tion' AS w, s AS a FROM h1 UNION ALL SELECT owner_id, 'ation', s FROM h2),
x AS (SELECT h.owner_id, w, (SELECT min(b) FROM s q WHERE q.owner_id = h.owner_id AND q.n >= s.n - 1) AS b, (SELECT max(e) FROM s q WHERE q.owner_id = h.owner_id AND q.n <= s.n + 1) AS e FROM h JOIN s ON h.owner_id = s.owner_id AND a >= s.b AND a < s.e)
SELECT owner_id, b::INT AS start, e::INT AS "end", min_by(w, -length(w)) AS matched_surface FROM x GROUP BY ALL""",
    "t09_index": f"WITH {_NAMED} SELECT owner_id, surface, n::INT AS owners, id AS entity_id FROM i",
    "t10_resolve": f"""WITH {_NAMED}, m AS (SELECT p_size AS owner_id, p_partkey AS asked, p_partkey % 4 AS k, p_name AS l, CASE p_partkey % 4 WHEN 1 THEN trim(p_brand) WHEN 3 THEN p_name END AS r FROM part),
j AS (SELECT m.*, a.n AS an, a.id AS aid, b.n AS bn, b.id AS bid FROM m LEFT JOIN i a ON a.owner_id = m.owner_id AND a.surface = l LEFT JOIN i b ON b.owner_id = m.owner_id AND b.surface = r),
s AS (SELECT *, CASE WHEN k = 2 THEN 'unresolved' WHEN k = 0 THEN CASE WHEN an = 1 THEN 'resolved' ELSE 'ambiguous' END WHEN an = 1 AND bn = 1 THEN CASE WHEN aid = bid THEN 'resolved' ELSE 'conflicting' END WHEN an > 1 OR bn > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM j)
SELECT owner_id, asked, status, CASE WHEN status = 'resolved' THEN aid END AS entity_id FROM s""",
    "t11_pure": """WITH f AS (SELECT c_nationkey, min(c_name) AS f FROM customer GROUP BY 1), r AS (SELECT c_nationkey AS owner_id, c_custkey AS entity_id, c_name AS surface, true AS named, NULL AS f FROM customer UNION ALL
SELECT c.c_nationkey, c_custkey, f || CASE WHEN c_custkey % 2 = 0 THEN ' kin ' ELSE ' of ' END || c_custkey % 40, false, CASE WHEN c_custkey % 2 = 0 AND c_name <> f THEN f END FROM customer c JOIN f ON c.c_nationkey = f.c_nationkey),
s AS (SELECT *, count(*) OVER (PARTITION BY owner_id, surface) AS n FROM r) SELECT owner_id, entity_id, surface FROM s WHERE n = 1 AND f IS NULL""",
    "t21_defects": r"""WITH d AS (SELECT doc_id % 4 AS n, coalesce(substr(text, 11, 120), '') AS q, coalesce(regexp_replace(substr(text, 21, 10), '^\s+|\s+$', '', 'g'), '') AS a, coalesce(regexp_replace(substr(text, 101, 10), '^\s+|\s+$', '', 'g'), '') AS b FROM documents),
v AS (SELECT 'endpoint' AS "check" FROM d WHERE n = 1 UNION ALL SELECT 'self_parent' FROM d WHERE n = 2 UNION ALL SELECT 'quote_absent' FROM d WHERE n = 3 OR q = '' UNION ALL SELECT 'endpoint_unnamed' FROM d WHERE n = 3 AND (a <> '' OR b <> '')) SELECT "check", count(*) AS facts FROM v GROUP BY 1""",
    "t12_display": f"WITH {_SURFACES}, v AS (SELECT owner_id, surface, named FROM c, s WHERE contains(text, surface)), b AS (SELECT owner_id, first(surface ORDER BY named DESC, length(surface) DESC, surface) AS display FROM v GROUP BY 1) SELECT owner_id, 'x' AS entity_id, coalesce(display, '') AS display FROM (SELECT DISTINCT owner_id FROM c) LEFT JOIN b USING (owner_id)",
    "t13_visible": f"WITH {_SURFACES} SELECT owner_id, context_id, string_agg(surface, ',' ORDER BY surface) AS surfaces FROM c, s WHERE contains(text, surface) GROUP BY ALL HAVING count(*) >= 2",
    "t16_markers": f"""WITH {_D}, q AS (SELECT owner_id, text AS q, replace(replace(replace(text, 'then', ''), 'tion', ''), 'the', '') AS r FROM d) SELECT owner_id, contains(q, 'then') AS has_child, contains(q, 'the') OR contains(q, 'tion') AS has_parent,
regexp_matches(r, 'ship|ring') AS predicate, CASE owner_id % 3 WHEN 0 THEN regexp_matches(r, 'ou|ment') WHEN 1 THEN regexp_matches(r, 'zz|ght') ELSE contains(r, 'ness') END AS role FROM q""",
    "t07_catalog": f"""WITH {_D}, p AS (SELECT owner_id, 'sentence' AS l, regexp_extract_all(text, '{_SENTENCE}') AS p FROM d UNION ALL SELECT owner_id, 'clause', regexp_extract_all(text, '{_CLAUSE}') FROM d), u AS (SELECT owner_id, l, unnest(p) AS t, unnest(range(len(p))) AS n FROM p),
r AS (SELECT owner_id, l, length(t) AS len, sum(length(t)) OVER (PARTITION BY owner_id, l ORDER BY n) AS e FROM u), g AS (SELECT owner_id, e, len, bool_or(l = 'sentence') AS s, count(DISTINCT l) AS m FROM r GROUP BY ALL)
SELECT owner_id, count(*) AS spans, count(*) FILTER (WHERE m = 2) AS "both", sum(CASE WHEN s THEN len ELSE 0 END)::BIGINT AS characters FROM g GROUP BY 1""",
    "t14_names": "SELECT p_partkey, p_partkey % 5 < 2 AS identity_only FROM part",
    "t15_shortcuts": rf"""WITH {_D}, s AS (SELECT owner_id, unnest(regexp_extract_all(text, '[^。！？\n]+[。！？\n]?|[。！？\n]')) AS s FROM d), t(m, term) AS (VALUES (0, 'and'), (0, 'er'), (1, 'ion'))
SELECT DISTINCT owner_id AS query_id, term, sha256(s) AS sha256 FROM s JOIN t ON owner_id % 2 = m WHERE regexp_matches(s, '(?s)the.{{0,20}}' || term)""",
    "t22_replaced": f"""WITH {_D}, r AS (SELECT owner_id, text, replace(replace(replace(text, 'then', '<2>'), 'the', '<1>'), 'tion', '') AS r, replace(text, 'then', '####') AS a FROM d)
SELECT owner_id, sha256(r) AS sha256, CASE WHEN text IS NULL THEN -1 ELSE (length(text) - length(replace(text, 'then', ''))) // 4 + (length(a) - length(replace(a, 'the', ''))) // 3 + (length(text) - length(replace(text, 'tion', ''))) // 4 END::INT AS changes, r = r AS replays FROM r""",
    "t22_nested": """WITH d AS (SELECT doc_id, text, 'then ' || coalesce(source, '') AS s, coalesce(text, '') || chr(10) || 'then ' || coalesce(source, '') AS t FROM documents), e AS (SELECT *, replace(t, 'then', '####') AS a FROM d)
SELECT doc_id, s AS fact_id, sha256(replace(replace(replace(text, 'then', '<2>'), 'the', '<1>'), 'tion', '')) AS sha256, s AS relation, replace(replace(replace(s, 'then', '<2>'), 'the', '<1>'), 'tion', '') AS note,
  ((length(t) - length(replace(t, 'then', ''))) // 4 + (length(a) - length(replace(a, 'the', ''))) // 3 + (length(t) - length(replace(t, 'tion', ''))) // 4)::INT AS changes,
  len(list_filter(string_split(t, chr(10)), lambda x: contains(x, 'the') OR contains(x, 'tion')))::INT AS paths FROM e""",
    "t23_replayed": f"WITH {_D} SELECT owner_id, CASE WHEN owner_id % 3 <> 0 THEN sha256(substr(text, 1, 10) || '<x>' || substr(text, 15)) END AS sha256 FROM d",
    "t18_cut": f"WITH {_D} SELECT owner_id, sha256(CASE WHEN length(text) > 60 THEN substr(text, 1, {_START}) || substr(text, {_START} + 16, 15) || substr(text, {_START} + 41) ELSE text END) AS sha256 FROM d",
    "t19_survivors": f"""WITH {_D}, c(g, a, b) AS (VALUES (1, 20, 24), (1, 50, 55), (2, 5, 8), (3, 45, 60)), j AS (SELECT owner_id, g, a, b, ((a < {_START} + 15 AND b > {_START}) OR (a < {_START} + 40 AND b > {_START} + 30)) AS hit, CASE WHEN a >= {_START} + 15 THEN 15 ELSE 0 END + CASE WHEN a >= {_START} + 40 THEN 10 ELSE 0 END AS shift, coalesce(length(text) > 60, false) AS cut FROM d, c),
k AS (SELECT *, bool_or(hit AND cut) OVER (PARTITION BY owner_id, g) AS gone FROM j) SELECT owner_id, g AS group_no, a - CASE WHEN cut THEN shift ELSE 0 END AS start, b - CASE WHEN cut THEN shift ELSE 0 END AS "end" FROM k WHERE NOT gone""",
    "t20_active": f"WITH {_D} SELECT owner_id, 'f' AS fact_id, CASE WHEN substr(text, 11, 20) <> '' THEN 1 ELSE 0 END AS support_count, substr(text, 11, 20) <> '' AS active FROM d",
    "t24_composed": f"WITH {_D}, p AS (SELECT owner_id % 50 AS target, owner_id * 4 + n AS k, CASE n WHEN 2 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS t FROM d, range(1, 3) AS r(n)) SELECT target, sha256(string_agg(t, '' ORDER BY k, t)) AS sha256 FROM p GROUP BY 1",
    "t25_padded": f"WITH {_D} SELECT owner_id, sha256(substr(repeat(text, ceil(1001 / length(text))::INT), 1, 500)) AS \"first\", CASE WHEN length(text) > 0 THEN 501 ELSE 0 END AS \"second\" FROM d",
}
