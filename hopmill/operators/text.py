"""Text evidence: located quotes, occurrences, segments, windows, intervals, deletions, names.

Positions are code points from 0, intervals are half-open. Joins are always by owner and context first; texts and
needles meet only inside one owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.functions.strings import let, literally, occurrences, only_spans, running, surface
from hopmill.operators.intervals import against_cuts, overlapping  # noqa: F401
from hopmill.operators.spotting import spotted

#: What ends a sentence and a clause, and closing marks that go with an end.
SENTENCE_ENDS = "。！？!?．.\n\r"
CLAUSE_ENDS = SENTENCE_ENDS + "，,；;：:"
CLOSERS = "”’\"'」』）)]}》〉】〕"
SENTENCE = r"[^。！？\n]+[。！？\n]?|[。！？\n]"
SPAN = "struct<start int, `end` int>"
#: A described relation, words of relations beside a name, predicates, role words, and titles that are role words themselves.
DESCRIBED = r"(?:之|的).*(?:父|母|子|女|祖|兄|弟|姐|妹)"
KIN = "父|母|爹|娘|爸|妈|爷|奶|祖|子|女|夫|妻|兄|弟|姐|妹|生|育|所出|所养|诞|后裔|后代"
PREDICATE = "父|母|爹|娘|爸|妈|亲|子|女|生|所出|所育|后代"
ROLES = {
    "father": "父|爹|爸|男|丈夫|夫君|夫婿|老爷|公子|长子|次子|舅|伯|叔|爷|娶|翁",
    "mother": "母|娘|妈|女|妻|太太|夫人|姑娘|小姐|姑|姨|姥|奶|婆|生下|所生|妊|孕|产",
}
OTHER_ROLE = "父|母|爹|娘|爸|妈|亲|子|女|生|所出|所育"
FATHER_TITLE = "(?:老爹|爹爹|老爸|爸爸)$"
TITLE_OF = "(?:的|之)(?:亲生)?(?:长女|次女|幼女|女儿|长子|次子|幼子|儿子|子女|孩子)"


def quote_located(citations: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """citations with located: the quote is not empty and stands in its own named context."""
    joined = citations.join(contexts.select(*keys, F.col("text").alias("_text")), keys, "left")
    return joined.withColumn("located", F.coalesce((F.col("quote") != "") & F.col("_text").contains(F.col("quote")), F.lit(False))).drop("_text")


def all_hits(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """One row for each occurrence, overlapping ones included: hit_no, start, end. Rows without a hit give none."""
    some = rows.where(F.col(text).contains(F.col(needle)))
    hits = some.select("*", F.posexplode(occurrences(F.col(text), F.col(needle))).alias("hit_no", "start"))
    return hits.withColumn("end", F.col("start") + F.length(needle))


def count_apart(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap, from the left; 0 for an empty needle."""
    n = F.length(needle)
    return F.when(n > 0, F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.nullif(n, F.lit(0)))).otherwise(F.lit(0)).cast("int")


def located_once(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """rows with start: the place of the needle's only occurrence, overlapping ones counted; null if there is none or more."""
    first = F.instr(F.col(text), F.col(needle))
    again = F.instr(F.substring(F.col(text), first + 1, F.length(text)), F.col(needle))
    return rows.withColumn("start", F.when((F.length(needle) > 0) & (first > 0) & (again == 0), first - 1))


def sole_context(quotes: DataFrame, contexts: DataFrame, owner: str, quote_key: str, context: str) -> DataFrame:
    """(owner, quote key, context) of quotes that exactly one context of their owner holds."""
    hit = quotes.join(contexts.select(owner, context, F.col("text").alias("_text")), owner).where((F.col("quote") != "") & F.col("_text").contains(F.col("quote")))
    return hit.groupBy(owner, quote_key).agg(F.count("*").alias("_n"), F.min(context).alias(context)).where("_n = 1").drop("_n")


def citation_valid(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether the interval lies in the text and holds the quote."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == quote), F.lit(False))


def segments(text: Column, ends: str, closers: str = CLOSERS) -> Column:
    """Array of start, end and text: cut behind an end and the ends and closers that follow it. Every character is in one segment."""
    e, c = ("".join(f"\\x{{{ord(ch):x}}}" for ch in s) for s in (ends, closers))
    return placed(F.regexp_extract_all(text, F.lit(f"[^{e}]*[{e}][{e}{c}]*|[^{e}]+"), F.lit(0)))


def placed(parts: Column) -> Column:
    """Array of start, end and text of adjoining parts."""
    at = lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end"), p.alias("text"))
    return let(parts, lambda all_: F.zip_with(all_, running(F.transform(all_, F.length)), at))


def span_catalog(contexts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences and clauses as spans; one row for an interval that is both, with its levels and an id of its place and text."""
    level = lambda name, ends: F.transform(segments(F.col(text), ends), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("quote"), F.lit(name).alias("level")))
    rows = contexts.select(*keys, F.explode(F.concat(level("sentence", SENTENCE_ENDS), level("clause", CLAUSE_ENDS))).alias("_s")).select(*keys, "_s.*")
    rows = rows.groupBy(*keys, "start", "end", "quote").agg(F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"))
    return rows.withColumn("span_id", F.concat(F.lit("SP-"), F.substring(F.sha2(F.concat_ws("|", *keys, "start", "end", "quote"), 256), 1, 24)))


def hit_windows(edges: DataFrame, surfaces: DataFrame, contexts: DataFrame, owner: str = "owner_id", radius: int = 1) -> DataFrame:
    """For each edge and context the sentences around each hit of a surface of its child, `radius` to either side.

    Equal windows of an edge and context are one row with the longest surface, ties by code point. Surfaces are found by
    automata; sentences and hits pass by in the order of place, so a hit knows its window from the last sentence.
    """
    spot = [owner, "context_id"]
    w = Window.partitionBy(*spot).orderBy("_no")
    sentences = contexts.select(*spot, F.posexplode(placed(F.regexp_extract_all(F.col("text"), F.lit(SENTENCE), F.lit(0)))).alias("_no", "_s")).select(*spot, "_no", "_s.start", "_s.end")
    low, high = F.coalesce(F.lag("start", radius).over(w), F.lit(0)), F.coalesce(F.lead("end", radius).over(w), F.max("end").over(Window.partitionBy(*spot)))
    sentences = sentences.select(*spot, "start", F.struct(low.alias("low"), high.alias("high")).alias("_window"))
    named = edges.join(surfaces.withColumnRenamed("entity_id", "child"), [owner, "child"])
    hits = spotted(contexts, named, owner, ("context_id",))
    known = F.last("_window", ignorenulls=True).over(Window.partitionBy(*spot).orderBy("start", F.col("surface").isNotNull()))
    rows = hits.unionByName(sentences, allowMissingColumns=True).withColumn("_window", known).where("surface is not null")
    rows = rows.select(*spot, "surface", "_window.low", "_window.high").distinct().join(named.select(owner, "edge_id", "surface").distinct(), [owner, "surface"])
    best = F.min(F.struct(-F.length("surface"), "surface"))["surface"]
    out = rows.groupBy(*spot, "edge_id", F.col("low").alias("start"), F.col("high").alias("end")).agg(best.alias("matched_surface"))
    out = out.join(contexts.select(*spot, F.col("text").alias("_text")), spot)
    return out.select(owner, "edge_id", "context_id", "start", "end", "matched_surface", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def surfaces(entities: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, entity_id, surface, is_name): names and aliases in NFKC without outer spaces; empty ones left out."""
    each = F.explode(F.concat(F.array(F.struct(F.col("name").alias("s"), F.lit(True).alias("n"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("s"), F.lit(False).alias("n"))))).alias("_s")
    rows = entities.select(owner, "entity_id", each).select(owner, "entity_id", surface(F.col("_s.s")).alias("surface"), F.col("_s.n").alias("is_name"))
    return rows.where("surface <> ''").groupBy(owner, "entity_id", "surface").agg(F.bool_or("is_name").alias("is_name"))


def identity_index(named: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, surface, owners, entity_id): entity_id only where one entity owns the surface."""
    return named.groupBy(owner, "surface").agg(F.array_sort(F.collect_set("entity_id")).alias("owners")).withColumn("entity_id", F.when(F.size("owners") == 1, F.col("owners")[0]))


def resolve(mentions: DataFrame, index: DataFrame, owner: str = "owner_id", mention: str = "mention") -> DataFrame:
    """mentions with status (resolved, ambiguous, conflicting, unresolved) and entity_id.

    A whole registered surface counts first; else A(B), whose parts must both be known: one entity resolves, two conflict.
    """
    m = mentions.withColumn("_whole", surface(F.col(mention)))
    part = lambda i: F.trim(F.regexp_extract("_whole", r"^([^()]+)\(([^()]+)\)$", i))
    m = m.withColumns({"_left": part(1), "_right": part(2)})
    for side in ("_whole", "_left", "_right"):
        m = m.join(index.select(owner, F.col("surface").alias(side), F.size("owners").alias(f"{side}_n"), F.col("entity_id").alias(f"{side}_id")), [owner, side], "left")
    whole, left, right = (F.coalesce(F.col(f"{s}_n"), F.lit(0)) for s in ("_whole", "_left", "_right"))
    composed = F.col("_left") != ""
    status = F.when(whole == 1, "resolved").when(whole > 1, "ambiguous").when(~composed, "unresolved").when((left == 1) & (right == 1), F.when(F.col("_left_id") == F.col("_right_id"), "resolved").otherwise("conflicting")).when((left > 1) | (right > 1), "ambiguous").otherwise("unresolved")
    out = m.withColumn("status", status).withColumn("entity_id", F.when(F.col("status") == "resolved", F.coalesce("_whole_id", "_left_id")))
    return out.select(*mentions.columns, "status", "entity_id")


def pure_surfaces(named: DataFrame, owner: str = "owner_id", kin: str = KIN, described: str = DESCRIBED) -> DataFrame:
    """Surfaces of one entity that are no relational description: no described relation, nor a surface of others with a word of kinship beside it.

    A surface is cut into the stretches that have the length of some surface of its owner, and these are looked up: no
    pairs of surfaces are made.
    """
    owned = named.groupBy(owner, "surface").agg(F.collect_set("entity_id").alias("_ids"))
    own = named.join(owned.where(F.size("_ids") == 1).select(owner, "surface"), [owner, "surface"]).where(~F.col("surface").rlike(described))
    lengths = owned.groupBy(owner).agg(F.collect_set(F.length("surface")).alias("_lengths"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length("surface") - n + 1), lambda i: F.substring(F.col("surface"), i, n))
    parts = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("surface")), of))
    cut_up = own.join(lengths, owner).select(owner, "entity_id", "surface", F.explode(F.array_distinct(parts)).alias("_o"))
    others = cut_up.join(owned.withColumnRenamed("surface", "_o"), [owner, "_o"]).where(~F.array_contains("_ids", F.col("entity_id")))
    beside = others.where(F.replace(F.col("surface"), F.col("_o"), F.lit("")).rlike(kin))
    return own.join(beside.select(owner, "entity_id", "surface").distinct(), [owner, "entity_id", "surface"], "left_anti")


def display_surface(named: DataFrame, contexts: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, entity_id, display): the name if it is visible in a text of the owner, else the longest visible surface (ties by code point), else empty."""
    seen = named.join(spotted(contexts, named, owner, once=True).select(owner, "surface").distinct(), [owner, "surface"])
    best = seen.groupBy(owner, "entity_id").agg(F.min(F.struct((~F.col("is_name")).alias("a"), (-F.length("surface")).alias("b"), "surface"))["surface"].alias("display"))
    return named.select(owner, "entity_id").distinct().join(best, [owner, "entity_id"], "left").withColumn("display", F.coalesce("display", F.lit("")))


def visible_aliases(named: DataFrame, contexts: DataFrame, owner: str = "owner_id", least: int = 1) -> DataFrame:
    """(owner, context_id, entity_id, surfaces) of entities with `least` surfaces or more in a text."""
    seen = named.join(spotted(contexts, named, owner, ("context_id",), once=True), [owner, "surface"])
    return seen.groupBy(owner, "context_id", "entity_id").agg(F.array_sort(F.collect_set("surface")).alias("surfaces")).where(F.size("surfaces") >= least)


def identity_guard(citations: DataFrame, named: DataFrame, owner: str = "owner_id") -> DataFrame:
    """citations with identity_only: the quote is just names of its owner, spaces, punctuation and conjunctions."""
    quotes = citations.select(owner, "quote").distinct().withColumn("_norm", surface(F.col("quote")))
    at = spotted(quotes, named, owner, ("quote", "_norm"), text="_norm").groupBy(owner, "quote", "_norm").agg(F.collect_list(F.struct("start", (F.col("start") + F.length("surface")).alias("end"))).alias("_at"))
    only = at.select(owner, "quote", only_spans(F.col("_norm"), F.col("_at")).alias("identity_only"))
    return citations.join(only, [owner, "quote"], "left").select(*citations.columns, F.coalesce("identity_only", F.lit(False)).alias("identity_only"))


def shortcut_candidates(contexts: DataFrame, starts: DataFrame, terms: DataFrame, owner: str = "owner_id", gap: int = 6) -> DataFrame:
    """Sentences with a query's start name, at most `gap` characters, and a kin term of its pair of roles: for review only."""
    sent = contexts.select(owner, "context_id", F.explode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("sentence"))
    rows = sent.join(starts, owner).join(terms, "roles")
    pattern = F.concat(F.lit("(?s)"), literally(F.col("start_name")), F.lit(f".{{0,{gap}}}"), literally(F.col("term")))
    return rows.where(F.col("sentence").contains(F.col("start_name")) & F.regexp_like(F.col("sentence"), pattern)).select(owner, "context_id", "query_id", "term", "sentence").distinct()


def marker_guards(quote: Column, child: Column, parent: Column, role: Column, predicate: str = PREDICATE, roles: dict[str, str] = ROLES, other: str = OTHER_ROLE) -> Column:
    """struct(has_child, has_parent, predicate, role): names present, and what the quote without all names holds. Negative guards only.

    child and parent are arrays of names, taken out longest first, ties by code point. A role without words of its own
    has `other`. For the role father a name of the parent that is a title counts, before one of its children (TITLE_OF).
    """
    names = F.filter(F.array_distinct(F.concat(child, parent)), lambda n: n != "")
    longest = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    rest = F.aggregate(longest, quote, lambda left, n: F.replace(left, n["n"], F.lit("")))
    words = F.lit(False)
    for name, pattern in roles.items():
        words = words | ((role == name) & rest.rlike(pattern))
    words = words | (~role.isin(*roles) & rest.rlike(other))
    title = (role == "father") & F.exists(parent, lambda n: n.rlike(FATHER_TITLE) & F.regexp_like(quote, F.concat(literally(n), F.lit(TITLE_OF))))
    there = lambda some: F.exists(some, lambda n: (n != "") & quote.contains(n))
    return F.struct(there(child).alias("has_child"), there(parent).alias("has_parent"), rest.rlike(predicate).alias("predicate"), (words | title).alias("role"))


def merged(spans: Column) -> Column:
    """Sorted spans (start, end), overlapping and touching ones joined."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans.cast(f"array<{SPAN}>")), F.array().cast(f"array<{SPAN}>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)))


def cut(text: Column, spans: Column) -> Column:
    """The text without its sorted, disjoint spans."""

    def kept(all_: Column) -> Column:
        end = lambda i: F.coalesce(F.get(all_, i)["end"], F.lit(0))
        parts = F.transform(all_, lambda s, i: F.substring(text, end(i - 1) + 1, s["start"] - end(i - 1)))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(all_) - 1) + 1, F.length(text)))

    return let(spans, kept)


def without_quotes(text: Column, quotes: Column) -> Column:
    """The text without the quotes if each stands in it exactly once, else the text as it is."""
    once = F.forall(quotes, lambda q: F.coalesce(count_apart(text, q), F.lit(0)) == 1)
    spans = F.transform(quotes, lambda q: F.struct((F.instr(text, q) - 1).alias("start"), (F.instr(text, q) - 1 + F.length(q)).alias("end")))
    return F.when((F.size(quotes) > 0) & once, cut(text, merged(spans))).otherwise(text)


def delete_quotes(units: DataFrame, cuts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units after deletion, log of cuts, violations): each quote must stand exactly once in its unit, else nothing of the unit is cut.

    Touching cuts are joined. A unit that loses all its text is left out; a remainder of white space alone is a violation,
    and so is an owner (all keys but the last) that loses all its units.
    """
    joined = cuts.join(units.select(*keys, F.col("text").alias("_text")), keys, "left")
    times = F.coalesce(count_apart(F.col("_text"), F.col("quote")), F.lit(0))
    checked = joined.withColumns({"_times": times, "_at": F.instr(F.col("_text"), F.col("quote")) - 1})
    bad = checked.where("_times <> 1").select(F.lit("quote_not_unique").alias("check"), F.concat_ws("/", *keys).alias("key"))
    spans = checked.groupBy(*keys).agg(F.min(F.col("_times") == 1).alias("_ok"), F.collect_list(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.length("quote")).alias("end"))).alias("_s")).where("_ok")
    spans = spans.select(*keys, merged(F.col("_s")).alias("_s"))
    after = units.join(spans, keys, "left").withColumn("_after", F.when(F.col("_s").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("_s"))))
    log = after.where("_s is not null").select(*keys, "text", F.explode("_s").alias("_c")).select(*keys, "_c.start", "_c.end", F.substring(F.col("text"), F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")).alias("removed"))
    blank = after.where((F.col("_after") != "") & (F.trim(F.regexp_replace("_after", r"\s", " ")) == "") & F.col("_s").isNotNull()).select(F.lit("only_space_left").alias("check"), F.concat_ws("/", *keys).alias("key"))
    rest = after.where((F.col("_after") != "") | F.col("_s").isNull()).withColumn("text", F.col("_after")).select(*units.columns)
    gone = (F.col("_after") == "") & F.col("_s").isNotNull()
    bare = after.groupBy(*keys[:-1]).agg(F.bool_and(F.coalesce(gone, F.lit(False))).alias("_all")).where("_all").select(F.lit("all_units_lost").alias("check"), F.concat_ws("/", *keys[:-1]).alias("key"))
    return rest, log, bad.unionByName(blank).unionByName(bare)


def delete_spans(contexts: DataFrame, cuts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contexts after deletion, violations): exact citations are cut; adjoining ones are fine, overlapping ones a violation; emptied contexts stay."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    over = cuts.withColumn("_before", F.lag("end").over(w)).where(F.col("_before") > F.col("start")).select(F.lit("overlap").alias("check"), F.concat_ws("/", *keys).alias("key")).distinct()
    wrong = cuts.join(contexts.select(*keys, F.col("text").alias("_text")), keys, "left").where(~citation_valid(F.col("_text"), F.col("start"), F.col("end"), F.col("quote"))).select(F.lit("citation").alias("check"), F.concat_ws("/", *keys).alias("key")).distinct()
    spans = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    after = contexts.join(spans, keys, "left").withColumn("text", F.when(F.col("_s").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("_s")))).select(*contexts.columns)
    return after, over.unionByName(wrong)


def surviving_groups(citations: DataFrame, cuts: DataFrame, keys: list[str], fact: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shifted citations of surviving groups, status of each fact).

    A group with a citation that overlaps a cut is gone whole; others move left by the cuts that end at or before their
    start. A fact without a group left is unresolved, never not_found.
    """
    c = against_cuts(citations, cuts, keys).withColumn("_gone", F.bool_or("hit").over(Window.partitionBy(*fact, "group_no")))
    kept = c.where("not _gone").withColumns({"start": F.col("start") - F.col("shift"), "end": F.col("end") - F.col("shift")}).select(*citations.columns)
    status = c.groupBy(*fact).agg(F.count_distinct(F.when(~F.col("_gone"), F.col("group_no"))).alias("groups_left")).withColumn("status", F.when(F.col("groups_left") > 0, "support_proposed").otherwise("unresolved"))
    return kept, status


def active_facts(evidence: DataFrame, contexts: DataFrame, owner: str = "owner_id", unit: str = "unit_id", fact: str = "fact_id") -> DataFrame:
    """(owner, fact, support_count, active): groups whose quotes are all located; a fact holds if it has one."""
    located = quote_located(evidence, contexts.withColumnRenamed("context_id", unit) if unit not in contexts.columns else contexts, [owner, unit])
    groups = located.groupBy(owner, fact, "group_no").agg(F.bool_and("located").alias("_all"))
    return groups.groupBy(owner, fact).agg(F.count_if("_all").cast("int").alias("support_count")).withColumn("active", F.col("support_count") > 0)


def evidence_defects(facts: DataFrame, entities: DataFrame, evidence: DataFrame, contexts: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, fact_id, check): unknown endpoints, an own parent, quotes that are absent, groups that name an endpoint nowhere."""
    known = entities.select(owner, F.col("entity_id").alias("_e"))
    ends = facts.select(owner, "fact_id", F.explode(F.array("parent", "child")).alias("_e"))
    bad_end = ends.join(known, [owner, "_e"], "left_anti").select(owner, "fact_id", F.lit("endpoint").alias("check"))
    selfish = facts.where("parent = child").select(owner, "fact_id", F.lit("self_parent").alias("check"))
    absent = quote_located(evidence, contexts, [owner, "unit_id"]).where("not located").select(owner, "fact_id", F.lit("quote_absent").alias("check"))
    groups = evidence.groupBy(owner, "fact_id", "group_no").agg(F.array_join(F.collect_list("quote"), "\n").alias("_q"))
    named = ends.distinct().join(surfaces(entities, owner).withColumnRenamed("entity_id", "_e"), [owner, "_e"])
    hits = spotted(groups, named, owner, ("fact_id", "group_no"), text="_q", once=True)
    seen = hits.join(named, [owner, "fact_id", "surface"]).select(owner, "fact_id", "group_no", "_e")
    asked = groups.select(owner, "fact_id", "group_no").join(named.select(owner, "fact_id", "_e").distinct(), [owner, "fact_id"])
    unnamed = asked.join(seen, [owner, "fact_id", "group_no", "_e"], "left_anti").select(owner, "fact_id", F.lit("endpoint_unnamed").alias("check"))
    return bad_end.unionByName(selfish).unionByName(absent).unionByName(unnamed).distinct()


def composed(ranges: DataFrame, sources: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(target, text): pieces of sources joined in the order of piece_no."""
    parts = ranges.join(sources.select(*keys, F.col("text").alias("_text")), keys).withColumn("_p", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return parts.groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "_p"))), lambda x: x["_p"]), "").alias("text"))


def padded(text: Column, length: int) -> tuple[Column, Column]:
    """Two halves of a background of exactly `length` characters, the text over and over; empty for an empty text."""
    whole = F.when(F.length(text) > 0, F.substring(F.repeat(text, F.ceil(F.lit(length) / F.length(text)).cast("int")), 1, length)).otherwise("")
    return F.substring(whole, 1, length // 2), F.substring(whole, length // 2 + 1, length)
