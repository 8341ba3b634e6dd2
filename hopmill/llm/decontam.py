"""Benchmark decontamination by template windows: typed placeholders, a hash join, and a check of slot consistency.

Everything here is built-in DataFrame and SQL functions.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash

#: Marks that stand in front of a number, a name and a unit, and of a capitalised word that may be a name (at the start of a sentence, in a quote or bracket).
#: ASCII, so that a text of one byte a character stays one in Java's strings; in texts these five controls count as white space.
NUMBER, NAME, UNIT, INITIAL = "\x01", "\x02", "\x03", "\x04"
#: Stands between the readings of a document; no item has it.
GAP = "\x05"
#: Readings of a text: names inside sentences are slots; all capitalised words are; no slots, words as they stand but for their case.
INNER, CAPITALS, PLAIN = 0, 1, 2
#: Units of measure and money that may follow a number.
UNITS = "mm cm m km inch inches ft feet yards mile miles mg g kg ton tons tonnes lb lbs oz ml l litre litres liter liters s sec seconds min minutes h hour hours day days week weeks month months year years k c f w kw mw v a hz khz mhz ghz b kb mb gb tb percent dollars dollar euros euro pounds usd eur gbp cents degrees".split()
#: Classes of patterns: white space, all but the space outside the printable ASCII characters; ASCII letters and digits.
SPACE, ALNUM = rf"[[^!-~]&&[\s\p{{Z}}\x85{NUMBER}-{GAP}]]", string.ascii_letters + string.digits
#: Tokens in a window, tokens of a window that must be literal, part of an item's windows that must be found, and aligned tokens that are enough alone.
WINDOW, LITERAL, COVERED, ALIGNED = 5, 2, 0.8, 13


def marked(text: Column) -> Column:
    """The text as case-folded tokens with one space between, punctuation left out, slots marked and holding their value.

    Numbers (with inner points and commas) are slots; so are capitalised words (NAME inside a sentence, INITIAL elsewhere)
    and unit words behind a number. A word in capitals throughout is literal. White space counts as one space, and so do the
    marks' own characters where a text has them.
    """
    # most characters are ASCII letters, digits and single spaces: each class rules these out first, before it asks for a Unicode property
    v = F.regexp_replace(F.coalesce(text, F.lit("")), rf" (?![!-~]){SPACE}*+|[[^ -~]&&{SPACE}]{SPACE}*+", " ")
    v = F.regexp_replace(v, r"(?=\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}++(?![\p{L}\p{N}]))", INITIAL)
    v = F.regexp_replace(v, rf"{INITIAL}(?<=[^.!?\s] .)", NAME)
    v = F.regexp_replace(v, r"(\p{N}(?<![\p{L}\p{N}].)\p{N}*+(?:[.,]\p{N}++)*+)", f" {NUMBER}$1 ")  # possessive: else Java recurses once a repetition
    # points and commas in front of a digit are inside a number by now
    v = F.lower(F.upper(F.regexp_replace(v, rf"(?! [{ALNUM}{NUMBER}-{INITIAL}])[[^{ALNUM}]&&[^\p{{L}}\p{{N}}{NUMBER}-{INITIAL}]]++(?<![.,](?=\p{{N}}))", " ")))
    return F.trim(F.regexp_replace(v, rf"({NUMBER}\S++ )(?=(?:{'|'.join(UNITS)})(?: |$))", f"$1{UNIT}"))


def _without(text: Column, marks: str, put: str = "") -> Column:
    """The text with each of the marks replaced; F.translate looks up every character."""
    return reduce(lambda v, m: F.replace(v, F.lit(m), F.lit(put)), marks, text)


def slotted(marks: Column, reading: int) -> Column:
    """marked() text with the marks of a reading: neighbouring names are one (PLAIN: one a word, and no INITIAL)."""
    v = _without(marks, INITIAL, NAME if reading == CAPITALS else "")
    return v if reading == PLAIN else F.regexp_replace(v, rf"({NAME}\S+) (?={NAME})", "$1_")


def template(marks: Column, reading: int) -> Column:
    """marked() text as a reading compares it: each slot is its mark alone, or (PLAIN) its value alone."""
    if reading == PLAIN:
        return _without(marks, NUMBER + NAME + UNIT + INITIAL)
    v = _without(marks, INITIAL, NAME if reading == CAPITALS else "")
    return F.regexp_replace(v, rf"([{NUMBER}-{UNIT}])(?:(?<={NAME})[^ ]*+(?: {NAME}[^ ]*+)*+|[^ ]*+)", "$1")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _window(words: Column, at: Column, n: int, reading: Column) -> Column:
    """Hash of the n tokens from place at (counted from 0), different in each reading; null if they are not all there."""
    return F.when(at + n <= F.size(words), F.xxhash64(*(F.get(words, at + j) for j in range(n))).bitwiseXOR(reading.cast("long")))


def _places(rows: DataFrame, lengths: list[int], runs: bool = True) -> DataFrame:
    """(_id, _text, _place, _hash): the windows of each length at every place of rows (_id, _text, _raw), in all readings.

    Without runs, of windows that repeat one token over and over only the first of a run is given.
    """
    readings = (INNER, CAPITALS, PLAIN)
    words = rows.select("_id", "_text", marked(F.col("_raw")).alias("_marks"))
    words = words.select("_id", "_text", *(tokens(template(F.col("_marks"), r)).alias(f"_t{r}") for r in readings))
    words = words.select("_id", "_text", F.size("_t0").alias("_s0"), F.size("_t1").alias("_s1"), F.concat("_t0", F.array(F.lit(GAP)), "_t1", F.array(F.lit(GAP)), "_t2").alias("_tokens"))
    # all readings in one array, so that places are exploded and hashed in compiled code
    seen = words.select("*", F.explode(F.sequence(F.lit(0), F.size("_tokens") - 1)).alias("_i"))
    if not runs:
        token = lambda j: F.get("_tokens", F.col("_i") + j)
        seen = seen.where(~F.coalesce(reduce(lambda x, j: x & (token(j) == token(-1)), range(1, max(lengths, default=1)), token(0) == token(-1)), F.lit(False)))
    reading = F.when(F.col("_i") <= F.col("_s0"), INNER).when(F.col("_i") <= F.col("_s0") + F.col("_s1") + 1, CAPITALS).otherwise(PLAIN)
    base = F.when(F.col("_i") <= F.col("_s0"), 0).when(F.col("_i") <= F.col("_s0") + F.col("_s1") + 1, F.col("_s0") + 1).otherwise(F.col("_s0") + F.col("_s1") + 2)
    hashes = [_window(F.col("_tokens"), F.col("_i"), n, reading) for n in lengths]
    hashed = hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes)) if hashes else F.lit(None).cast("long")
    return seen.select("_id", "_text", (F.col("_i") - base).alias("_place"), hashed.alias("_hash")).where("_hash is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, text_hash, item, kind, windows, found, aligned, start, slots, reading): the benchmark items found in each document.

    Texts are read in three ways (INNER, CAPITALS, PLAIN), each compared with itself only. In each, an item's windows of
    WINDOW tokens (those with LITERAL literal tokens or more, in PLAIN all, so that an item of numbers is found with its
    own numbers; an item shorter than a window is one window) are looked up among the windows of all documents by their hash. A document holds an item if in one reading COVERED of its windows
    are found, or if ALIGNED tokens lie in one alignment. Only alignments with consistent slots count: one value of the
    item always became the same value in the document; in PLAIN, which has no marks in the document, those slots are
    compared whose neighbours are equal. If the consistent ones fall short, the longest alignment of all must be
    consistent. found counts over the consistent ones; start and aligned are those of the best of them.
    kind is verbatim (all values equal) or reparameterised. start is the token of the document, in that reading, that the item's first would have. Of several
    readings a verbatim one is given, then the first.

    The documents are read map-side and their windows joined with the benchmark's, which is broadcast if it has at most
    a million windows; only distinct matches are shuffled. Documents with enough of an item's windows are read again:
    each place of a window is a start (with the first place of that window in the item; of a run of one repeated token the
    first place counts), stretches of the document that read alike are one alignment, and each is held against the item
    token by token. So a text that repeats its tokens costs what its length does. Items are read whole; those without
    tokens are left out.

    Texts of any length are read whole. Of several alignments as good, the first in the document is given; a window that
    the item repeats is found as often as it repeats once one is. Rows with the same key and text give one result, also with a null key; a null text holds nothing. Repeated items give
    repeated pairs only if their ids differ. Empty tables give an empty one. Other columns are not read.
    """
    readings = (INNER, CAPITALS, PLAIN)
    items = benchmark.select(F.col(item).alias("_item"), marked(F.col(item_text)).alias("_marks")).where("_marks <> ''").distinct()
    each = F.array(*(F.struct(F.lit(r).alias("_reading"), tokens(template(F.col("_marks"), r)).alias("_words"), tokens(slotted(F.col("_marks"), r)).alias("_values")) for r in readings))
    items = stash(items.select("_item", F.explode(each).alias("_r")).select("_item", "_r.*"), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_words"), F.lit(WINDOW)).alias("n")).distinct().collect())  # WINDOW values at most
    marks = F.array(F.lit(NUMBER), F.lit(NAME), F.lit(UNIT))
    is_slot = lambda w: F.array_contains(marks, F.left(w, F.lit(1)))
    wanted = None
    for n in lengths:
        own = items.where(F.least(F.size("_words"), F.lit(WINDOW)) == n).select("*", F.explode(F.sequence(F.lit(0), F.size("_words") - n)).alias("_at"))
        literal = F.size(F.filter(F.slice("_values", F.col("_at") + 1, n), lambda w: ~is_slot(w)))
        own = own.where((literal >= min(LITERAL, n)) | (F.col("_reading") == PLAIN)).select("_item", "_reading", "_at", _window(F.col("_words"), F.col("_at"), n, F.col("_reading")).alias("_hash"))
        wanted = own if wanted is None else wanted.unionByName(own)
    if wanted is None:
        wanted = items.select("_item", "_reading", F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_hash")).where("false")
    wanted = stash(wanted, "windows")
    window = F.col("_n")
    listed = wanted.groupBy("_item", "_reading").agg(F.sort_array(F.collect_list(F.struct("_at", "_hash"))).alias("_windows"))  # bounded by the item
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.col(text).alias("_raw"))
    pair = ["_id", "_text", "_item", "_reading"]
    # which windows are there at all: a document's distinct hashes, however often it repeats them
    # an inner join: a semi join would move below the hashing and hash again for its key
    there = _places(rows, lengths).join(small(stash(wanted.select("_hash").distinct(), "hashes")), "_hash").select("_id", "_text", "_hash").distinct()
    held = there.join(small(wanted), "_hash").groupBy(*pair).agg(F.count("*").alias("_all"))
    held = held.join(small(stash(listed, "listed")), ["_item", "_reading"])
    enough = F.least(F.ceil(COVERED * F.size("_windows")), F.lit(ALIGNED - WINDOW + 1))
    held = stash(held.where(F.col("_all") >= enough).select(*pair, "_all"), "held")
    # where they may lie: a start for each place of a window, taken as the first of its kind in the item
    which = small(stash(held.select("_id", "_text").distinct(), "which"))
    which = which.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"))
    some = rows.join(which, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left_semi").dropDuplicates(["_id", "_text"])
    first = small(stash(wanted.groupBy("_item", "_reading", "_hash").agg(F.min("_at").alias("_at")), "first"))
    starts = _places(some, lengths, runs=False).join(first, "_hash").select(*pair, (F.col("_place") - F.col("_at")).alias("_start")).distinct()
    starts = starts.groupBy(*pair).agg(F.collect_list("_start").alias("_starts"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t"))
    mine = held.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"), F.col("_item").alias("_own"), F.col("_reading").alias("_read"), "_all")
    starts = starts.join(mine, same & (F.col("_item") == F.col("_own")) & (F.col("_reading") == F.col("_read"))).drop("_i", "_t", "_own", "_read")
    values = some.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"), marked(F.col("_raw")).alias("_marks"))
    values = values.select("_i", "_t", *(tokens((template if r == PLAIN else slotted)(F.col("_marks"), r)).alias(f"_t{r}") for r in readings))
    both = starts.join(values, same).withColumn("_tokens", F.when(F.col("_reading") == INNER, F.col("_t0")).when(F.col("_reading") == CAPITALS, F.col("_t1")).otherwise(F.col("_t2"))).drop("_i", "_t", "_t0", "_t1", "_t2")
    both = both.join(items.withColumn("_n", F.least(F.size("_words"), F.lit(WINDOW))), ["_item", "_reading"])
    # stretches of the document that read alike are one alignment
    stretch = lambda at: F.slice("_tokens", F.greatest(at, F.lit(0)) + 1, F.size("_words") + F.least(at, F.lit(0)))
    alike = F.array_sort(F.transform("_starts", lambda at: F.struct(F.xxhash64(stretch(at), F.least(at, F.lit(0))).alias("hash"), at.alias("start"))))
    both = both.select("*", F.explode(F.array(alike)).alias("_sorted")).drop("_starts")  # explode: worked out once
    alike = F.filter("_sorted", lambda x, i: (i == 0) | (F.get("_sorted", i - 1)["hash"] != x["hash"]))
    both = both.select(*pair, "_all", "_n", "_words", "_values", F.explode(F.transform(alike, lambda x: F.struct(x["start"].alias("start"), stretch(x["start"]).alias("text")))).alias("_x"))
    both = both.join(small(stash(listed, "listed")), ["_item", "_reading"]).withColumns({"_start": F.col("_x.start"), "_stretch": F.col("_x.text")}).drop("_x")
    there = lambda i: F.get("_stretch", i + F.least(F.col("_start"), F.lit(0)))
    plain = F.col("_reading") == PLAIN
    mark = lambda w: F.when(is_slot(w) & ~plain, F.left(w, F.lit(1))).otherwise(w)
    match = F.transform("_words", lambda w, i: F.coalesce(w == mark(there(i)), F.lit(False)))
    both = both.select("*", F.explode(F.array(match)).alias("_match"))
    both = both.withColumn("_hits", F.filter("_windows", lambda w: F.forall(F.slice("_match", w["_at"] + 1, window), lambda m: m)))
    equal = lambda i: F.get("_words", i).isNull() | F.get("_words", i).eqNullSafe(there(i))
    slot = F.filter(
        F.transform("_values", lambda v, i: F.struct(F.when(plain, F.get(F.col("_words"), i)).otherwise(v).alias("was"), there(i).alias("is"), (is_slot(v) & F.when(plain, equal(i - 1) & equal(i + 1)).otherwise(F.left(v, F.lit(1)) == F.left(there(i), F.lit(1)))).alias("ok"))),
        lambda p: p["ok"] & p["is"].isNotNull(),
    )
    both = both.withColumn("_slots", slot)
    first = F.transform("_slots", lambda p: F.struct(F.substring_index(p["was"], "_", 1).alias("was"), F.substring_index(p["is"], "_", 1).alias("is")))  # of a name its first word
    both = both.withColumn("_first", first)
    both = both.withColumn("_ok", F.size(F.array_distinct("_first")) == F.size(F.array_distinct(F.transform("_first", lambda p: p["was"]))))
    kind = F.when(F.forall("_slots", lambda p: p["was"] == p["is"]), "verbatim").otherwise("reparameterised")
    both = both.withColumns({"_count": F.size("_windows"), "_n": F.size("_hits"), "_b": F.struct((kind != "verbatim").alias("rank"), "_reading", (-F.size("_hits")).alias("less"), "_start", F.size("_windows").cast("long").alias("_windows"), F.size("_hits").cast("long").alias("_n"), kind.alias("kind"), F.size("_slots").alias("slots"))})
    ok = lambda c: F.when(F.col("_ok"), c)
    both = both.groupBy(*pair, "_all").agg(F.first("_windows").alias("_windows"), F.max("_n").alias("_most"), F.max(ok(F.col("_n"))).alias("_n"), F.min(ok(F.col("_b"))).alias("_b"), F.array_distinct(F.flatten(F.collect_list(ok(F.transform("_hits", lambda w: w["_hash"]))))).alias("_kinds"))
    both = both.withColumn("_found", F.size(F.filter("_windows", lambda w: F.array_contains("_kinds", w["_hash"]))))
    covered = lambda c: F.col(c) >= COVERED * F.size("_windows")
    both = both.where(covered("_all") | (F.col("_most") >= ALIGNED - WINDOW + 1)).where(covered("_found") | (F.col("_n") >= F.least(F.col("_most"), F.lit(ALIGNED - WINDOW + 1))))
    both = both.withColumn("_b", F.col("_b").withField("_found", F.col("_found")))
    best = both.groupBy("_id", "_text", "_item").agg(F.min("_b").alias("_b"))
    return best.select(F.col("_id").alias(key), F.col("_text").alias("text_hash"), F.col("_item").alias(item), "_b.kind", F.col("_b._windows").alias("windows"), F.col("_b._found").cast("long").alias("found"), F.col("_b._n").alias("aligned"), F.col("_b._start").cast("long").alias("start"), F.col("_b.slots").cast("long").alias("slots"), F.element_at(F.array(*(F.lit(x) for x in ("inner", "capitals", "plain"))), F.col("_b._reading") + 1).alias("reading"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; a row goes if its key and text do, also where the key is null."""
    gone = stash(leaks(docs, benchmark, key, text).select(F.col(key).alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct(), "gone")
    same = F.col(key).eqNullSafe(F.col("_gone")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_gone_text"))
    return docs.join(small(gone), same, "left_anti")
