"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import small, small_batches, stash

#: Grams in a profile, longest gram, and labelled documents of each language that profiles are learned from at most.
PROFILE, LONGEST, LEARN = 400, 3, 1000
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18
UNKNOWN = "und"
SPAN = 1 << 40
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _profiles(texts: list[str], longest: int = LONGEST) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, bits, text, gram, count, letters): the distinct grams of each text with their counts, by text and gram.

    Texts are lower-cased; runs of anything but letters become one mark (code point 0). Grams have 1 to `longest`
    code points; marks stand only at their ends, and never alone. A gram is a number of `bits` a code point, each code
    being 1 + its place in the sorted alphabet, so the numbers order grams by length and code points whatever the chunk.
    """
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32) for t in texts]
    size = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    flat = np.where(_is_letter()[flat], flat, np.uint32(0))
    text = np.repeat(np.arange(len(texts)), size)
    first = np.zeros(len(flat), bool)
    first[np.cumsum(size)[:-1]] = True
    keep = (flat != 0) | first
    keep[1:] |= flat[:-1] != 0
    keep[0] = True
    flat, text = flat[keep], text[keep]
    alphabet = np.union1d(flat, np.zeros(1, np.uint32))
    bits = int(len(alphabet) + 1).bit_length()
    code = np.searchsorted(alphabet, flat) + 1
    letter = flat != 0
    letters = np.bincount(text[letter], minlength=len(texts))
    found = []
    for n in range(1, longest + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        gram, inner = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(n):
            gram = gram << bits | code[i : i + m]
            if 0 < i < n - 1 or n == 1:
                inner &= letter[i : i + m]
        inner &= text[:m] == text[n - 1 :]
        if n == 2:
            inner &= letter[:m] | letter[1:]
        found.append(text[:m][inner] << (longest * bits) | gram[inner])
    full, count = np.unique(np.concatenate(found), return_counts=True)
    return alphabet, bits, full >> (longest * bits), full & ((1 << longest * bits) - 1), count, letters


def _spelled(alphabet: np.ndarray, bits: int, gram: np.ndarray, longest: int = LONGEST) -> list[str]:
    """Grams as texts, with a space for the mark."""
    letters = [" " if c == 0 else chr(c) for c in alphabet]
    return ["".join(letters[(g >> s & (1 << bits) - 1) - 1] for s in range((longest - 1) * bits, -1, -bits) if g >> s) for g in gram.tolist()]


def _numbers(grams: list[str], alphabet: np.ndarray, bits: int) -> np.ndarray:
    """Grams as numbers of a chunk's alphabet; -1 where it lacks a letter."""
    place = {(" " if c == 0 else chr(c)): i + 1 for i, c in enumerate(alphabet.tolist())}
    out = np.full(len(grams), -1, np.int64)
    for k, g in enumerate(grams):
        n = 0
        for c in g:
            if c not in place:
                break
            n = n << bits | place[c]
        else:
            out[k] = n
    return out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first, after the last, texts) of stretches of a column, nulls as empty; only one stretch at a time is made Python strings."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        held, j = 0, i
        while j < len(texts) and (j == i or held + size[j] <= CHUNK) and j - i < 512:
            held += size[j]
            j += 1
        yield i, j, [t or "" for t in texts.slice(i, j - i).to_pylist()]
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams by language, summed inside each chunk."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, j, texts in _chunks(batch.column(1)):
            alphabet, bits, text, gram, count, _ = _profiles(texts)
            names = sorted(set(langs[i:j]))
            lang = np.array([names.index(x) for x in langs[i:j]])[text]
            for k, name in enumerate(names):
                own, at = np.unique(gram[lang == k], return_inverse=True)
                total = np.bincount(at, weights=count[lang == k], minlength=len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(_spelled(alphabet, bits, own), pa.string()), pa.array(total)], ["lang", "gram", "n"])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LEARN, size: int = PROFILE) -> dict[str, list[str]]:
    """Profiles: for each language its `size` most frequent grams in order (ties by code points).

    Learned from at most `most` documents of each language, the first by a hash of key and text. Rows that repeat both
    count once, so the hashes of a language differ and are even: those above twice the share that `most` has of the
    language are left out before anything is sorted, and a task orders some 2 * most short rows, whatever the language's
    size. Rows that share a key alone are documents of their own. Rows with a null language or text are left out; a
    null key is a key like any other. The profiles, `size` grams a language, are what the driver gets; none for an empty table.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = labelled.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.col(key), F.col(text)).alias("_h"))
    slim = stash(hashed.select(F.col("_l").alias("_lang"), "_h").distinct(), "labelled")
    counts = small(stash(slim.groupBy("_lang").agg(F.count("*").alias("_of")), "languages"))
    near = slim.join(counts, "_lang").where(F.pmod("_h", F.lit(SPAN)) <= F.lit(2.0 * most * SPAN) / F.col("_of"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(SPAN)), "_h"))
    chosen = small(stash(near.withColumn("_n", rank).where(F.col("_n") <= most).select("_lang", F.col("_h").alias("_hash")), "chosen"))
    rows = hashed.join(chosen, (F.col("_l") == F.col("_lang")) & (F.col("_h") == F.col("_hash")), "left_semi").groupBy("_l", "_h").agg(F.first("_t").alias("_t"))
    counts = rows.select("_l", "_t").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.length("gram"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(top, key=lambda r: (r.lang.encode(), r.place)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _distances(texts: list[str], profiles: dict[str, list[str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance of each text to each profile, grams in each text's profile, its letters)."""
    alphabet, bits, text, gram, count, letters = _profiles(texts)
    by = np.argsort((text << 40) - count, kind="stable")  # by text, then count, then gram
    text, gram = text[by], gram[by]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    top = place < size
    text, gram, place = text[top], gram[top], place[top]
    out = np.zeros((len(texts), len(profiles)))
    for k, grams in enumerate(profiles.values()):
        known = _numbers(grams, alphabet, bits)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], gram), len(known) - 1)
        away = np.where(known[order][at] == gram, np.abs(order[at] - place), size)
        out[:, k] = np.bincount(text, weights=away, minlength=len(texts))
    return out, np.bincount(text, minlength=len(texts)), letters


def identify(text: Column, profiles: dict[str, list[str]], size: int = PROFILE) -> Column:
    """struct(lang, score): the language whose profile is least out of place, ties to the first by code point.

    A text's own profile holds its `size` most frequent grams; a gram's distance is the difference of its places in the
    two profiles, or `size` if the language's lacks it. score is 1 - distance / (size * grams of the text), from 0 to 1.
    A null text, one without letters, and any text where nothing was learned, is UNKNOWN with score 0. Texts are taken whole.
    """
    names = [*profiles, UNKNOWN]
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang string, score double>")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for i, j, texts in _chunks(batch):
                if len(names) == 1:
                    langs += [UNKNOWN] * (j - i)
                    scores.append(np.zeros(j - i))
                    continue
                away, grams, letters = _distances(texts, profiles, size)
                best = np.where(letters > 0, away.argmin(1), len(names) - 1)
                langs += [names[b] for b in best.tolist()]
                scores.append(np.where(letters > 0, 1 - away.min(1) / np.maximum(grams * size, 1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], fields=list(kind))

    return identified(text)


def held_out(key: Column) -> Column:
    """Whether the crc32 of the key's text leaves 1 when divided by 3; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predicted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score; profiles are learned from the rows that are not held out.

    Only the text is an input of a prediction. Columns named like the new ones are replaced. Map-only after learning.

    Null, empty and letterless texts are `und` with score 0; texts are taken whole, a long one alone in its chunk; ties go
    to the first language by code point; each repeated row gets its row; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    profiles = learn(docs.where(~held_out(F.col(key))), key, text, lang)
    rows = docs.drop("held_out", "lang_pred", "score").withColumns({"held_out": held_out(F.col(key)), "_found": identify(F.col(text), profiles)})
    return rows.withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")
