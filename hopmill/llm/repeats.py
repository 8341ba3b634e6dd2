"""Passages that repeat across documents: suffix arrays of shards, common prefixes, and a merge of shards by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmill.llm.arrays import flat, mixed, powers, prefix_hashes
from hopmill.llm.common import release, reuse, small_batches, stash

#: Bytes of text in a shard, which has one suffix array, and in a bundle of shards, which is a row and what merges answer to.
SHARD, BUNDLE = 1 << 17, 1 << 20
#: Every string of `length` bytes holds SPREAD substrings of length - SPREAD + 1 bytes; the one of least hash is its key.
SPREAD = 24
#: Keys, and bytes of text, that one task of a merge should hold; bytes of marks that are broadcast at most.
MERGE, MERGE_BYTES, MARKS = 1_000_000, 1 << 21, 64 << 20
#: Bytes of stretches in one suffix array of a merge, whole keys at a time.
SUFFIXES = 1 << 17
#: A key is hot, and merged by window, if more than HOT bundles (or `hot`) hold it; a bundle with more than HEAVY stretches of it counts for as many.
HOT, HEAVY = 1024, 16
#: Windows hashed at a time, and the bits that the place of a substring among theirs takes.
BLOCK, PLACE_BITS = 1 << 15, 24
#: Positions that one lane of Kasai's walk visits in turn.
WALK = 8
#: Neighbours in a suffix array that differ in as many bytes are not walked; repeats are no shorter.
TOLD = 32
#: What a row sent to a merge holds.
KEYS, STRETCHES, WINDOWS = 0, 1, 2
NO_ID = np.iinfo(np.int64).max
#: How bundles are written: a page of one row, since codecs hold whole pages in buffers outside the heap.
PAGE_A_ROW = {"parquet.page.row.count.limit": "1"}


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their first `depth` bytes at least, 8-byte words by position), after Larsson and Sadakane.

    Ranks by the first 8 bytes, then twice as many in each round; only groups that are still tied are sorted again, by
    the rank of what follows them. Positions tied to the end stay in one group, in any order.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    word = np.ndarray(n + depth + 8, ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(word[:n])
    sorted_words = word[order]
    first = np.concatenate(([True], sorted_words[1:] != sorted_words[:-1]))
    rank = np.zeros(n + 1, np.int64)  # a group's rank is 1 + the place of its first member; 0 is the end of the text
    heads = np.flatnonzero(first)
    rank[order] = np.repeat(heads + 1, np.diff(heads, append=n))
    h = 8
    while h < depth:
        tied = ~first | np.concatenate((~first[1:], [False]))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        key = (rank[who] << 32) | rank[np.minimum(who + h, n)]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        first[at[1:]] = key[1:] != key[:-1]  # at[0] starts a group anyway
        starts = np.maximum.accumulate(np.where(first[at], at, 0))
        rank[who] = starts + 1
        h *= 2
    return order, word


def _agreeing(odd: np.ndarray) -> np.ndarray:
    """How many of its upper bytes a word is 0 in: 8 less the bytes of its highest bit (of which rounding to a float must keep the place)."""
    return 7 - (np.frexp((odd & ~(odd >> np.uint64(1))).astype(np.float64))[1] - 1 >> 3)


def common_prefixes(order: np.ndarray, word: np.ndarray, depth: int, least: int = 8) -> np.ndarray:
    """Kasai's array, cut at depth: bytes that the suffix at each place shares with the one before it (0 for the first).

    Neighbours that differ in their first `least` bytes (a multiple of 8) are told at once, and given as 0 if that is more
    than 8. The other positions are visited in the order of the text: from one to the next the shared bytes fall by one
    at most, so each visit goes on from there; only after one that shares all of `depth`, beyond which the order is open,
    it starts anew. Lanes of WALK positions walk side by side.
    """
    n = len(order)
    shared, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if least == 8:
        p, q = order[1:], order[:-1]
        shared[p] = _agreeing(word[p] ^ word[q])
    else:
        ahead = word[least - 8 :][order]  # bytes further on tell more neighbours apart
        at = np.flatnonzero(ahead[1:] == ahead[:-1])
        p, q = order[at + 1], order[at]
        for k in range(0, least - 8, 8):
            on = word[p + k] == word[q + k]
            p, q = p[on], q[on]
        shared[p] = least
    before[p] = q
    last = np.zeros(-(-n // WALK), np.int64)
    for step in range(min(WALK, n)):
        lane = np.flatnonzero(shared[step::WALK] == least)
        p = lane * WALK + step
        q = before[p]
        h = np.where(last[lane] < depth, np.maximum(last[lane] - 1, least), least)
        on = np.arange(len(p))
        while len(on):
            more = _agreeing(word[p[on] + h[on]] ^ word[q[on] + h[on]])
            h[on] += more
            on = on[(more == 8) & (h[on] < depth)]
        last[:] = 0
        last[lane] = h
        shared[p] = h
    return np.minimum(shared, depth)[order]


def repeated_inside(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of `length` bytes that also start in a document of the shard with a smaller id, as a mask of the bytes.

    Neighbours in the suffix array with a common prefix of `length` bytes or more are one class of equal windows.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < length:
        return out
    order, word = suffix_array(data, length)
    again = common_prefixes(order, word, length, TOLD) >= length
    at = np.flatnonzero(again | np.append(again[1:], False))  # places in classes of two or more
    where = order[at]
    rank = np.unique(ids, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, where, "right")
    whole = where + length <= ends[doc]
    who = np.where(whole, rank[doc], len(ids))
    heads = np.flatnonzero(~again[at])
    least = np.minimum.reduceat(who, heads) if len(at) else who
    out[where] = whole & (np.repeat(least, np.diff(heads, append=len(at))) < who)
    return out


def key_places(hashes: np.ndarray) -> np.ndarray:
    """For each run of SPREAD hashes (2**PLACE_BITS at most) the place of the least by its upper bits; the first of equal ones."""
    m = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    for gap in (1, 2, 4, 8):
        m = np.minimum(m[:-gap], m[gap:])
        if gap == 4:
            eight = m
    return (np.minimum(m[:-8], eight[16:]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def _unlike(text: np.ndarray, begin: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of stretches in some order, whether each differs from the one before it; where same is False they do anyway."""
    out = ~same
    at = np.flatnonzero(same)
    at = at[at > 0]
    out[at] = size[at] != size[at - 1]
    at = at[~out[at]]
    k = 0
    while len(at):
        odd = text[begin[at] + k] != text[begin[at - 1] + k]
        out[at[odd]] = True
        k += 1
        at = at[~odd & (size[at] > k)]
    return out


def _window_prints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window at each place."""
    prints = np.zeros(len(at), np.uint64)
    for k in range(length):
        prints = mixed(prints + data[at + k] + np.uint64(1))
    return prints


def _words(windows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, the last one filled up."""
    out = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), np.uint8)
    out[:, : windows.shape[1]] = windows
    return out.view(np.uint64)


def _by_bytes(prints: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and by bytes where hashes are equal, and what differs in it from the one before."""
    by = np.argsort(prints, kind="stable")
    for again in (False, True):
        if again:
            by = np.lexsort((*words.T, prints))
        same = prints[by][1:] == prints[by][:-1]
        unlike = np.append(True, (words[by][1:] != words[by][:-1]).any(1))
        if not (unlike[1:] & same).any():
            break
    return by, unlike


def _shards(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, end, first document, after the last) of a bundle's shards: whole documents, or a long one's pieces, which overlap by length - 1 bytes."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SHARD, "right")) - 1)
        for a in range(offsets[i], offsets[j], SHARD) if offsets[j] - offsets[i] > SHARD else [offsets[i]]:
            yield int(a), int(min(a + SHARD + length - 1, offsets[j])), i, j
        i = j


def _runs(data: np.ndarray, sizes: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` bytes with their key in the same place: first and last window start, document, key, and hash of the stretch.

    All windows of a run lie in `length` + SPREAD - 1 bytes. Runs of repeats inside the shard alone are left out: the heads
    of their classes are in other runs.
    """
    n, k = len(data), length - SPREAD + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix, back = prefix_hashes(data), powers(n + 1)[1]
    hashes, place = np.empty(n - k + 1, np.uint64), np.empty(n - length + 1, np.int64)
    for at in range(0, len(place), BLOCK):  # in blocks that the processor's cache holds
        m = min(BLOCK, len(place) - at) + SPREAD - 1
        hashes[at : at + m] = (prefix[at + k : at + k + m] - prefix[at : at + m]) * back[at : at + m]
        place[at : at + BLOCK] = key_places(hashes[at : at + m]) + at
    windows = np.maximum(sizes - length + 1, 0)
    whole = np.repeat(np.tile([True, False], len(sizes)), np.stack((windows, sizes - windows), axis=1).ravel())[: len(place)]
    same = place[1:] == place[:-1]
    first, last = whole.copy(), whole.copy()
    first[1:] &= ~(whole[:-1] & same)  # windows of two documents have others between them that cross their border
    last[:-1] &= ~(whole[1:] & same)
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    done = np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
    new = done[last + 1] - done[first] <= last - first
    first, last = first[new], last[new]
    doc = np.searchsorted(np.cumsum(sizes), first, "right")
    prints = _prints(prefix, first, last - first + length)
    return first, last, doc, mixed(hashes[place[first]]), prints  # least hashes are small ones: spread them


def _prints(prefix: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches. They only bring equal stretches together; the bytes decide."""
    return mixed((prefix[first + size] - prefix[first]) * powers(len(prefix))[1][first] + size.astype(np.uint64))


class Bundle:
    """A row's documents, and the runs of windows of its shards."""

    def __init__(self, row: dict, length: int):
        self.ids, self.sizes, self.data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
        self.offsets, self.length = np.concatenate(([0], np.cumsum(self.sizes))), length
        self.inside = np.unpackbits(np.frombuffer(row["inside"] or b"", np.uint8), count=len(self.data)).astype(bool) if row["inside"] else np.zeros(len(self.data), bool)
        found = []
        for a, b, i, j in _shards(self.offsets, length):
            first, last, doc, keys, prints = _runs(self.data[a:b], np.diff(np.clip(self.offsets[i : j + 1], a, b)), self.inside[a:b], length)
            found.append((first + a, last + a, doc + i, keys, prints))
        self.first, self.last, self.doc, keys, self.prints = (np.concatenate(x) for x in zip(*found, strict=True))
        self.keys, self.of = np.unique(keys, return_inverse=True)  # the bundle's keys, sorted; of each run
        low, high = np.full(len(self.keys), NO_ID), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.ids[self.doc])
        np.maximum.at(high, self.of, self.ids[self.doc])
        self.twice = low != high  # keys in two documents of the bundle

    def variants(self, hit: np.ndarray) -> None:
        """Tell apart the stretches of the runs whose key is hit, by key and bytes: each one's run, and its smallest id."""
        self.run = np.flatnonzero(hit[self.of])
        self.variant, self.least, self.head = np.zeros(0, np.int64), np.zeros(0, np.int64), self.run
        if not len(self.run):
            return
        begin, size = self.first[self.run], self.last[self.run] - self.first[self.run] + self.length
        prints = self.prints[self.run]
        by = np.lexsort((prints, self.of[self.run]))
        key, prints = self.of[self.run][by], prints[by]
        same = np.concatenate(([False], (key[1:] == key[:-1]) & (prints[1:] == prints[:-1])))
        new = _unlike(self.data, begin[by], size[by], same)
        heads = np.flatnonzero(new)
        self.variant = np.empty(len(by), np.int64)
        self.variant[by] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.ids[self.doc[self.run]][by], heads)
        self.head = self.run[by[heads]]  # one run of each variant, by key

    def windows(self, hot: np.ndarray) -> None:
        """The windows under hot keys: each one's place and document's id; and the distinct ones by hash and bytes: a place of each, with the smallest id in the bundle."""
        run = np.flatnonzero(hot[self.of])
        self.hot_hash, self.hot_least = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hot_at = self.hot_of = self.hot_id = self.hot_head = np.zeros(0, np.int64)
        if not len(run):
            return
        many = self.last[run] - self.first[run] + 1
        at = np.repeat(self.first[run], many) + _steps(many)
        fresh = ~self.inside[at]
        self.hot_at = at = at[fresh]
        self.hot_id = np.repeat(self.ids[self.doc[run]], many)[fresh]
        prints = _window_prints(self.data, at, self.length)
        by = np.argsort(prints, kind="stable")
        same = np.append(False, prints[by][1:] == prints[by][:-1])
        new = _unlike(self.data, at[by], np.full(len(at), self.length), same)
        if (new & same).any():  # different bytes under one hash
            by, new = _by_bytes(prints, _words(self.data[at[:, None] + np.arange(self.length)]))
        heads = np.flatnonzero(new)
        self.hot_of = np.empty(len(by), np.int64)
        self.hot_of[by] = np.cumsum(new) - 1
        self.hot_hash, self.hot_head = prints[by[heads]], at[by[heads]]
        self.hot_least = np.minimum.reduceat(self.hot_id[by], heads)

    def covered(self, marks: list, cuts: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Bytes under a window that also starts in a document with a smaller id: known inside a shard, or by the
        merges' marks of the variants' windows and of the windows under hot keys."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        found = [np.flatnonzero(self.inside), self.hot_at[hot[self.hot_of] | (self.hot_id > self.hot_least[self.hot_of])]]
        if len(self.run):
            count = self.last[self.head] - self.first[self.head] + 1
            ends = np.concatenate(([0], np.cumsum(count)))
            marked = np.zeros(ends[-1], bool)
            for m in marks:
                a, b = ends[cuts[m["range"]]], ends[cuts[m["range"] + 1]]
                marked[a:b] = np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=b - a).astype(bool)
            # a mark is about a variant's smallest id
            many = self.last[self.run] - self.first[self.run] + 1
            step = _steps(many)
            later = self.ids[self.doc[self.run]] > self.least[self.variant]
            gone = marked[np.repeat(ends[self.variant], many) + step] | np.repeat(later, many)
            found.append((np.repeat(self.first[self.run], many) + step)[gone])
        for at in found:  # each of them without repeats
            edge[at] += 1
            edge[at + self.length] -= 1
        return np.cumsum(edge[:-1]) > 0


def _steps(many: np.ndarray) -> np.ndarray:
    """0 .. m - 1 for each m, one after another."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _bits(marks: list, keys: np.ndarray, bits: int, field: str = "marks") -> np.ndarray:
    """A merge's marks for sorted keys, given as packed bits for each range of their top bits (none where null)."""
    out = np.zeros(len(keys), bool)
    cuts = _cuts(keys, bits)
    for m in marks:
        if m[field] is not None:
            a, b = cuts[m["range"]], cuts[m["range"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(m[field], np.uint8), count=b - a).astype(bool)
    return out


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate((np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]))


def _packed(length: int):
    """Whole documents packed into bundles, each with the mask of what repeats inside its shards; numbers are unique over all tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse()
        base, count = TaskContext.get().partitionId() << 33, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def bundle() -> pa.RecordBatch:
            who, size, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(parts)
            inside = np.zeros(len(data), bool)
            for a, b, i, j in _shards(np.concatenate(([0], np.cumsum(size))), length):
                if j - i > 1:  # one document repeats no other
                    inside[a:b] = repeated_inside(data[a:b], size[i:j], who[i:j], length)
            row = [base + count, who.tobytes(), size.tobytes(), data.tobytes(), np.packbits(inside).tobytes() if inside.any() else None]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["bundle", "ids", "sizes", "data", "inside"])

        for batch in batches:
            data, offsets = flat(batch.column(1))
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            weight = offsets + np.arange(len(offsets))  # a document counts as a byte more, so empty ones fill bundles, too
            i = 0
            while i < len(keys):
                j = max(i + (not ids), int(np.searchsorted(weight, weight[i] + BUNDLE - held, "right")) - 1)
                if j > i:
                    ids.append(keys[i:j])
                    sizes.append(np.diff(offsets[i : j + 1]))
                    parts.append(data[offsets[i] : offsets[j]].copy())
                    held += int(weight[j] - weight[i])
                i = j
                if held >= BUNDLE or i < len(keys):
                    yield bundle()
                    ids, sizes, parts, held, count = [], [], [], 0, count + 1
                    release()
        if ids:
            yield bundle()

    return of


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    reuse()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            for name in ("marks", "more"):
                row[name] = pa.ipc.open_stream(row[name]).read_all().to_pylist() if row.get(name) else []
            yield row
            del row
            release()


def _marks_of(row: dict, name: str, kind: int) -> list[dict]:
    return [m for m in row[name] if m["kind"] == kind]


def _looked_at(row: dict, length: int, bits: int) -> Bundle:
    """The row's bundle with the stretches of its hit keys and the windows of its hot ones."""
    b = Bundle(row, length)
    hot = _bits(row["marks"], b.keys, bits, "hot")
    b.variants((_bits(row["marks"], b.keys, bits) | b.twice) & ~hot)
    b.windows(hot)
    return b


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values cut from data, an array of any fixed width, at ends (the first is 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sent(row: dict, kind: int, cuts: np.ndarray, **columns: tuple) -> pa.RecordBatch:
    """A row for each range that holds something; columns: an array, and where its ranges' parts end if not at cuts."""
    some = np.flatnonzero(np.diff(cuts))
    at = np.append(some, len(cuts) - 1)
    known = {"kind": np.full(len(some), kind, np.int32), "range": some.astype(np.int32), "bundle": np.full(len(some), row["bundle"])}
    given = {k: _binary(x, (ends if len(ends) else cuts)[at]) if len(x) or len(some) else pa.array([], pa.binary()) for k, (x, ends) in columns.items()}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in known.items()} | given)


def _received(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array of a fixed width, and how many each row has."""
    data, offsets = flat(pa.concat_arrays(column.chunks))
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _marked(rows: pa.Table, sizes: np.ndarray, **masks: np.ndarray) -> pa.Table:
    """A merge's rows that have marks: packed bits of each row's part of the masks, null where none is set."""
    bytes_ = np.concatenate(([0], np.cumsum((sizes + 7) // 8)))
    first = np.cumsum(sizes) - sizes
    at = np.repeat(8 * bytes_[:-1] - first, sizes) + np.arange(sizes.sum())
    out = {k: rows[k] for k in ("kind", "range", "bundle")}
    for name, mask in masks.items():
        bits = np.zeros(8 * bytes_[-1], bool)
        bits[at] = mask
        some = np.logical_or.reduceat(mask, first)
        out[name] = pc.if_else(pa.array(some), _binary(np.packbits(bits), bytes_), pa.scalar(None, pa.binary()))
    return pa.table(out | ({} if "hot" in out else {"hot": pa.nulls(len(rows), pa.binary())})).filter(pa.array(np.logical_or.reduceat(masks["marks"], first)))


def _by_bundle(rows: pa.Table) -> pa.Table:
    """All marks of a bundle in one value, an Arrow stream of (kind, range, marks, hot)."""
    sink = pa.BufferOutputStream()
    table = rows.select(["kind", "range", "marks", "hot"]).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.table({"bundle": pa.array([rows["bundle"][0].as_py()], pa.int64()), "marks": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _keys_sent(length: int, bits: int):
    """For each bundle and range the sorted keys, as the 32 bits below the range's, and place and count of keys with many stretches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Bundle(row, length)
            cuts = _cuts(b.keys, bits)
            count = np.bincount(b.of, minlength=len(b.keys))
            at = np.flatnonzero(count > HEAVY)
            heavy = np.stack((at - cuts[np.searchsorted(cuts, at, "right") - 1], count[at]), axis=1).ravel()
            yield _sent(row, KEYS, cuts, sent=((b.keys >> np.uint64(32 - bits)).astype(np.uint32), ()), heavy=(heavy, 2 * np.searchsorted(at, cuts)))

    return of


def _keys_merged(most: int):
    def of(rows: pa.Table) -> pa.Table:
        """Keys of two bundles or more, and those of them that are hot: each bundle's sorted run is looked up in them by binary search."""
        release()
        keys, sizes = _received(rows["sent"], np.uint32)
        first = np.cumsum(sizes) - sizes
        new = np.append(True, keys[1:] != keys[:-1])
        new[first] = True
        every = np.sort(keys[new])
        common, weight = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        if not len(common):
            return _marked(rows, sizes, marks=np.zeros(len(keys), bool), hot=np.zeros(len(keys), bool))
        weight += 1  # bundles
        place = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        hit = common[place] == keys
        heavy, pairs = _received(rows["heavy"], np.int64)
        at = heavy[::2] + np.repeat(first, pairs // 2)
        np.add.at(weight, place[at[hit[at]]], heavy[1::2][hit[at]] - 1)
        return _marked(rows, sizes, marks=hit, hot=hit & (weight[place] > most))

    return of


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after another; a few at a time, since places take 8 bytes for each byte."""
    parts = [data[_steps(n) + np.repeat(a, n)] for a, n in ((first[k : k + 4096], size[k : k + 4096]) for k in range(0, len(size), 4096))]
    return np.concatenate([data[:0], *parts])


def _variant_cuts(b: Bundle, bits: int) -> np.ndarray:
    return _cuts(b.keys[b.of[b.head]], bits)


def _stretches_sent(length: int, bits: int, bits2: int):
    """For each bundle and range of keys the distinct stretches that may repeat, with each one's length and smallest id;
    for each range of hashes the distinct windows under hot keys, with each one's smallest id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _looked_at(row, length, bits)
            if len(b.head):
                first, size = b.first[b.head], b.last[b.head] - b.first[b.head] + length
                cuts = _variant_cuts(b, bits2)
                low = (b.keys[b.of[b.head]] >> np.uint64(32 - bits2)).astype(np.uint32)
                text = _gathered(b.data, first, size), np.concatenate(([0], np.cumsum(size)))[cuts]
                yield _sent(row, STRETCHES, cuts, sent=(low, ()), more=((size - length).astype(np.uint8), ()), least=(b.least, ()), text=text)
            if len(b.hot_hash):
                cuts = _cuts(b.hot_hash, bits2)
                text = _gathered(b.data, b.hot_head, np.full(len(b.hot_head), length)), length * cuts
                yield _sent(row, WINDOWS, cuts, sent=(b.hot_hash, ()), more=(np.zeros(0, np.uint8), 0 * cuts), least=(b.hot_least, ()), text=text)

    return of


def _stretches_merged(length: int):
    def of(rows: pa.Table) -> pa.Table:
        release()
        return (_windows_merged(length) if rows["kind"][0].as_py() == WINDOWS else _variants_merged(length))(rows)

    return of


def _variants_merged(length: int):
    def of(rows: pa.Table) -> pa.Table:
        """Windows of which another stretch with a smaller id has the bytes.

        Equal stretches are one, with the smallest id of all. Under a key with one stretch all windows share that id;
        stretches that share a key and differ go into a suffix array, whose classes of windows have the smallest ids.
        """
        more, sizes = _received(rows["more"], np.uint8)
        ids, key, text = (_received(rows[c], t)[0] for c, t in (("least", np.int64), ("sent", np.uint32), ("text", np.uint8)))
        windows = more.astype(np.int64) + 1
        size = windows + length - 1
        begin = np.cumsum(size) - size
        prints = _prints(prefix_hashes(text), begin, size)
        by = np.lexsort((prints, key))
        key, prints = key[by], prints[by]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = _unlike(text, begin[by], size[by], ~(new_key | np.concatenate(([True], prints[1:] != prints[:-1]))))
        heads = np.flatnonzero(new)  # of distinct stretches
        stretch = np.empty(len(by), np.int64)
        stretch[by] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[by], heads)
        number = np.cumsum(new_key)[heads] - 1  # of each stretch's key
        count = windows[by[heads]]
        ends = np.concatenate(([0], np.cumsum(count)))
        smallest = np.repeat(least, count)  # of each window of each distinct stretch
        differing = np.flatnonzero(np.bincount(number)[number] > 1)
        room = np.cumsum(size[by[heads[differing]]]) // SUFFIXES
        turn = np.flatnonzero(np.diff(number[differing], prepend=-1))
        cut = turn[1:][room[turn[1:]] != room[turn[:-1]]]  # some whole keys at a time
        for some in np.split(differing, cut) if len(differing) else []:
            first, own = by[heads[some]], count[some]
            part = _gathered(text, begin[first], size[first])
            starts = np.cumsum(size[first]) - size[first]
            step = _steps(own)
            order, word = suffix_array(part, length)
            of_place = np.empty(len(part), np.int64)
            of_place[order] = np.cumsum(common_prefixes(order, word, length, TOLD) < length)
            mine = of_place[np.repeat(starts, own) + step]
            best = np.full(len(part) + 1, NO_ID)
            np.minimum.at(best, mine, np.repeat(least[some], own))
            smallest[np.repeat(ends[some], own) + step] = best[mine]
        less = smallest[np.repeat(ends[stretch], windows) + _steps(windows)] < np.repeat(ids, windows)
        return _marked(rows, np.add.reduceat(windows, np.cumsum(sizes) - sizes), marks=less)

    return of


def _windows_merged(length: int):
    def of(rows: pa.Table) -> pa.Table:
        """Windows under hot keys that another bundle has in a document with a smaller id than any of this one."""
        ids, sizes = _received(rows["least"], np.int64)
        prints, text = _received(rows["sent"], np.uint64)[0], _received(rows["text"], np.uint8)[0]
        by, new = _by_bytes(prints, _words(text.reshape(-1, length)))
        best = np.empty(len(ids), np.int64)
        best[by] = np.minimum.reduceat(ids[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        return _marked(rows, sizes, marks=best < ids)

    return of


def _removed(length: int, bits: int, bits2: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _looked_at(row, length, bits)
            hot = _bits(_marks_of(row, "more", WINDOWS), b.hot_hash, bits2)
            gone = np.append(b.covered(_marks_of(row, "more", STRETCHES), _variant_cuts(b, bits2), hot), False)
            ids, size, data, offsets = b.ids, b.sizes, b.data, b.offsets
            start, end = gone[:-1].copy(), gone[:-1] & ~gone[1:]
            start[1:] &= ~gone[:-2]
            edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            start[edges] = gone[edges]  # runs do not cross documents
            end[edges - 1] = gone[edges - 1]
            start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
            doc = np.searchsorted(offsets, start, "right") - 1
            removed = np.zeros(len(size), np.int64)
            np.add.at(removed, doc, end - start)
            sha = [hashlib.sha256(data[a:b] if not n else data[a:b][~gone[a:b]]).hexdigest() for a, b, n in zip(offsets[:-1], offsets[1:], removed, strict=True)]
            spans = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(end - offsets[doc])], ["start", "end"])
            where = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32()), spans)
            count = np.bincount(doc, minlength=len(size))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(size), pa.array(removed), pa.array(count, pa.int64()), pa.array(sha), where], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return of


def _with_marks(bundles: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """bundles with the marks of each; they are broadcast if they are few bytes, else joined by a shuffle."""
    each = stash(marks.groupBy("bundle").applyInArrow(_by_bundle, "bundle long, marks binary"), "marks").withColumnRenamed("marks", name)
    size = each.agg(F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()[0]
    return bundles.join(F.broadcast(each) if size <= MARKS else each, "bundle", "left")


def _range_bits(amount: float, each: int) -> int:
    """Bits of a range's number, so that a range has about `each` of the amount."""
    return int(np.clip(np.ceil(np.log2(max(amount, 1) / each)), 5, 30))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row: bytes under a string of `length` bytes that also starts in a document with a smaller key.

    1. Whole documents are packed into shards, and shards into bundles, the rows that are written once and read by the
       passes below. Each shard gets its suffix array and the common prefixes of neighbours; runs of `length` or more are
       the classes of equal windows, and every window but those of a class's smallest document is a repeat. The passes
       deal with what that mask leaves: the heads of the classes.
    2. Each window of `length` bytes has a key (SPREAD), the same wherever the window stands; about one key serves 12
       windows. A bundle's sorted keys are sent to merges by range, which mark, by binary search in the keys they have
       in common, those of two bundles or more. A window whose key is in one document only cannot repeat; most of a
       corpus ends here.
    3. The stretches under the remaining keys (at most length + 23 bytes each) are sent, once from each bundle, to merges
       by range of keys, so equal windows meet. Stretches of equal bytes are one there; of stretches that differ under
       one key, a merge builds the suffix array and the common prefixes. A window is marked if its class has a smaller
       document key.
    4. Under a key held by more than `hot` bundles (HOT) stretches are not sent, since all of a key go to one task: each
       bundle sends each distinct window with its smallest document key, to merges by range of the window's hash.
    5. Marks give each bundle its removed bytes.

    A stretch or window of a hot passage is sent once by each bundle, whatever its count. Sending whole suffix arrays
    would take 8 bytes or more for each byte of the corpus; the keys (about a third of a byte for each byte) leave only
    what may repeat. Hashes only choose what meets, bytes decide what is equal, also under hot keys.

    Nulls: a null text is empty; a null key counts as larger than all others. Rows that share a key are not smaller than
    each other. spans are removed stretches (start, end in bytes). An empty table gives an empty one. Other columns are
    not read, whatever their names. A document longer than a shard is worked on in overlapping pieces (some 100 bytes of
    memory for each byte of a piece); only its text, a mask of its bytes and its runs are held whole.
    """
    if length < 32:
        raise ValueError("length must be at least 32 bytes")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    bundles = stash(slim.mapInArrow(_packed(length), "bundle long, ids binary, sizes binary, data binary, inside binary"), "bundles", **PAGE_A_ROW)
    total = bundles.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    bits, bits2 = _range_bits(total / 12, MERGE), _range_bits(total, MERGE_BYTES)
    spot = "kind int, range int, bundle long"
    marks = f"{spot}, marks binary, hot binary"
    keys = bundles.mapInArrow(_keys_sent(length, bits), f"{spot}, sent binary, heavy binary")
    marked = _with_marks(bundles, keys.groupBy("range").applyInArrow(_keys_merged(hot), marks), "marks")
    stretches = marked.mapInArrow(_stretches_sent(length, bits, bits2), f"{spot}, sent binary, more binary, least binary, text binary")
    both = _with_marks(marked, stretches.groupBy("kind", "range").applyInArrow(_stretches_merged(length), marks), "more")
    spans = "array<struct<start: long, end: long>>"
    out = both.mapInArrow(_removed(length, bits, bits2), f"_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {spans}")
    return out.withColumnRenamed("_id", key)
