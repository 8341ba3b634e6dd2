"""Name spotting: where the surfaces of an owner stand in the owner's texts, without a pair of surface and text in the plan.

Texts of an owner are dealt into slices and surfaces into parts, both of bounded size; a part meets a slice in one group,
where an automaton of its surfaces (a trie with failure links) reads each text once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of surfaces in a part, bytes of texts in a slice, groups for each shuffle partition.
PART, SLICE, GROUPS = 1 << 20, 8 << 20, 4


def _automata(owners: list, parts: list, surfaces: list) -> dict:
    own = defaultdict(list)
    for o, p, s in zip(owners, parts, surfaces, strict=True):
        own[o, p].append(s)
    out = {}
    for k, each in own.items():
        out[k] = a = ahocorasick.Automaton()
        for s in each:
            a.add_word(s, s)
        a.make_automaton()
    return out


def _read(owner: str, keys: list[str], once: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of(texts: pa.Table, surfaces: pa.Table) -> pa.Table:
        automata = _automata(*(surfaces[c].to_pylist() for c in ("_own", "_part", "_surface")))
        rows, found, starts = [], [], []
        for n, (o, p, t) in enumerate(zip(*(texts[c].to_pylist() for c in (owner, "_part", "_text")), strict=True)):
            seen = set()
            for end, s in automata[o, p].iter(t) if (o, p) in automata else ():
                if not once or s not in seen:
                    seen.add(s)
                    rows.append(n)
                    found.append(s)
                    starts.append(end + 1 - len(s))
        out = texts.select([owner, *keys]).take(pa.array(rows, pa.int64()))
        return out.append_column("surface", pa.array(found, pa.string())).append_column("start", pa.array(starts, pa.int32()))

    return of


def spotted(texts: DataFrame, surfaces: DataFrame, owner: str = "owner_id", keys: tuple[str, ...] = (), text: str = "text", surface: str = "surface", once: bool = False) -> DataFrame:
    """(owner, keys, surface, start): every place of every surface in every text of its owner, overlapping ones included.

    start counts code points from 0. once: only the first place of a surface in a text. Repeated surfaces count once;
    repeated texts each give their places. Null or empty texts and surfaces, and null owners, give none.
    """
    t = texts.select(owner, *keys, F.col(text).alias("_text")).where(F.col(owner).isNotNull() & (F.col("_text") != ""))
    s = surfaces.select(owner, F.col(surface).alias("_surface")).where(F.col(owner).isNotNull() & (F.col("_surface") != "")).distinct()
    count = lambda size, most, name: F.greatest(F.ceil(F.sum(size) / most), F.lit(1)).cast("int").alias(name)
    grid = t.groupBy(owner).agg(count(F.octet_length("_text"), SLICE, "_slices")).join(s.groupBy(owner).agg(count(F.length("_surface"), PART, "_parts")), owner)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = t.join(grid, owner).select(owner, *keys, "_text", F.pmod(F.xxhash64("_text", *keys), "_slices").cast("int").alias("_slice"), every("_parts").alias("_part"))
    s = s.join(grid, owner).select(F.col(owner).alias("_own"), "_surface", every("_slices").alias("_slice"), F.pmod(F.xxhash64("_surface"), "_parts").cast("int").alias("_part"))
    groups = GROUPS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = lambda o: F.pmod(F.xxhash64(o, "_slice", "_part"), F.lit(groups)).alias("_group")  # noqa: E731  small owners share one
    t, s = t.select("*", group(owner)).groupBy("_group"), s.select("*", group("_own")).groupBy("_group")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(owner, *keys).schema)
    return t.cogroup(s).applyInArrow(_read(owner, list(keys), once), f"{schema}, surface string, start int")
