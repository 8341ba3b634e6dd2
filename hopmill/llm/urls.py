"""URL verdicts: host and path rules, and logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmill.llm.common import ascii_lower

#: A small labelled table of invented URLs, 1 is block and 0 is allow. Callers may pass their own.
LABELLED = [
    ("http://cheap-meds.example.com/buy-now/12", 1), ("http://www.cheap-pills.example.org/en/3", 1), ("https://pills-online.example.net/order", 1),
    ("http://casino-bonus.example.com/win/1", 1), ("https://best-casino.example.net/free-spins", 1), ("http://poker-win.example.org/bonus?id=2", 1),
    ("http://spam-links.example.com/en/77", 1), ("https://link-farm.example.net/seo/9", 1), ("http://spam-farm.example.com/fr/120", 1),
    ("http://free-money.example.com/claim", 1), ("https://win-prizes.example.org/click/here", 1), ("http://hot-singles.example.net/xxx/4", 1),
    ("http://adult-cams.example.com/live", 1), ("https://xxx-videos.example.net/en/5", 1), ("http://crypto-double.example.com/invest/now", 1),
    ("http://loans-fast.example.org/apply?ref=ad", 1), ("https://replica-watches.example.com/shop/8", 1), ("http://discount-viagra.example.net/buy", 1),
    ("http://torrent-free.example.com/crack/keygen", 1), ("https://clickbait-ads.example.org/pop/2", 1),
    ("https://www.university.example.com/en/research/12", 0), ("https://docs.project.example.org/en/guide/3", 0), ("https://blog.garden.example.net/en/2019/roses", 0),
    ("http://news.town.example.com/en/article/55", 0), ("https://library.example.org/fr/catalogue/9", 0), ("https://m.weather.example.net/de/berlin", 0),
    ("https://www.museum.example.com/es/visita/4", 0), ("http://history.example.org/en/1848.html", 0), ("https://wiki.physics.example.net/en/optics", 0),
    ("https://blog.cooking.example.com/fr/recettes/31", 0), ("http://www.travel.example.net/es/andes", 0), ("https://school.example.org/de/mathe/7", 0),
    ("https://forum.music.example.com/en/thread/901?page=2", 0), ("http://council.example.net/en/minutes#top", 0), ("https://www.bridge.example.org/en/684", 0),
    ("https://health.example.com/en/advice/221", 0), ("http://m.sports.example.net/fr/resultats/16", 0), ("https://archive.example.org/en/letters/", 0),
    ("https://www.theren.example.com/en/470", 0), ("http://blog.nation.example.net/de/612", 0),
]
#: Fixed values: (verdict, rule); a rule is a host with a path behind it.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MAX_LABELLED = 100_000
GRAMS, BITS = (3, 4, 5), 16


def host(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark or hash, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host is this one or a parent of it and whose path starts this one's; else null.

    rules is a short list: each is one comparison of the plan. Rules equally long tie in the order of the list.
    """
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams (bytes of UTF-8) of the texts, one after another, and where each text's begin."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(raw)), size)
    buckets, rows = [], []
    for n in GRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ flat[i : i + m]) * np.uint32(16777619)
        h ^= h >> 15
        inside = row[:m] == row[n - 1 :]
        buckets.append(h[inside] & np.uint32((1 << BITS) - 1))
        rows.append(row[:m][inside])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def _scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of block: the bias and the mean-scaled sum of the n-grams' weights."""
    b, r = _hashed(texts)
    count = np.bincount(r, minlength=len(texts))
    return np.bincount(r, weights=weights[b], minlength=len(texts)) / np.sqrt(np.maximum(count, 1)) + bias


def train(labelled: DataFrame, steps: int = 200, rate: float = 1.0, ridge: float = 1e-3, limit: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on (url, label) by full gradient steps.

    The labelled table is small by definition: at most limit rows, the first by the url's hash, are fetched. Rows with
    a null url or label are left out, repeated rows count each; without rows all weights are 0.
    """
    rows = labelled.where("url is not null and label is not null").select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), F.col("label").cast("double").alias("y"), F.xxhash64("url").alias("k")).orderBy("k", "h", "p", "y").limit(limit).collect()
    weights, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return weights, bias
    y = np.array([r.y for r in rows])
    b, r = _hashed([f"^{x.h}|{x.p}$" for x in rows])
    scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(rows)), 1))
    for _ in range(steps):
        z = np.bincount(r, weights=weights[b], minlength=len(rows)) * scale + bias
        miss = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(b, weights=(miss * scale)[r], minlength=len(weights)) / len(rows) + ridge * weights)
        bias -= rate * miss.mean()
    return weights, float(bias)


def score(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    """Probability (double) that the URL is to be blocked. A batch's n-grams are hashed and summed in numpy at once."""
    weights, bias = model[0].astype(np.float64), model[1]

    @F.arrow_udf("double")
    def blocked(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, p in parts:
            z = _scores([f"^{a}|{b}$" for a, b in zip(h.to_pylist(), p.to_pylist(), strict=True)], weights, bias)
            yield pa.array(1 / (1 + np.exp(-z)))

    return blocked(host, path)


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and score: the rule's verdict, else block where score >= 0.5.

    A null url, or one without ://, has an empty host and path and gets the model's verdict on them. Columns named like
    the new ones are replaced. Map-only: no shuffle.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    at = pages.select(*kept, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    at = at.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), model))
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return at.select(*kept, "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"), "score")
