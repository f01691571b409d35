"""Reading level of each document, by a Rasch-style latent difficulty model.

Rasch's rating-scale model, with occurrences of words as responses: the log-odds
that an occurrence of word ``w`` stands in prose written for level ``k`` rather
than ``k - 1`` are ``delta[w] - tau[k]``, so

    P(k | w)  ~  exp(k * delta[w] - T[k]),   T[k] = tau[1] + ... + tau[k].

Every word (single words, and pairs of neighbours, of the prose) has one
occurrence difficulty ``delta``; the thresholds ``tau`` are common to all words.
How frequent a word is cancels out.  A document has one latent level ``theta``:
the most probable of the levels its occurrences are spread over, given the
difficulties of its words.

The three are estimated in turn: with ``delta`` and ``tau`` fixed, each rated
document's spread over the levels follows from its own words and its raters'
votes; with the spreads fixed, ``delta`` and ``tau`` follow by Newton's method
from sums per word and level, formed per batch before they are shuffled.  As a
word has a single number, a document is scored from the histogram of its words'
difficulties alone, for all documents of a batch at once.

The model is fitted on at most ``MAX_LABELLED`` rated documents (those with the
smallest hash of the id).  No word of them is left out: words are hashed to
``BUCKETS`` numbers, which bounds what is broadcast, and words that meet in a
bucket share its difficulty; ``MIN_DOCS`` documents must hold it.  Every
document is scored over its whole text.

Defined cases
-------------
* null text has no level and gives no row; a text without any known word gets
  the most frequent level of the ratings, and 3 where nothing is rated.
* votes that are null or outside 1..5 don't count; repeated rows of a document
  and rater count as they come; a document's votes weigh by their share.
* a text of several levels has the one that most of its words speak for.  Equal
  shares: the lower level.  Copies of a text get the same level.
* code, tables, headings, list marks, speakers and addresses are no prose.
* further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches
from engrama.staging import stage

LEVELS = 5
MAX_LABELLED = 50_000
BUCKETS = 1 << 21
MIN_DOCS = 2
ROUNDS = 8
SMOOTH = 0.02
ANCHOR = 20.0
PRIOR = 0.05
#: Scoring reads difficulties to the nearest of these steps.
GRID = np.linspace(-16, 16, 257)
STEPS = np.arange(LEVELS) - 2.0
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
#: Headings and table rows as a whole; speakers and list marks at the beginning of a line.
LINE_MARK = re.compile(r"^(?:#{1,6} [^\n]*|\|[^\n]*|[ \t]*(?:Q|A|user|agent|reviewer|assistant|system):|[ \t]*(?:[-*>+]|\d+[.)])[ \t]+)", re.M)
SYMBOL = re.compile(r"[_/\\{}<>=|]")
VOTES = [f"v{k}" for k in range(1, LEVELS + 1)]
SUMS = [f"n{k}" for k in range(1, LEVELS + 1)]
LEVEL_SCHEMA = "doc_id long, reading_level int, mean_level double, n_words int"


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # buckets of the words whose difficulty is known
    delta: np.ndarray  # and these difficulties
    sums: np.ndarray  # T, the summed thresholds
    usual: int

    def table(self) -> np.ndarray:
        """The difficulty of every bucket, NaN where it is not known."""
        out = np.full(BUCKETS, np.nan, np.float32)
        out[self.known] = self.delta
        return out

def level_odds(delta: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """P(level | word), one row per difficulty."""
    z = delta[:, None] * STEPS - sums
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def prose(text: str) -> str:
    """The text without code, headings, tables, marks of lists and speakers, paths and addresses."""
    if "`" in text:
        text = CODE.sub(" ", text)
    text = LINE_MARK.sub(" ", text)
    if "(" in text or SYMBOL.search(text):
        text = " ".join([t for t in text.split() if not SYMBOL.search(t) and not ("(" in t and "." in t)])
    return text


def prose_words(text: str) -> list[str]:
    return WORD.findall(prose(text).lower())


class _Hashes(dict):
    """64-bit hash of each word, kept while a task meets it again."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def prose_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of every word and every pair of neighbouring words."""
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    words = [prose_words(t) for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(size.sum()))
    at = np.repeat(np.arange(len(words)), size)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    same = at[1:] == at[:-1]
    bucket = np.concatenate([h & np.uint64(BUCKETS - 1), (pairs[same] >> np.uint64(40)) & np.uint64(BUCKETS - 1)])
    return np.concatenate([at, at[1:][same]]), bucket.astype(np.int64)


def spread(n: np.ndarray, p: np.ndarray, weight: np.ndarray | float = SMOOTH, start: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """Shares of the levels in each text, by EM; ``n`` counts its words per difficulty, ``p`` has P(level | word) per difficulty."""
    q = np.full((len(n), LEVELS), 1.0 / LEVELS) if start is None else start
    for _ in range(rounds):
        new = q * ((n / (q @ p.T)) @ p) + weight
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - q).max(initial=0.0) < 1e-4
        q = new
        if done:
            break
    return q


def histogram(at: np.ndarray, delta: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` texts have each difficulty of ``GRID``."""
    step = np.rint((np.clip(delta, GRID[0], GRID[-1]) - GRID[0]) / (GRID[1] - GRID[0])).astype(np.int64)
    return np.bincount(at * len(GRID) + step, minlength=n * len(GRID)).reshape(n, len(GRID)).astype(float)


def rated_sample(labels: DataFrame) -> DataFrame:
    """(doc_id, v1..v5): shares of the votes of at most ``MAX_LABELLED`` documents."""
    level = F.col("reading_level")
    votes = labels.where(level.between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    shares = votes.agg(*((F.count_if(level == k) / F.count(F.lit(1))).alias(f"v{k}") for k in range(1, LEVELS + 1)))
    return shares.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        at, bucket = prose_units(list(pdf["text"]))
        order = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[order], np.arange(1, len(pdf)))
        yield pdf[VOTES].assign(buckets=np.split(bucket[order].astype(np.int32), cut) if len(pdf) else [])


def _responses(pdf: pd.DataFrame, model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, expected occurrences per level) of the known words of rated texts."""
    size = np.fromiter(map(len, pdf["buckets"]), np.int64, len(pdf))
    bucket = np.concatenate([*pdf["buckets"], np.zeros(0, np.int32)]).astype(np.int64)
    at = np.repeat(np.arange(len(pdf)), size)
    known = ~np.isnan(table[bucket])
    at, bucket = at[known], bucket[known]
    delta = table[bucket].astype(float)
    anchor = pdf[VOTES].to_numpy(float) + SMOOTH
    anchor /= anchor.sum(axis=1, keepdims=True)
    n = histogram(at, delta, len(pdf))
    q = spread(n, level_odds(GRID, model.sums), anchor * np.maximum(ANCHOR, 0.5 * n.sum(axis=1, keepdims=True)), anchor, 3)
    r = level_odds(delta, model.sums) * q[at]
    r /= r.sum(axis=1, keepdims=True)
    seen, place = np.unique(bucket, return_inverse=True)
    return seen, np.stack([np.bincount(place, r[:, k], len(seen)) for k in range(LEVELS)], axis=1)


def _newton(model: Model, counts: pd.DataFrame) -> Model:
    """Difficulties and thresholds that the expected occurrences make most likely; all levels weigh alike."""
    at, c = np.searchsorted(model.known, counts["bucket"].to_numpy()), counts[SUMS].to_numpy(float)
    per_level = c.sum(axis=0)
    c *= np.where(per_level > 0, c.sum() / LEVELS / np.maximum(per_level, 1e-9), 0.0)
    total, score = c.sum(axis=1), c @ STEPS
    delta, sums = model.delta[at].astype(float), model.sums
    seen = per_level > 0
    for _ in range(6):
        for _ in range(3):
            p = level_odds(delta, sums)
            mean = p @ STEPS
            slope = total * (p @ STEPS**2 - mean**2) + PRIOR
            delta = delta + np.clip((score - total * mean - PRIOR * delta) / slope, -2, 2)
        expected = total @ level_odds(delta, sums)
        sums = np.where(seen, sums - np.log(np.maximum(c.sum(axis=0), 1e-9) / np.maximum(expected, 1e-9)), 30.0)
        sums = np.where(seen, sums - sums[seen].mean(), 30.0)  # a level without votes is never given
    out = model.delta.copy()
    out[at] = delta
    return Model(model.known, out, sums, model.usual)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Estimate difficulties and thresholds from the rated documents."""
    spark = docs.sparkSession
    bound_batches(spark)
    rated = stage(rated_sample(labels), "rated")
    shares = rated.agg(*(F.sum(v) for v in VOTES)).first()
    usual = 3 if shares[0] is None else 1 + int(np.argmax(np.array(shares, float)))
    votes = ", ".join(f"{v} double" for v in VOTES)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(rated), "doc_id")
    sample = stage(texts.select("text", *VOTES).mapInPandas(_units, f"{votes}, buckets array<int>"), "units")
    held = sample.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    known = np.sort(held.where(F.col("n") >= MIN_DOCS).select("bucket").toPandas()["bucket"].to_numpy())  # at most BUCKETS numbers
    model = Model(known, np.zeros(len(known), np.float32), np.zeros(LEVELS), usual)
    if not len(known):
        return model
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def expected(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            table = now.value.table()
            for pdf in batches:
                bucket, counts = _responses(pdf, now.value, table)
                yield pd.DataFrame(counts, columns=SUMS).assign(bucket=bucket)

        parts = sample.mapInPandas(expected, ", ".join(f"{s} double" for s in SUMS) + ", bucket int")
        sums = parts.groupBy("bucket").agg(*(F.sum(s).alias(s) for s in SUMS)).toPandas()  # at most BUCKETS rows
        model = _newton(model, sums.sort_values("bucket"))
        now.unpersist()
    return model


def reading_levels(docs: DataFrame, model: Model) -> DataFrame:
    """``LEVEL_SCHEMA`` of every text; n_words counts what white space separates."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        odds, table = level_odds(GRID, m.sums), m.table()
        for pdf in batches:
            texts = list(pdf["text"])
            at, bucket = prose_units(texts)
            delta = table[bucket]
            known = ~np.isnan(delta)
            n = histogram(at[known], delta[known], len(texts))
            q = spread(n, odds)
            some = n.any(axis=1)
            level = np.where(some, 1 + q.argmax(axis=1), m.usual)
            mean = np.where(some, np.round(q @ np.arange(1, LEVELS + 1), 3), m.usual)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "reading_level": level, "mean_level": mean, "n_words": [len(t.split()) for t in texts]})

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(score, LEVEL_SCHEMA)
