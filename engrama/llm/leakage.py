"""Evaluation texts leaking into training text.

The word n-grams of all evaluation items form one hash index that every task
holds; each training text is scanned once, window by window.  Hits that follow
each other in text and item grow into unbroken runs, and an item has leaked
when runs in the item's order cover at least half of its words.  A text is
compared in a normal form: case, accents, punctuation, spacing, line prefixes,
markup, escapes and look-alike characters don't matter.

The index is built from blocks of items of at most ``BLOCK_WORDS`` words, so what
a task holds is bounded however many items there are; each block is one pass.
Items of equal words are one entry.  A text is looked up as an array of hashed
windows first; only what hits is read with its places.  A window that more than
``HOT`` entries hold (an instruction that many items open with) is followed only
for entries that another window of the text names, or that such windows alone
could cover; no other entry can leak by it.

Defined cases
-------------
* null or empty texts and items neither leak nor hold anything.
* an item of fewer words than a run must be held as a whole.
* an item counts once per document, with the best choice of runs; copies of a
  document are cases of their own; repeated rows of an item count once.
* empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches

RUN_WORDS = 5
SHARE = 0.5
BLOCK_WORDS = 2_000_000
HOT = 32
HIT_SCHEMA = "doc_id long, item_id long, covered int, item_words int, spans array<struct<start:int,end:int>>"

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n", "ь": "b",
        "А": "a", "В": "b", "Е": "e", "Ѕ": "s", "І": "i", "Ј": "j", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "Ԁ": "d", "Ԛ": "q", "Ԝ": "w", "Һ": "h", "Ӏ": "l",
        "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "η": "n", "μ": "u",
        "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "Ϲ": "c",
        "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "ԍ": "g", "ℓ": "l", "ø": "o", "đ": "d", "ł": "l", "Ø": "o", "Đ": "d", "Ł": "l", "ɪ": "i", "ʏ": "y", "ᴀ": "a", "ᴄ": "c", "ᴇ": "e", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
        "’": "'", "‘": "'", "ʼ": "'", "`": "'",
    }
)
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--|-->|\]\([^)\s]*\)|\{#[^}\n]*\}")
PREFIX = re.compile(
    r"^(?:[ \t]*(?:[>#*+|;%•·–—-]+|//+|/\*+|--+|\.\.|\$|\d{1,6}[.:)|]|\[[\d:.\- TZ/]{3,30}\]|\d{4}-\d\d-\d\d[T ][\d:.]+Z?|\d\d:\d\d(?::\d\d)?|(?:INFO|DEBUG|WARN|WARNING|ERROR|TRACE)\b:?|(?:user|agent|assistant|reviewer|system|human)[ \t]*:|rem\b|dnl\b|L\d+:?)(?=[ \t]|\b|$))+",
    re.I | re.M,
)
CHUNK = re.compile(r"\S+")
BREAK = re.compile(r"(?<=[^\W\d_])[-­‐][ \t]*\r?\n(?=([ \t>#*/|;-]*))", re.M)
WORD = re.compile(r"[^\W_]+")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]{1,6})\}|([nrtfvb0\"'/\\]))")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return m[5] if m[5] in "\"'/\\" else " "


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except ValueError:
        return m[0]


def plain_words(chunk: str) -> list[str]:
    """Words of a text without white space, in the form that is compared."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    if "\\" in chunk:
        chunk = ESCAPE.sub(_unescape, chunk)
    if "&" in chunk:
        chunk = html.unescape(html.unescape(chunk))
    if "%" in chunk:
        chunk = PERCENT.sub(_percent, chunk)
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFKD", chunk.translate(LOOK_ALIKES))
        chunk = "".join(c for c in chunk if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        chunk = unicodedata.normalize("NFKD", chunk.translate(LOOK_ALIKES))
    chunk = re.sub(r"</?[A-Za-z][^<>]*>|\]\([^)]*\)", " ", chunk)
    return WORD.findall(chunk.casefold().replace("'", ""))


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def chunks_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """Stretches without white space; tags and line prefixes are blanked in place.

    A word broken by a hyphen at a line's end is put together again.
    """
    text = TAG.sub(_blank, text)
    text = PREFIX.sub(_blank, text)
    out: list[tuple[str, int, int]] = []
    joined = -1
    for m in CHUNK.finditer(text):
        s, a, b = m[0], m.start(), m.end()
        if joined == len(out) - 1 and out and joined >= 0:
            p, pa, _ = out[-1]
            s, a = p[:-1] + s, pa
            out.pop()
        out.append((s, a, b))
        if len(s) > 1 and s[-1] in "-­‐" and s[-2].isalpha() and "\n" in text[b : b + 3]:
            joined = len(out) - 1
        else:
            joined = -1
    return out


#: A line that may end within a word.
OPEN_END = re.compile(r"[-\u00ad\u2010](?<=[^\W\d_].)[^\S\n]*\n")


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """One number for every ``n`` consecutive ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)].astype(np.uint64)
    return out


class ItemIndex:
    """Word numbers and the positions of every run-long gram of the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        entries: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            words = [w for s, _, _ in chunks_with_offsets(text) for w in plain_words(s)]
            if words:
                ids = tuple(self.number.setdefault(w, len(self.number)) for w in words)
                entries.setdefault(ids, []).append(item_id)
        self.items = list(entries.values())
        self.length = [len(ids) for ids in entries]
        grams: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for entry, ids in enumerate(entries):
            n = min(RUN_WORDS, len(ids))
            for k in range(len(ids) - n + 1):
                grams[n][ids[k : k + n]].append((entry, k))
        self.grams = {n: dict(g) for n, g in grams.items()}
        self.hashes = {n: np.unique(_window_hashes(np.array(list(g), np.int64).ravel(), n)[::n]) for n, g in self.grams.items()}
        #: Of hot grams: the positions by entry, and the entries that hot grams alone could cover.
        self.hot: dict[tuple[int, ...], dict[int, list[int]]] = {}
        covered: dict[int, set[int]] = defaultdict(set)
        for n, g in self.grams.items():
            for gram, places in g.items():
                if len(places) > HOT:
                    by_entry: dict[int, list[int]] = defaultdict(list)
                    for entry, k in places:
                        by_entry[entry].append(k)
                        covered[entry].update(range(k, k + n))
                    self.hot[gram] = dict(by_entry)
        coverable = {e for e, w in covered.items() if len(w) >= SHARE * self.length[e]}
        self.alone = {gram: coverable & by_entry.keys() for gram, by_entry in self.hot.items()}

    def word_numbers(self, chunk: str) -> tuple[int, ...]:
        got = self.cache.get(chunk)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = self.cache[chunk] = tuple(self.number.get(w, -1) for w in plain_words(chunk))
        return got

    def _windows(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Places where ``n`` known words may be a gram of the items."""
        if len(ids) < n:
            return np.zeros(0, np.int64)
        known = np.cumsum(np.concatenate([[0], ids >= 0]))
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        h = _window_hashes(ids, n)[at]
        place = np.minimum(np.searchsorted(self.hashes[n], h), len(self.hashes[n]) - 1)
        return at[self.hashes[n][place] == h]

    def may_hold(self, texts: list[str]) -> np.ndarray:
        """Which of the texts have a window that may be a gram; all are looked up as one array."""
        sure, ids, ends = [], [], []
        for text in texts:
            text = PREFIX.sub(_blank, TAG.sub(_blank, text))
            sure.append(OPEN_END.search(text) is not None)
            ids.extend(chain.from_iterable(map(self.word_numbers, text.split())))
            ids.append(-1)
            ends.append(len(ids))
        array, out = np.array(ids, np.int64), np.array(sure, bool)
        for n in self.grams:
            out[np.searchsorted(ends, self._windows(array, n), side="right")] = True
        return out

    def find(self, text: str) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """(item, words covered, words of the item, spans) of every item that leaked."""
        ids: list[int] = []
        place: list[tuple[int, int]] = []
        for chunk, a, b in chunks_with_offsets(text):
            got = self.word_numbers(chunk)
            ids.extend(got)
            place.extend([(a, b)] * len(got))
        array = np.array(ids, np.int64)
        runs: dict[int, list[list[int]]] = defaultdict(list)
        for n, grams in self.grams.items():
            hits = [(int(at), gram) for at in self._windows(array, n) if (gram := tuple(ids[at : at + n])) in grams]
            named = {e for _, gram in hits for e in (self.alone[gram] if gram in self.hot else [e for e, _ in grams[gram]])}
            open_runs: dict[tuple[int, int], list[int]] = {}
            for at, gram in hits:
                for entry, pos in self._places(grams, gram, named):
                    run = open_runs.pop((entry, pos - at), None)
                    if run is not None and run[1] + run[2] == at + n - 1:
                        run[2] += 1
                    else:
                        run = [pos, at, n]
                        runs[entry].append(run)
                    open_runs[entry, pos - at] = run
        out = []
        for entry, found in runs.items():
            n = self.length[entry]
            if len({p + k for p, _, m in found for k in range(m)}) < SHARE * n:
                continue
            covered = covered_words(found, n, min(RUN_WORDS, n))
            if covered >= SHARE * n:
                spans = sorted({(place[a][0], place[a + m - 1][1]) for _, a, m in found})
                out += [(item, covered, n, spans) for item in self.items[entry]]
        return out

    def _places(self, grams: dict, gram: tuple[int, ...], named: set[int]) -> Iterator[tuple[int, int]]:
        """Positions of a gram in the entries that can leak."""
        by_entry = self.hot.get(gram)
        if by_entry is None:
            yield from grams[gram]
            return
        for entry in named if len(named) < len(by_entry) else by_entry:
            if entry in named:
                for pos in by_entry.get(entry, ()):
                    yield entry, pos


def covered_words(runs: list[list[int]], n: int, least: int) -> int:
    """Most words of an item of ``n`` words covered by runs of at least ``least``, in the order of both sides.

    ``runs`` are (position, place, length) of matching stretches.  For each place
    of the text and each prefix of the item, ``best`` is the most covered so far
    and ``run`` the most with a run that ends just there.
    """
    matched: dict[int, list[int]] = defaultdict(list)
    for pos, at, size in runs:
        for k in range(size):
            matched[at + k].append(pos + k)
    places = sorted(matched)
    best = [np.zeros(n + 1, np.int64)]
    run = np.zeros(n + 1, np.int64)
    length = np.zeros(n + 1, np.int64)
    for i, at in enumerate(places):
        here = np.zeros(n + 1, bool)
        here[np.array(matched[at]) + 1] = True
        if i == 0 or places[i - 1] != at - 1:
            run, length = np.zeros_like(run), np.zeros_like(length)
        before = np.zeros_like(length)
        before[1:] = length[:-1]
        length = np.where(here, before + 1, 0)
        longer = np.zeros_like(run)
        longer[1:] = run[:-1] + 1
        run = np.where(length > least, longer, 0)
        if i + 1 >= least:
            fresh = np.zeros_like(run)
            fresh[least:] = best[i + 1 - least][: n + 1 - least] + least
            run = np.where(length >= least, np.maximum(run, fresh), run)
        best.append(np.maximum.accumulate(np.maximum(best[-1], run)))
    return int(best[-1][-1])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item: ``HIT_SCHEMA``.

    ``spans`` are the character offsets of all stretches the text shares with the item.
    """
    bound_batches(docs.sparkSession)
    clean = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    words = clean.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    texts = docs.where("text is not null").select("doc_id", "text")
    out = None
    for block in range(blocks):
        part = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else clean
        held = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])
        found = texts.mapInPandas(_scanner(held), HIT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.distinct() if blocks > 1 else out


_indexes: dict[int, ItemIndex] = {}


def _scanner(held):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(held.value))
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = ItemIndex(held.value)
        index = _indexes[key]
        for pdf in batches:
            rows = []
            some = index.may_hold(list(pdf["text"]))
            for doc_id, text in zip(pdf["doc_id"][some], pdf["text"][some]):
                rows += [(doc_id, item, c, n, [{"start": a, "end": b} for a, b in spans]) for item, c, n, spans in index.find(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "item_words", "spans"])

    return scan


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed) of the documents that leak, with the spans cut out."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, counts = [], []
            for text, where in zip(pdf["text"], pdf["spans"]):
                out, at = [], 0
                for s in where:
                    if s["start"] > at:
                        out.append(text[at : s["start"]])
                    at = max(at, s["end"])
                out.append(text[at:])
                texts.append("".join(out))
                counts.append(len(text) - len(texts[-1]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "n_removed": counts})

    return docs.select("doc_id", "text").join(spans, "doc_id").mapInPandas(cut, "doc_id long, text string, n_removed long")


def without_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no test passage, with all their columns; rows of a null id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
