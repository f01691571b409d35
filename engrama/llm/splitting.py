"""Splitting oversized items at natural boundaries, by recursive bisection.

A token is four characters: ``max(1, characters div 4)``.  An item over its
limit is cut at the strongest boundary in the middle half of the text (ties:
nearest the midpoint), and each half still over *limit minus overlap* is cut
again.  Afterwards every piece but the first takes the last ``overlap`` tokens
of its predecessor as its beginning, so dropping those characters and joining
the pieces gives the item back exactly.

Items within their limit stay inside the JVM; only oversized ones reach Python,
where each is an independent row, so neither a hot category nor a hot file
gathers anything.

Defined cases
-------------
* null content gives no piece; empty content gives one empty piece.
* a category without a limit, or a null one, is not split.
* an overlap that is null or negative is 0; one above half of the limit is
  reduced to half of it, as no text would be left to move forward.
* rows delivered again: the latest ``parsed_at`` of a ``chunk_id`` counts
  (ties: the greater content).  Null ids are kept as one id.
* texts without any blank are cut between characters, never inside a line end,
  a surrogate, a combining sequence or a joined emoji.
* further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches

CHARS_PER_TOKEN = 4
#: Boundaries from strongest to weakest; a cut lies at the end of the match.
BOUNDARIES = (
    re.compile(r"(?:\r\n|\n|\r)(?=#{1,6}[ \t]|(?:export |async |public |static |private )*(?:def|class|func|function|interface|struct|impl|fn|type)\b)"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*?(?=\S)"),
    re.compile(r"(?:\r\n|\n|\r)(?=[^\s])"),
    re.compile(r"\r\n|\n|\r(?!\n)"),
    re.compile(r"[.!?;:。！？…][\"')\]»”’]*\s+|[。！？]"),
    re.compile(r"\s+(?=\S)|[,，、](?=\S)"),
)
PIECE_SCHEMA = "chunk_id long, category string, piece_index int, n_pieces int, start_char int, end_char int, overlap_chars int, content string, estimated_tokens int"
PIECE_COLUMNS = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]


def tokens_of(n_chars: int) -> int:
    return max(1, n_chars // CHARS_PER_TOKEN)


def _splittable(text: str, at: int) -> bool:
    """No cut inside a line end, before a combining mark or beside a joiner."""
    if at <= 0 or at >= len(text):
        return False
    a, b = text[at - 1], text[at]
    if a == "\r" and b == "\n":
        return False
    if a == "‍" or b == "‍" or "︀" <= b <= "️" or "\U0001f3fb" <= b <= "\U0001f3ff":
        return False
    return not unicodedata.combining(b)


def cut_points(text: str, limit: int) -> list[int]:
    """Ends of the consecutive cores of ``text``, each of at most ``limit`` characters."""
    places: list[list[int]] = []
    for pattern in BOUNDARIES:
        places.append([m.end() for m in pattern.finditer(text)])
    cuts: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit:
            cuts.append(b)
            continue
        cut = _cut(text, places, a, b)
        todo.append((cut, b))
        todo.append((a, cut))
    return cuts


def _cut(text: str, places: list[list[int]], a: int, b: int) -> int:
    mid, quarter = (a + b) // 2, (b - a) // 4
    low, high = max(a + 1, a + quarter), min(b - 1, b - quarter)
    for at in places:
        i = bisect_left(at, mid)
        near = [p for p in at[max(0, i - 1) : i + 1] if low <= p <= high]
        near = [p for p in near if _splittable(text, p)]
        if near:
            return min(near, key=lambda p: (abs(p - mid), p))
    for step in range(high - low + 1):
        for p in (mid - step, mid + step):
            if low <= p <= high and _splittable(text, p):
                return p
    return mid


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, overlap characters) of ``text``; start counts the overlap in."""
    most = CHARS_PER_TOKEN * max_tokens + CHARS_PER_TOKEN - 1
    if len(text) <= most:
        return [(0, len(text), 0)]
    overlap = CHARS_PER_TOKEN * max(0, min(overlap_tokens, max_tokens // 2))
    out, start = [], 0
    for end in cut_points(text, most - overlap):
        back = min(overlap, start)
        while back and not _splittable(text, start - back) and start - back > 0:
            back -= 1
        out.append((start - back, end, back))
        start = end
    return out


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for chunk_id, category, text, most, overlap in pdf.itertuples(index=False):
            pieces = split_text(text, int(most), int(overlap))
            for i, (a, b, back) in enumerate(pieces):
                rows.append((chunk_id, category, i, len(pieces), a, b, back, text[a:b], tokens_of(b - a)))
        out = pd.DataFrame(rows, columns=PIECE_COLUMNS)
        out["chunk_id"] = out["chunk_id"].astype("Int64")
        yield out


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row (chunk_id, category, content) per chunk_id: the one parsed last."""
    return (
        chunks.select("chunk_id", F.struct("parsed_at", "content", "category").alias("row"))
        .groupBy("chunk_id")
        .agg(F.max("row").alias("row"))
        .select("chunk_id", "row.category", "row.content")
        .where("content is not null")
    )


def split_items(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every chunk under the ``split`` limits of ``limits``.

    Columns: see ``PIECE_SCHEMA``.  ``limits`` has one row per category and
    purpose, far below the broadcast threshold whatever the chunks.
    """
    bound_batches(chunks.sparkSession)
    rule = (
        limits.where("purpose = 'split' and category is not null and max_tokens > 0")
        .groupBy("category")
        .agg(F.min(F.struct("max_tokens", F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)).alias("overlap_tokens"))).alias("rule"))
    )
    size = F.greatest(F.lit(1), F.floor(F.length("content") / CHARS_PER_TOKEN))
    sized = latest_chunks(chunks).join(rule, "category", "left")
    over = F.coalesce(size > F.col("rule.max_tokens"), F.lit(False))
    whole = sized.where(~over).select(
        "chunk_id", "category", F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"),
        F.length("content").alias("end_char"), F.lit(0).alias("overlap_chars"), "content", size.cast("int").alias("estimated_tokens"),
    )
    cut = sized.where(over).select("chunk_id", "category", "content", "rule.max_tokens", "rule.overlap_tokens").mapInPandas(_split_batches, PIECE_SCHEMA)
    return whole.unionByName(cut)


def oversized(pieces: DataFrame) -> DataFrame:
    """Ids of the items that had to be cut."""
    return pieces.where("n_pieces > 1").select("chunk_id").distinct()
