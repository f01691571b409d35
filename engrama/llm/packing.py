"""Filling fixed-capacity containers with items: vector bin packing.

Every text is sized in tokens of a public tokenizer and in loss-bearing tokens
(those outside the prompts of a dialogue).  A container limits three things at
once: tokens, segments and loss-bearing tokens.  The dot-product heuristic
opens one container at a time and always places the item whose demand has the
greatest weighted dot product with what is still free, until nothing fits.

Only (id, sizes) reach the packing, never texts.  Items are spread over shards
by a hash of their id; a shard holds a bounded number of items, so every task
is bounded, and items of equal sizes form one class with a count, so the
heuristic costs the number of distinct sizes per placement.  What lies in
containers filled below ``REPACK_BELOW`` is packed once more across shards.

Defined cases
-------------
* null text is no item; an empty or blank one counts as one token.
* a text within the limit of tokens is never split, and one within that limit but
  over that of loss-bearing tokens lies alone; a longer one is cut into parts of
  the full capacity and one remainder, which is then packed like any item.
* rows of one id are one item each (``part`` tells parts, not rows, apart);
  copies of a text are items of their own.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.batches import bound_batches
from engrama.staging import stage

SHARD_ITEMS = 50_000
REPACK_BELOW = 0.97
#: A prompt turn runs from its speaker to the next speaker.
TURN = re.compile(r"^(user|human|system|question|q|agent|assistant|reviewer|answer|a):[ \t]", re.I | re.M)
PROMPTS = {"user", "human", "system", "question", "q"}
SIZE_SCHEMA = "doc_id long, n_tokens long, n_loss long"
PACK_SCHEMA = "container_id string, doc_id long, part int, start_token long, n_tokens long, n_loss long"


@dataclass(frozen=True)
class Capacity:
    tokens: int
    segments: int
    loss_tokens: int


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer whose ranks lie in the file at ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def prompt_parts(text: str) -> list[str]:
    marks = list(TURN.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [text[m.start() : e] for m, e in zip(marks, ends) if m[1].lower() in PROMPTS]


def token_sizes(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_loss) of every text, over the whole of it."""
    bound_batches(docs.sparkSession)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for pdf in batches:
            n = [max(1, len(enc.encode_ordinary(t))) for t in pdf["text"]]
            p = [sum(len(enc.encode_ordinary(x)) for x in prompt_parts(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "n_loss": [max(0, a - b) for a, b in zip(n, p)]})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(sizes, SIZE_SCHEMA)


def cut_to_capacity(sizes: DataFrame, cap: Capacity) -> DataFrame:
    """Items (doc_id, part, start_token, n_tokens, n_loss), each within the limit of tokens."""
    step = F.lit(cap.tokens).cast("long")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / step).cast("long")))
    share = lambda c: F.floor(c * F.col("n_loss") / F.col("total"))
    end = F.col("start_token") + F.col("n_tokens")
    return (
        sizes.withColumn("total", F.col("n_tokens"))
        .withColumn("part", part)
        .withColumn("start_token", F.col("part") * step)
        .withColumn("n_tokens", F.least(step, F.col("total") - F.col("start_token")))
        .select("doc_id", F.col("part").cast("int").alias("part"), "start_token", "n_tokens", (share(end) - share(F.col("start_token"))).cast("long").alias("n_loss"))
    )


def pack_sizes(tokens: np.ndarray, loss: np.ndarray, cap: Capacity) -> np.ndarray:
    """Container number of each item, by the dot-product heuristic.

    Demands and free room are vectors of tokens, loss-bearing tokens and segments,
    each in parts of its limit and weighed by how much of it all items ask for,
    so the limit that is scarcest decides.
    """
    order = np.lexsort((loss, tokens))
    keys = np.stack([tokens[order], loss[order]], axis=1)
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    size = np.column_stack([keys[start], np.ones(len(start))]).astype(np.float64)
    left = np.diff(np.append(start, len(order)))
    taken = np.zeros(len(start), np.int64)
    total = np.array([cap.tokens, cap.loss_tokens, cap.segments], np.float64)
    asked = np.append(keys.sum(axis=0), len(keys)) / total
    pull = size * (asked / max(1e-9, asked.max()) / total**2)
    out = np.empty(len(order), np.int64)
    box, remaining = 0, len(order)
    while remaining:
        free, last, opened = total.copy(), len(start), False
        while free[2] >= 1:
            last = int(np.searchsorted(size[:last, 0], free[0], side="right"))
            if not last:
                break
            score = pull[:last] @ free
            fits = (left[:last] > 0) & ((size[:last, 1] <= free[1]) | (not opened))
            score[~fits] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            out[order[start[k] + taken[k]]] = box
            taken[k] += 1
            left[k] -= 1
            free -= size[k]
            remaining -= 1
            opened = True
            if free[1] < 0:  # a text over the limit of loss-bearing tokens stays alone
                break
        box += 1
        if (left == 0).mean() > 0.5 and remaining:
            keep = left > 0
            start, size, left, taken, pull = start[keep], size[keep], left[keep], taken[keep], pull[keep]
    return out


def _pack_round(items: DataFrame, cap: Capacity, name: str) -> DataFrame:
    n = items.count()
    shards = max(1, -(-n // SHARD_ITEMS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable")
        box = pack_sizes(pdf["n_tokens"].to_numpy(np.int64), pdf["n_loss"].to_numpy(np.int64), cap)
        shard = int(pdf["shard"].iloc[0])
        return pdf.assign(container_id=[f"{name}{shard}-{b}" for b in box])[["container_id", "doc_id", "part", "start_token", "n_tokens", "n_loss"]]

    shard = F.pmod(F.xxhash64("doc_id", "part", F.lit(name)), F.lit(shards)).cast("int")
    return items.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, PACK_SCHEMA)


def pack_documents(docs: DataFrame, cap: Capacity, tokenizer_path: str) -> DataFrame:
    """Every text, or part of an oversized one, with its container: ``PACK_SCHEMA``."""
    items = stage(cut_to_capacity(token_sizes(docs, tokenizer_path), cap), "items")
    first = stage(_pack_round(items, cap, "a"), "packed")
    fill = first.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    loose = fill.where(F.col("fill") < REPACK_BELOW * cap.tokens).select("container_id")
    again = stage(first.join(loose, "container_id", "left_semi").drop("container_id"), "loose")
    return first.join(loose, "container_id", "left_anti").select(*first.columns).unionByName(_pack_round(again, cap, "b"))


def fill_report(packed: DataFrame, cap: Capacity) -> DataFrame:
    """One row: items, containers, the fewest that the tokens would need, and the mean fill."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count(F.lit(1)).alias("s"))
    return boxes.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("n_items"),
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / cap.tokens).cast("long").alias("least_containers"),
        F.round(F.avg(F.col("t") / cap.tokens), 4).alias("mean_fill"),
        F.max("t").alias("most_tokens"),
        F.max("s").alias("most_segments"),
        F.max("l").alias("most_loss_tokens"),
    )
