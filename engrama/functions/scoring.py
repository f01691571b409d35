"""Scores: recency, centrality, cosine similarity and their weighted sum."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits of the ranking.
W_VECTOR, W_TEXT, W_CONTEXT = 0.50, 0.25, 0.25
HALF_LIFE_DAYS, RECENCY_FLOOR = 7.0, 0.01
SUPER_NODE_DEGREE = 10
K1, B = 1.2, 0.75
DAY_MICROS = 8.64e10


def days_between(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts.cast("timestamp"))) / F.lit(DAY_MICROS)


def recency(ts: Column, now: Column) -> Column:
    """Decays by half each week down to a floor; null is the floor and the future is now."""
    days = F.greatest(days_between(now, ts), F.lit(0.0))
    decay = F.greatest(F.exp(-F.lit(math.log(2) / HALF_LIFE_DAYS) * days), F.lit(RECENCY_FLOOR))
    return F.when(ts.isNull() | now.isNull(), F.lit(RECENCY_FLOOR)).otherwise(decay)


def centrality(in_degree: Column) -> Column:
    return F.least(F.coalesce(in_degree, F.lit(0)) / F.lit(float(SUPER_NODE_DEGREE)), F.lit(1.0))


def saturation(hits: Column, length: Column, mean_length: Column) -> Column:
    """BM25 without its inverse document frequency, which is the same for a whole phrase query."""
    return hits * (K1 + 1) / (hits + K1 * ((1 - B) + B * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of different or no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def hybrid(vector: Column, text: Column, recent: Column, central: Column) -> Column:
    """The weighted sum to four places; the parts have four places, so halves are common and go up."""
    return F.round(W_VECTOR * vector + W_TEXT * text + W_CONTEXT * F.greatest(recent, central) + 1e-9, 4)
