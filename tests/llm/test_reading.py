import random

import numpy as np
import pandas as pd

from engrama.llm import reading as R

DOCS = "doc_id long, text string, reading_level string"
LABELS = "doc_id long, rater string, reading_level int"
WORDS = {k: [f"{c}{v}{c}" for c in "bcdfg" for v in (f"{chr(96 + k)}a", f"{chr(96 + k)}e", f"{chr(96 + k)}o")] for k in range(1, 6)}


def made(rng, level, n=90):
    near = [k for k in (level - 1, level + 1) if 1 <= k <= 5]
    return ". ".join(" ".join(rng.choice(WORDS[level if rng.random() < 0.8 else rng.choice(near)]) for _ in range(9)) for _ in range(n // 9)) + "."


def test_held_out_levels_are_found(spark):
    rng = random.Random(4)
    docs, labels, truth = [], [], {}
    for i in range(400):
        truth[i] = 1 + i % 5
        docs.append((i, made(rng, truth[i]), "clash"))
        if i < 200:
            labels += [(i, r, min(5, max(1, truth[i] + (rng.random() < 0.1)))) for r in "ab"]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r.reading_level for r in R.reading_levels(d, R.fit(d, lab)).collect()}
    assert sum(got[i] == truth[i] for i in range(200, 400)) / 200 > 0.95


def test_layout_is_no_prose():
    plain = R.prose_words("The cat sat. It slept.")
    laid_out = R.prose_words("# Head line\n\n- The cat\nsat.\n\n```\nx = code\n```\n| a | b |\nagent: It slept. https://x.org/y some_ident")
    assert plain == ["the", "cat", "sat", "it", "slept"] and laid_out.count("cat") == 1 and not {"code", "head", "some_ident"} & set(laid_out)


def test_units_are_words_and_pairs_within_a_text():
    at, bucket = R.prose_units(["one two one two", "", "one", "two one"])
    assert np.bincount(at, minlength=4).tolist() == [7, 0, 1, 3] and len(set(bucket[at == 0])) == 4
    assert set(bucket[at == 2]) < set(bucket[at == 0]) and len(set(bucket[at == 3]) - set(bucket[at == 0])) == 0


def test_spread_is_that_of_the_words_one_by_one():
    rng = np.random.default_rng(3)
    sums = np.array([2.0, -1.0, -2.0, -1.0, 2.0])
    delta = rng.choice(R.GRID[60:200], 80)
    q = np.full(5, 0.2)
    for _ in range(40):
        r = R.level_odds(delta, sums) * q
        new = (r / r.sum(axis=1, keepdims=True)).sum(axis=0) + R.SMOOTH
        new /= new.sum()
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    got = R.spread(R.histogram(np.zeros(80, np.int64), delta, 1), R.level_odds(R.GRID, sums))
    assert np.allclose(got[0], q, atol=1e-9)


def test_difficulties_and_thresholds_satisfy_their_equations():
    rng = np.random.default_rng(5)
    counts = pd.DataFrame(rng.gamma(0.5, 20, (300, 5)), columns=R.SUMS).assign(bucket=range(300))
    m = R.Model(np.arange(300), np.zeros(300, np.float32), np.zeros(5), 3)
    for _ in range(6):
        m = R._newton(m, counts)
    c = counts[R.SUMS].to_numpy()
    c = c * (c.sum() / 5 / c.sum(axis=0))
    p = R.level_odds(m.delta.astype(float), m.sums)
    n = c.sum(axis=1)
    assert np.abs(c @ R.STEPS - n * (p @ R.STEPS) - R.PRIOR * m.delta).max() < 0.05 and np.allclose(n @ p, c.sum(axis=0), rtol=1e-2)


def test_no_word_is_left_out(spark):
    words = [f"{a}{b}{c}q" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    docs = [(i, " ".join(words), None) for i in range(3)]
    m = R.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, "a", 2) for i in range(3)], LABELS))
    _, bucket = R.prose_units([" ".join(words)])
    assert len(set(bucket)) > 1990 and set(bucket) <= set(m.known)


def test_operator_cases(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "unknown words only", "x"), (4, "word " * 30000, "x"), (None, "a", "x")], DOCS)
    none = R.fit(d, spark.createDataFrame([], LABELS))
    assert none.usual == 3
    got = {r.doc_id: (r.reading_level, r.n_words) for r in R.reading_levels(d, none).collect()}
    assert got == {2: (3, 0), 3: (3, 3), 4: (3, 30000), None: (3, 1)}
    odd = R.fit(d, spark.createDataFrame([(3, "a", 9), (3, "a", None), (None, "a", 2), (77, "a", 4), (77, "a", 4)], LABELS))
    assert odd.usual == 4 and R.reading_levels(d.limit(0), odd).count() == 0
