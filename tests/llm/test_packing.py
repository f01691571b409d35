import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engrama.llm import packing as P

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 100)), max_size=120), st.integers(1, 12))
def test_every_limit_holds_and_nothing_is_lost(items, segments):
    tokens = np.array([t for t, _ in items], np.int64)
    loss = np.array([min(t, x, 80) for t, x in items], np.int64)
    cap = P.Capacity(100, segments, 80)
    box = P.pack_sizes(tokens, loss, cap)
    assert len(box) == len(items)
    for b in set(box.tolist()):
        m = box == b
        assert tokens[m].sum() <= 100 and loss[m].sum() <= 80 and m.sum() <= segments


def test_fill_is_near_the_lower_bound():
    rng = np.random.default_rng(3)
    tokens = rng.integers(5, 900, 3000)
    box = P.pack_sizes(tokens, tokens // 2, P.Capacity(2048, 64, 2048))
    assert tokens.sum() / (2048 * (box.max() + 1)) > 0.98


def test_prompts_are_no_loss():
    text = "intro\nuser: ask\nmore\nagent: say\nQ: what\nA: that"
    assert P.prompt_parts(text) == ["user: ask\nmore\n", "Q: what\n"]


def test_operator_cases(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "word " * 300, 1), (2, "", 1), (3, None, 1), (4, "short text", 1), (5, "short text", 1), (6, "user: a long question\nagent: yes", 1)], "doc_id long, text string, part int")
    cap = P.Capacity(64, 8, 64)
    sizes = {r.doc_id: r for r in P.token_sizes(docs, TOKENIZER).collect()}
    assert set(sizes) == {1, 2, 4, 5, 6} and sizes[2].n_tokens == 1 and sizes[6].n_loss < sizes[6].n_tokens
    packed = P.pack_documents(docs, cap, TOKENIZER).collect()
    assert sum(r.n_tokens for r in packed) == sum(r.n_tokens for r in sizes.values())
    assert len([r for r in packed if r.doc_id == 1]) == -(-sizes[1].n_tokens // 64) and all(sum(p.doc_id == i for p in packed) == 1 for i in (2, 4, 5, 6))
    total = {}
    for r in packed:
        total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
    assert max(total.values()) <= 64
    assert P.pack_documents(docs.limit(0), cap, TOKENIZER).count() == 0
    assert P.fill_report(P.pack_documents(docs.limit(0), cap, TOKENIZER), cap).first().n_containers == 0


def test_a_text_over_the_loss_limit_alone_lies_alone(spark):
    s = spark.createDataFrame([(1, 100, 100), (2, 10, 0), (3, 250, 125)], "doc_id long, n_tokens long, n_loss long")
    cap = P.Capacity(100, 8, 40)
    got = sorted(P.cut_to_capacity(s, cap).collect())
    assert [(r.doc_id, r.start_token, r.n_tokens, r.n_loss) for r in got] == [(1, 0, 100, 100), (2, 0, 10, 0), (3, 0, 100, 50), (3, 100, 100, 50), (3, 200, 50, 25)]
    box = P.pack_sizes(np.array([90, 10, 50, 50]), np.array([90, 0, 30, 10]), cap)
    assert len(set(box.tolist())) == 3 and box[2] == box[3] and (box == box[0]).sum() == 1


def test_limits_that_tokens_alone_would_break():
    """Pairs must mix both kinds: best fit by tokens would pair like with like and break the loss limit, or leave half of each container free."""
    tokens = np.full(200, 50)
    loss = np.array([50] * 100 + [10] * 100)
    assert P.pack_sizes(tokens, loss, P.Capacity(100, 8, 60)).max() + 1 == 100
    rng = np.random.default_rng(5)
    tokens = rng.integers(20, 700, 4000)
    loss = np.where(rng.random(4000) < 0.3, tokens * rng.random(4000), tokens).astype(np.int64)
    cap = P.Capacity(2048, 64, 1900)
    box = P.pack_sizes(tokens, loss, cap)
    alone = P.pack_sizes(tokens, np.zeros(4000, np.int64), cap)
    assert np.bincount(box, loss).max() <= 1900 < np.bincount(alone, loss).max()
    assert box.max() + 1 <= 1.03 * max(tokens.sum() / 2048, loss.sum() / 1900)
    few = P.pack_sizes(np.full(300, 2), np.full(300, 2), P.Capacity(2048, 64, 1900))
    assert few.max() + 1 == 5
