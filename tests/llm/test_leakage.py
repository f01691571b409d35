import random

from engrama.llm import leakage as L

ITEM = "Inspector Vertor buried 2051 winter ledgers for Brika, unless the crooked meridian of Taló was sealed before the ninth hour"
DOCS = "doc_id long, text string, item_id long, covered int"


def found(text, item=ITEM):
    return [(i, c, n) for i, c, n, _ in L.ItemIndex([(1, item)]).find(text)]


def test_forms_that_do_not_matter():
    n = len(L.plain_words(ITEM.replace(" ", "\n"))) if False else sum(len(L.plain_words(w)) for w in ITEM.split())
    forms = [
        ITEM, ITEM.upper(), ITEM.replace(" ", " ​"), ITEM.replace(" ", " "), ITEM.replace("ó", "o").replace(",", " -"), "> " + ITEM[:60].replace(" ", " ") + "\n> " + ITEM[60:].lstrip(), ITEM.replace("o", "о").replace("a", "а"),
        ITEM.replace("ó", "\\u00f3"), ITEM.replace("ó", "&oacute;"), "".join(f"**{w}** " for w in ITEM.split()), "<p>" + ITEM.replace(" ", " <b>", 1) + "</b></p>", "\n".join("// " + " ".join(ITEM.split()[i : i + 6]) for i in range(0, 20, 6)),
        ITEM.replace("crooked", "croo-\nked"), ITEM.replace("winter", "win­ter"), "Ｉ" + ITEM[1:],
    ]
    for f in forms:
        got = found("Before. " + f + " After.")
        assert got and got[0][1] >= n - 1, f


def test_half_in_runs_of_five_in_order():
    w = ITEM.split()
    assert found(" ".join(w[:10]))
    assert not found(" ".join(w[:9]))
    assert found(" ".join(w[:5]) + " zz " + " ".join(w[8:13]))
    assert not found(" ".join(w[8:13]) + " zz " + " ".join(w[:5]))
    assert not found(" zz ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)))
    assert not found(" ".join(reversed(w)))


def test_against_brute_force():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    for _ in range(150):
        item = [rng.choice(words) for _ in range(rng.randrange(6, 14))]
        doc = []
        while len(doc) < 30:
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randrange(3, 9)] + [rng.choice(words)]
        got = found(" ".join(doc), " ".join(item))
        runs = [(p, a, n) for p in range(len(item)) for a in range(len(doc)) for n in range(5, len(item) - p + 1) if item[p : p + n] == doc[a : a + n]]
        best = {}

        def longest(p, a):
            if (p, a) not in best:
                best[p, a] = max([0, *(n + longest(q + n, b + n) for q, b, n in runs if q >= p and b >= a)])
            return best[p, a]

        assert bool(got) == (longest(0, 0) >= len(item) / 2), (item, doc)


def test_operator_cases(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM} y", 7, 7), (2, None, 7, 7), (3, "", 7, 7), (4, f"x {ITEM} y", 7, 7), (5, "nothing of it " * 500, 7, 7), (None, ITEM, 7, 7)], DOCS)
    items = spark.createDataFrame([(1, ITEM, "s"), (1, ITEM, "s"), (2, None, "s"), (3, "", "s"), (None, ITEM, "s"), (9, "too short", "s")], "item_id long, text string, doc_id string")
    got = L.leaks(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (4, 1)]
    clean = {r.doc_id: r.text for r in L.without_spans(docs, got).collect()}
    assert clean[1] == "x  y" and clean[4] == "x  y"
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    assert found("A too short text", "too short") == [(1, 2, 2)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM, 0, 0)], DOCS)
    items = spark.createDataFrame([(i, ITEM + f" {i}") for i in range(8)], "item_id long, text string")
    whole = sorted(r.item_id for r in L.leaks(docs, items).collect())
    monkeypatch.setattr(L, "BLOCK_WORDS", 40)
    assert sorted(r.item_id for r in L.leaks(docs, items).collect()) == whole == list(range(8))


def test_windows_of_many_items_change_nothing(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    head = "answer the question below in one short sentence"
    items = [(i, f"{head} {' '.join(rng.choice(words) for _ in range(rng.randrange(2, 22)))}") for i in range(60)] + [(100, head), (101, head), (102, f"{head} please")]
    plain = L.ItemIndex(items)
    monkeypatch.setattr(L, "HOT", 2)
    hot = L.ItemIndex(items)
    assert len(hot.hot) >= 4 and not plain.hot or len(plain.hot) < len(hot.hot)
    for k in range(200):
        i = rng.randrange(60)
        own = items[i][1].split()
        text = " ".join([rng.choice(words) for _ in range(9)] + (own if k % 3 == 0 else own[rng.randrange(6) :] if k % 3 == 1 else head.split()) + [rng.choice(words) for _ in range(9)])
        assert sorted(plain.find(text)) == sorted(hot.find(text)), text
    monkeypatch.setattr(L, "HOT", 10**9)
    none = L.ItemIndex(items)
    assert sorted(none.find(head)) == sorted(hot.find(head)) and {100, 101, 102} <= {i for i, *_ in hot.find(head)}


def test_documents_can_be_removed(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM} y", 7, 7), (2, None, 7, 7), (3, "other", 7, 7), (None, "z", 1, 1)], DOCS)
    got = L.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.covered) for r in L.without_documents(docs, got).collect()) == [(0, 1), (2, 7), (3, 7)]
