import random

from helpers import rows

from engrama.operators import hierarchy as H

EDGES = "source_id long, target_id long, relation_type string, valid_to_commit string, holder string, depth int"


def tree(spark, links):
    return H.hierarchy(spark.createDataFrame(links, "holder long, item long").distinct())


def brute(links):
    """Depth and root by walking up; -1 and the loop's smallest id otherwise (one holder each)."""
    up, ids = {}, set()
    for h, i in links:
        up[i] = h
        ids |= {h, i}
    out = set()
    for x in ids:
        seen, y = [x], x
        while y in up and up[y] not in seen:
            y = up[y]
            seen.append(y)
        if y in up:
            loop = seen[seen.index(up[y]) :]
            out.add((x, min(loop), -1))
        else:
            out.add((x, y, len(seen) - 1))
    return out


def test_links_keep_only_current_containment_and_ignore_clashing_columns(spark):
    e = spark.createDataFrame(
        [(1, 2, " Contains ", None, "x", 9), (3, 1, "contained_by", None, "x", 9), (1, 2, "CONTAINS", None, "y", 9), (1, 4, "contains", "c1", "x", 9), (1, 5, "calls", None, "x", 9), (None, 6, "contains", None, "x", 9), (1, None, "contains", None, None, None), (1, 7, None, None, "x", 1)],
        EDGES,
    )
    assert rows(H.containment_links(e)) == [(1, 2), (1, 3)]


def test_paths_depths_and_pairs(spark):
    t = tree(spark, [(1, 2), (2, 3), (2, 4), (10, 11)])
    assert rows(t, "node_id", "root_id", "depth", "path") == [(1, 1, 0, [1]), (10, 10, 0, [10]), (11, 10, 1, [10, 11]), (2, 1, 1, [1, 2]), (3, 1, 2, [1, 2, 3]), (4, 1, 2, [1, 2, 4])]
    assert rows(H.ancestor_pairs(t)) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (10, 11, 1), (2, 3, 1), (2, 4, 1)]
    assert dict(rows(H.descendant_counts(t))) == {1: 3, 2: 2, 3: 0, 4: 0, 10: 1, 11: 0}


def test_loops_and_what_hangs_below_them(spark):
    t = tree(spark, [(5, 5), (5, 6), (8, 7), (7, 9), (9, 8), (9, 20), (20, 21), (1, 2)])
    got = {(r.node_id, r.root_id, r.depth) for r in t.collect()}
    assert got == {(5, 5, -1), (6, 5, -1), (7, 7, -1), (8, 7, -1), (9, 7, -1), (20, 7, -1), (21, 7, -1), (1, 1, 0), (2, 1, 1)}


def test_several_holders_take_the_smallest_depth_and_a_loop_wins(spark):
    t = tree(spark, [(1, 2), (2, 4), (1, 4), (3, 4), (8, 9), (9, 8), (8, 12), (1, 12)])
    got = {r.node_id: (r.root_id, r.depth) for r in t.collect()}
    assert got[4] == (1, 1) and got[12] == (8, -1) and got[3] == (3, 0)


def test_empty(spark):
    assert tree(spark, []).count() == 0


def test_random_forests_against_walking_up(spark):
    rng = random.Random(5)
    links = []
    for i in range(2, 400):
        links.append((rng.randrange(1, i) if rng.random() < 0.9 else rng.randrange(1, 400), i))
    assert {(r.node_id, r.root_id, r.depth) for r in tree(spark, links).collect()} == brute(links)


def closure(links):
    """Shortest distance of every id above another one, by breadth-first search."""
    up = {}
    for h, i in links:
        up.setdefault(i, set()).add(h)
    out = set()
    for x in up:
        seen, level, k = {x}, {x}, 0
        while level:
            k += 1
            level = {h for y in level for h in up.get(y, ())} - seen
            seen |= level
            out |= {(h, x, k) for h in level}
    return out


def whole(spark, links):
    l = spark.createDataFrame(links, "holder long, item long").distinct()
    t = H.hierarchy(l)
    pairs = [tuple(r) for r in H.descendant_pairs(l, t).collect()]
    return pairs, {r.node_id: r.n_descendants for r in H.descendant_counts(t, l).collect()}


def test_descendants_below_loops_and_under_every_holder(spark):
    links = [(5, 5), (5, 6), (8, 7), (7, 9), (9, 8), (9, 20), (20, 21), (20, 22), (1, 2), (2, 3), (1, 4), (30, 31), (1, 31), (31, 32), (2, 32), (40, 7)]
    pairs, counts = whole(spark, links)
    assert len(pairs) == len(set(pairs)) and set(pairs) == closure(links)
    assert {(20, 21, 1), (20, 22, 1), (9, 21, 2), (5, 6, 1), (30, 32, 2), (1, 32, 2), (40, 21, 4)} <= set(pairs)
    assert counts == {i: sum(a == i for a, _, _ in pairs) for i in {x for l in links for x in l}} and counts[20] == 2 and counts[9] == 5


def test_random_graphs_against_breadth_first_search(spark):
    rng = random.Random(6)
    links = [(rng.randrange(1, 60), i) for i in range(2, 90) for _ in range(1 + (rng.random() < 0.1))] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
    pairs, _ = whole(spark, links)
    assert len(pairs) == len(set(pairs)) and set(pairs) == closure(links)
