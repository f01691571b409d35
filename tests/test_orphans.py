from datetime import datetime as D

from helpers import rows

from engrama.operators import orphans as O

JAN, FEB, MAR = D(2024, 1, 5), D(2024, 2, 5), D(2024, 3, 5)


def tables(spark, edges, nodes, projects, deletions):
    return (
        spark.createDataFrame(edges, "source_id long, target_id long, loaded_at timestamp, reason string"),
        spark.createDataFrame(nodes, "id long, project_uuid string, loaded_at timestamp, period string"),
        spark.createDataFrame(projects, "uuid string, created_at timestamp, key string"),
        spark.createDataFrame(deletions, "entity string, entity_key string, deleted_at timestamp"),
    )


def test_missing_deleted_late_and_spellings(spark):
    got = O.orphan_references(
        *tables(
            spark,
            [(1, 2, JAN, "x"), (1, 2, FEB, "x"), (1, 3, JAN, None), (1, 4, FEB, None), (1, 99, None, None)],
            [(1, " ABC ", JAN, "p"), (1, "abc", FEB, "p"), (2, "", JAN, None), (3, None, FEB, None), (4, "late", JAN, None), (5, "gone", JAN, None), (6, "nowhere", MAR, None), (7, "abc", None, None)],
            [("abc", JAN, "k"), ("late", MAR, "k"), ("gone", JAN, "k")],
            [("node", "4", MAR), ("node", "4", MAR), ("project", "GONE", JAN)],
        )
    )
    assert rows(got) == sorted(
        [
            ("edges", "target_id", "1:3", "late", "2024-01"), ("edges", "target_id", "1:4", "deleted", "2024-02"), ("edges", "target_id", "1:99", "missing", None),
            ("nodes", "project_uuid", "4", "late", "2024-01"), ("nodes", "project_uuid", "5", "deleted", "2024-01"), ("nodes", "project_uuid", "6", "missing", "2024-03"),
        ],
        key=repr,
    )
    assert ("edges", "target_id", "late", "2024-01", 1) in rows(O.orphan_report(got))


def test_hot_key_counts_every_reference(spark):
    got = O.orphan_references(*tables(spark, [(i, 1000, JAN, None) for i in range(1, 300)], [(i, None, JAN, None) for i in range(1, 300)], [], []))
    assert got.count() == 299 and {r.reason for r in got.collect()} == {"missing"}


def test_empty_tables(spark):
    assert O.orphan_references(*tables(spark, [], [], [], [])).count() == 0
    assert O.orphan_references(*tables(spark, [], [(1, "a", JAN, None)], [], [])).count() == 1
