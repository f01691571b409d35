"""Communities of super-nodes as sets of bits, a project and a block of its super-nodes at a time.

The steps of a super-node go both ways and stay among the active nodes of its
project.  So a task takes the links of one project and a block of its super-nodes:
each node holds one bit per super-node, and a hop adds the bits of its neighbours.
Pairs of super-node and node, whose number is the product of both, are made by
the last step only; no shuffle, join or staged table holds them, but in projects
of more than ``MAX_LINKS`` links, which no task holds and frontier joins walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.operators.relational import in_degree, parsed_tags
from engrama.staging import stage

#: Links of a project that one task holds; super-nodes of a block, and fewer where a project's bits would exceed ``MAX_BITS``.
MAX_LINKS, BLOCK, MAX_BITS = 4_000_000, 1024, 1 << 28
#: Rows of a task and of an Arrow batch, about.
TASK_ROWS, BATCH_ROWS = 1_000_000, 1 << 17
NODE, LINK, TAG = 0, 1, 2
PAIRS = "anchor_id long, member_id long"
DIGESTS = "anchor_id long, n_members long, first array<long>, tags array<string>"


class Graph:
    """Super-nodes and links of all projects, staged, with the size of each project that has super-nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, threshold: int):
        key = F.coalesce("project_uuid", F.lit("")).alias("project")  # nodes without a project have no links
        active = stage(nodes.where("status = 'ACTIVE'").select("id", key, F.col("project_uuid").isNotNull().alias("placed")), "active")
        ends = stage(edges.select("source_id", "target_id"), "ends")
        self.anchors = stage(in_degree(ends).where(F.col("in_degree") >= threshold).join(active, "id").select("id", "project"), "anchors")
        placed = active.where("placed").select("id", "project")
        pairs = ends.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
        pairs = pairs.join(placed.withColumnRenamed("id", "a"), "a").join(placed.withColumnRenamed("id", "b"), ["b", "project"])
        self.links = stage(pairs.join(self.anchors.select("project").distinct(), "project", "left_semi").select("project", "a", "b"), "links")
        sizes = self.anchors.groupBy("project").agg(F.count(F.lit(1)).alias("n_anchors"))
        sizes = sizes.join(self.links.groupBy("project").agg(F.count(F.lit(1)).alias("n_links")), "project", "left")
        sizes = sizes.join(active.groupBy("project").agg(F.count(F.lit(1)).alias("n_nodes")), "project")
        block = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(MAX_BITS) / F.col("n_nodes") / 64) * 64))
        sizes = sizes.select("project", "n_anchors", F.coalesce("n_links", F.lit(0)).alias("n_links"), block.cast("long").alias("block"))
        self.sizes = stage(sizes.withColumn("n_blocks", F.ceil(F.col("n_anchors") / F.col("block"))).withColumn("number", F.monotonically_increasing_id()), "sizes")

    def held(self, part: DataFrame, large: bool = False) -> DataFrame:
        """Rows of the projects that a task holds, or of the large ones."""
        return part.join(self.sizes.where((F.col("n_links") > MAX_LINKS) == F.lit(large)).select("project"), "project", "left_semi")

    def has_large(self) -> bool:
        return not self.sizes.where(F.col("n_links") > MAX_LINKS).isEmpty()

    def walk(self, run: Callable, schema: str, tags: DataFrame | None = None) -> DataFrame:
        """``run`` over each block of each project that a task holds; blocks of a project go to different tasks."""
        spark = self.sizes.sparkSession
        small = self.sizes.where(F.col("n_links") <= MAX_LINKS)
        total = small.agg(F.sum("n_blocks"), F.sum(F.col("n_blocks") * F.col("n_links"))).first()
        n_tasks = max(1, min(total[0] or 1, max(8 * spark.sparkContext.defaultParallelism, (total[1] or 0) // TASK_ROWS)))
        rank = F.row_number().over(Window.partitionBy("project").orderBy("id")) - 1
        own = self.anchors.withColumn("rank", rank).join(small, "project").select("number", F.floor(F.col("rank") / F.col("block")).alias("part"), F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("tag"))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("part")
        both = self.links.select("project", F.lit(LINK).alias("kind"), "a", "b", F.lit(None).cast("string").alias("tag"))
        if tags is not None:
            both = both.unionByName(tags.select("project", F.lit(TAG).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "tag"))
        rows = own.unionByName(both.join(small.select("project", "number", "n_blocks"), "project").select("number", parts, "kind", "a", "b", "tag"))
        task = F.pmod(F.xxhash64("number") + F.col("part"), F.lit(n_tasks)).cast("int")
        return rows.repartitionById(n_tasks, task).sortWithinPartitions("number", "part").mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; those of one block follow each other."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        number, part = (batch.column(c).to_numpy() for c in ("number", "part"))
        cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(part) != 0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            at = (number[low], part[low])
            if at != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = at
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def reached(n: int, a: np.ndarray, b: np.ndarray, starts: np.ndarray, max_hops: int) -> np.ndarray:
    """Bits (n x words): bit k of a row is set if it is at most ``max_hops`` links ``a - b`` from ``starts[k]``."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    by_degree = np.argsort(-degree, kind="stable")
    place = np.empty(n, np.int64)
    place[by_degree] = np.arange(n)  # rows go by falling degree, so those with a k-th neighbour are the first ones
    degree = degree[by_degree]
    to, of = np.concatenate([place[a], place[b]]), np.concatenate([place[b], place[a]])
    neighbours = of[np.argsort(to, kind="stable")]
    first = np.concatenate([[0], np.cumsum(degree)])
    n_hubs = int(np.searchsorted(-degree, -64, "left"))  # of more than 64
    counts = [int(np.searchsorted(-degree, -k, "left")) for k in range(65)]  # rows of more than k
    seen = np.zeros((n, (len(starts) + 63) // 64), np.uint64)
    k = np.arange(len(starts), dtype=np.uint64)
    seen[place[starts], (k >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (k & np.uint64(63))
    for _ in range(max_hops):
        new = seen.copy()
        for v in range(n_hubs):
            for at in range(first[v], first[v + 1], 65536):
                new[v] |= np.bitwise_or.reduce(seen[neighbours[at : min(at + 65536, first[v + 1])]], axis=0)
        for k in range(64):
            if counts[k] <= n_hubs:
                break
            rows = slice(n_hubs, counts[k])
            new[rows] |= seen[neighbours[first[rows] + k]]
        if np.array_equal(new, seen):
            break
        seen = new
    return seen[place]


def _columns(bits: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The rows set in each of the first ``n`` bits."""
    octets = bits.astype("<u8", copy=False).view(np.uint8)
    for at in range(0, (n + 7) // 8):
        eight = np.unpackbits(np.ascontiguousarray(octets[:, at])[None, :], axis=0, bitorder="little")
        for k in range(min(8, n - 8 * at)):
            yield np.flatnonzero(eight[k])


def _walked(table: pa.Table, max_hops: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-nodes and nodes of a block by rising id, and the bits of the nodes."""
    kind, a = table.column("kind").to_numpy(), table.column("a").to_numpy()
    link = kind == LINK
    anchors, a, b = np.unique(a[kind == NODE]), a[link], table.column("b").filter(pa.array(link)).to_numpy()
    ids = np.unique(np.concatenate([anchors, a, b]))
    return anchors, ids, reached(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b), np.searchsorted(ids, anchors), max_hops)


def _pairs(max_hops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, members, n = [], [], 0

        def made() -> pa.RecordBatch:
            anchors = np.repeat(np.array(of, np.int64), [len(m) for m in members])
            return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.concatenate(members))], names=["anchor_id", "member_id"])

        for table in _blocks(batches):
            anchors, ids, bits = _walked(table, max_hops)
            for anchor, rows in zip(anchors, _columns(bits, len(anchors))):
                for at in range(0, len(rows), BATCH_ROWS):
                    of.append(anchor)
                    members.append(ids[rows[at : at + BATCH_ROWS]])
                    n += len(members[-1])
                    if n >= BATCH_ROWS:
                        yield made()
                        of, members, n = [], [], 0
        if n:
            yield made()

    return run


def _digests(max_hops: int, n_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            anchors, ids, bits = _walked(table, max_hops)
            sizes, first = [], []
            for rows in _columns(bits, len(anchors)):
                sizes.append(len(rows))
                first.append(ids[rows[:n_first]])
            told = table.filter(pa.array(table.column("kind").to_numpy() == TAG))
            at = np.searchsorted(ids, told.column("a").to_numpy())
            a = told.column("a").to_numpy()
            here = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == a)  # other nodes have no links
            names = told.column("tag").filter(pa.array(here)).combine_chunks().dictionary_encode()
            code, at = names.indices.to_numpy(), at[here]
            order = np.argsort(code, kind="stable")
            each = np.split(at[order], np.flatnonzero(np.diff(code[order])) + 1) if len(code) else []
            of_tags = np.array([np.bitwise_or.reduce(bits[rows], axis=0) for rows in each], np.uint64).reshape(len(each), bits.shape[1])
            tags = list(_columns(of_tags, len(anchors)))
            offsets = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors), pa.array(np.array(sizes, np.int64)), pa.ListArray.from_arrays(offsets(first), pa.array(np.concatenate(first))),
                    pa.ListArray.from_arrays(offsets(tags), names.dictionary.take(pa.array(np.concatenate(tags)))),
                ],
                names=["anchor_id", "n_members", "first", "tags"],
            )

    return run


def pairs(graph: Graph, max_hops: int) -> DataFrame:
    """(anchor_id, member_id): what each super-node reaches."""
    out = graph.walk(_pairs(max_hops), PAIRS)
    return out.unionByName(large_pairs(graph, max_hops)) if graph.has_large() else out


def large_pairs(graph: Graph, max_hops: int) -> DataFrame:
    """As ``pairs``, of the projects that no task holds: all super-nodes advance together by frontier joins."""
    links = graph.held(graph.links, large=True)
    step = stage(links.select(F.col("a").alias("_from"), F.col("b").alias("_to")).unionByName(links.select(F.col("b").alias("_from"), F.col("a").alias("_to"))), "steps")
    seen = stage(graph.held(graph.anchors, large=True).select(F.col("id").alias("anchor_id"), F.col("id").alias("member_id")), "members")
    frontier = seen
    for _ in range(max_hops):
        nxt = frontier.join(step, F.col("member_id") == F.col("_from")).select("anchor_id", F.col("_to").alias("member_id")).distinct()
        frontier = stage(nxt.join(seen, ["anchor_id", "member_id"], "left_anti"), "members")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def digests(graph: Graph, nodes: DataFrame, max_hops: int, n_first: int) -> DataFrame:
    """(anchor_id, n_members, first, tags) of the projects that a task holds: size, smallest ids and distinct tags, unordered, of what each super-node reaches."""
    key = F.coalesce("project_uuid", F.lit("")).alias("project")
    tags = nodes.where("status = 'ACTIVE'").select("id", key, F.explode(parsed_tags(F.col("tags"))).alias("tag")).where("tag is not null").distinct()
    return graph.walk(_digests(max_hops, n_first), DIGESTS, tags)
