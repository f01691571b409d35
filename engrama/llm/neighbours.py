"""Most similar vectors for every vector.

Vectors are routed to shards by centroids.  Every shard builds a robust-pruned
directed graph (``vamana``) of its own vectors and answers, by beam search, the
queries routed to it: those of its own vectors and those of vectors to which its
centroid is among the ``PROBES`` nearest, and less similar than the nearest one by
at most ``MARGIN``.  The answers of all shards are merged per query.

A shard has about ``SHARD`` vectors whatever the collection, so the cost per
vector does not grow with it.  Centroids are fitted on two levels: as many cells
as the root of the number of shards, on a sample of ``SAMPLE`` vectors, and the
shards of each cell on a sample of ``PER_SHARD`` vectors a shard of that cell, so
every shard's centroid rests on as many vectors.  ``MAX_SHARDS`` bounds what is broadcast; beyond
it, shards grow.  A shard that came out too large is cut by a hash into parts,
each asked by all of the shard's queries, and the queries of any shard are put
in blocks of bounded size, whoever asks.  Exact copies of a
vector form one point of the graph: a third of all rows being one vector
neither crowds a shard nor fills the beam, and its copies come back afterwards.

Defined cases
-------------
* of several rows of a ``doc_id`` only the latest ``stored_at`` counts (ties:
  the greater embedding), even if its embedding is unusable.
* null, all-zero, non-finite and wrong-length embeddings take no part.
* a vector is no neighbour of itself; copies are neighbours with similarity 1.
* ties in similarity: the smaller node id.  Fewer than k others: all of them.
* null node ids take no part; an empty table gives an empty result; further
  columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.vamana import BATCH, Graph
from engrama.staging import stage

DIM = 384
SHARD = 4096
MAX_SHARD = 3 * SHARD
SAMPLE = 8_192
PER_SHARD = 512
MAX_SHARDS = 65_536
BLOCK = 4 * SHARD
#: Tasks that shards are spread over, about one each, for the time a task takes depends on its shards, not its bytes.
MAX_TASKS = 20_000
PROBES = 12
MARGIN = 0.12
SALTS = 16
POINT_SCHEMA = "node_id long, copy_key string, vector binary"
FOUND_SCHEMA = "node_id long, neighbour_id long, similarity double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = b"".join(x for x in column.to_pylist())
    return np.frombuffer(data, np.float32).reshape(-1, DIM)


def _packed(vectors: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(vectors, np.float32)], pa.binary())


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        flat = batch.column("embedding").flatten()
        x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIM)
        with np.errstate(all="ignore"):
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
        unit = (x[good] / size[good, None]).astype(np.float32)
        keys = [xxhash.xxh3_128_hexdigest((np.round(row, 6) + 0.0).tobytes()) for row in unit]
        ids = batch.column("node_id").filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), _packed(unit)], ["node_id", "copy_key", "vector"])


def usable_points(vectors: DataFrame) -> DataFrame:
    """``POINT_SCHEMA``: unit vectors of the current usable embeddings."""
    latest = (
        vectors.groupBy("doc_id").agg(F.max(F.struct("stored_at", "embedding", "node_id")).alias("row"))
        .select("row.node_id", F.col("row.embedding").alias("embedding"))
        .where((F.size("embedding") == DIM) & F.col("node_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    )
    return latest.mapInArrow(_normalise, POINT_SCHEMA)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; it starts from the vectors themselves, so dense regions get more centroids."""
    centroids = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(12):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-9), centroids).astype(np.float32)
    return centroids


def fit_centroids(points: DataFrame, n_shards: int, total: int) -> np.ndarray:
    """Centroids of about ``n_shards`` shards, on samples of the smallest hashes."""
    spark = points.sparkSession
    low = F.pmod(F.xxhash64("node_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total)))
    rows = points.where(low).select("node_id", "vector").orderBy("node_id").collect()
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.float32).reshape(-1, DIM)
    if not len(x):
        return np.zeros((1, DIM), np.float32)
    cells = _k_means(x, math.isqrt(max(0, n_shards - 1)) + 1)
    held = spark.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(held.value), np.int64)
        for batch in batches:
            n += np.bincount((_matrix(batch.column("vector")) @ held.value.T).argmax(axis=1), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["cell", "n"])

    sizes = np.zeros(len(cells), np.int64)
    for r in points.select("vector").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]  # one row per cell
    wanted = np.maximum(1, np.rint(n_shards * sizes / max(1, total))).astype(np.int64)
    share = np.minimum(1.0, PER_SHARD * wanted / np.maximum(1, sizes))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_matrix(batch.column("vector")) @ held.value.T).argmax(axis=1)
            kept = batch.column("h").to_numpy() < share[cell] * (1 << 30)
            yield pa.RecordBatch.from_arrays([pa.array(cell[kept].astype(np.int32)), batch.column("h").filter(pa.array(kept)), batch.column("vector").filter(pa.array(kept))], ["cell", "h", "vector"])

    def refine(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        fine = _k_means(_matrix(table.column("vector"))[order], int(wanted[table.column("cell")[0].as_py()]))
        return pa.table({"vector": _packed(fine)})

    h = F.pmod(F.xxhash64("node_id", F.lit(1)), F.lit(1 << 30)).alias("h")
    fine = points.select(h, "vector").mapInArrow(sample, "cell int, h long, vector binary").groupBy("cell").applyInArrow(refine, "vector binary")
    found = sorted(bytes(r[0]) for r in fine.collect())  # at most about MAX_SHARDS rows
    return np.frombuffer(b"".join(found), np.float32).reshape(-1, DIM)


def _asked(x: np.ndarray, centroids: np.ndarray, sizes: np.ndarray | None = None, enough: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, shard) of every shard that a vector asks, its own with rank 0.

    With ``sizes``, a vector whose shards hold fewer than ``enough`` others asks as
    many more as it takes, the nearest first.
    """
    sims = x @ centroids.T
    k = min(PROBES, len(centroids))
    order = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(sims, order, 1)
    rank = np.argsort(-best, axis=1, kind="stable")
    order, best = np.take_along_axis(order, rank, 1), np.take_along_axis(best, rank, 1)
    row, rank = np.nonzero(best >= best[:, :1] - MARGIN)
    shard = order[row, rank]
    if sizes is None:
        return row, rank, shard
    few = np.flatnonzero(np.bincount(row, sizes[shard], len(x)) < enough)
    if len(few):
        order = np.argsort(-sims[few], axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        more, more_rank = np.nonzero(held < enough)
        kept = ~np.isin(row, few)
        row, rank, shard = (np.concatenate(p) for p in ((row[kept], few[more]), (rank[kept], more_rank), (shard[kept], order[more, more_rank])))
    return row, rank, shard


def _counter(centroids):
    """Rows (shard, own, asks): how many vectors it holds, and how many ask it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asks = np.zeros((2, len(centroids.value)), np.int64)
        for batch in batches:
            if batch.num_rows:
                _, rank, shard = _asked(_matrix(batch.column("vector")), centroids.value)
                asks += np.bincount(shard, minlength=len(asks))
                own += np.bincount(shard[rank == 0], minlength=len(own))
        at = np.flatnonzero(asks)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at]), pa.array(asks[at])], ["shard", "own", "asks"])

    return count


def _router(centroids, pieces, enough: int):
    """Rows (piece, own, asks, node_id, vector).

    A piece of a shard is one of its parts, whose vectors it holds (``own``), and
    one block of the queries that are put to it (``asks``).
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blocks, first, sizes = pieces.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("node_id").to_numpy()
            row, rank, shard = _asked(_matrix(batch.column("vector")), centroids.value, sizes, enough)
            n_parts, n_blocks = parts[shard], blocks[shard]
            copies = n_parts * n_blocks
            at = np.repeat(np.arange(len(row)), copies)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            mixed = ids[row] * 2654435761 >> 7
            own = (rank[at] == 0) & (mixed[at] % n_parts[at] == piece % n_parts[at])
            asks = mixed[at] // 97 % n_blocks[at] == piece // n_parts[at]
            kept = own | asks
            row, piece, own, asks = row[at][kept], (first[shard[at]] + piece)[kept], own[kept], asks[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(own), pa.array(asks), pa.array(ids[row]), batch.column("vector").take(pa.array(row))],
                ["piece", "own", "asks", "node_id", "vector"],
            )

    return route


def _shard_search(k: int):
    def search(table: pa.Table) -> pa.Table:
        ids = table.column("node_id").to_numpy()
        own = table.column("own").to_numpy()
        order = np.lexsort((ids, ~own))  # own vectors first, by id
        ids, own, asks = ids[order], own[order], table.column("asks").to_numpy()[order]
        x = _matrix(table.column("vector"))[order]
        n = int(own.sum())
        out_q, out_i, out_s = [], [], []
        if n:
            graph = Graph(x[:n])
            asking = np.flatnonzero(asks)
            for i in range(0, len(asking), BATCH):
                q = asking[i : i + BATCH]
                at, sims = graph.search(x[q], np.where(own[q], q, n))
                sims = np.where((at == q[:, None]) | (at >= n), -9, sims)
                best = np.lexsort((ids[np.minimum(at, n - 1)], -sims), axis=1)[:, :k]
                at, sims = np.take_along_axis(at, best, 1), np.take_along_axis(sims, best, 1)
                row, col = np.nonzero(sims > -5)
                out_q.append(ids[q[row]])
                out_i.append(ids[at[row, col]])
                out_s.append(sims[row, col].astype(np.float64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"node_id": join(out_q, np.int64), "neighbour_id": join(out_i, np.int64), "similarity": join(out_s, np.float64)})

    return search


def _piece_search(k: int):
    """The search of all pieces of a task; most tasks have one."""
    search = _shard_search(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for piece in pc.unique(table.column("piece")):
            yield from search(table.filter(pc.equal(table.column("piece"), piece))).to_batches()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best neighbours per node; a node has at most k rows per shard it asked."""
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour_id").alias("id"))))
    return (
        found.groupBy("node_id").agg(F.slice(ranked, 1, k).alias("near"))
        .select("node_id", F.explode("near").alias("near"))
        .select("node_id", F.col("near.id").alias("neighbour_id"), (-F.col("near.d")).alias("similarity"))
    )


def nearest(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``FOUND_SCHEMA``: the k most similar other nodes of every node."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    points = stage(usable_points(vectors), "points")
    sizes = points.groupBy("copy_key").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("rep"))
    copied = stage(sizes.where("n > 1").select("copy_key", "rep"), "copied")
    has_copies = not copied.isEmpty()
    unique = points
    if has_copies:
        members = stage(points.select("node_id", "copy_key").join(copied, "copy_key").select("rep", F.col("node_id").alias("member")).distinct(), "members")
        unique = points.join(copied, "copy_key", "left").where("rep is null or rep = node_id").select("node_id", "vector")

    total = unique.select("node_id").count()
    centroids = spark.sparkContext.broadcast(fit_centroids(unique, min(MAX_SHARDS, max(1, round(total / SHARD))), total))
    own, asks = np.zeros((2, len(centroids.value)), np.int64)
    counted = unique.select("vector").mapInArrow(_counter(centroids), "shard int, own long, asks long").groupBy("shard").agg(F.sum("own"), F.sum("asks"))
    for shard, n_own, n_asks in counted.collect():  # one row per shard
        own[shard], asks[shard] = n_own, n_asks
    parts = np.where(own > MAX_SHARD, -(-own // SHARD), 1)
    blocks = np.maximum(1, -(-asks // BLOCK))
    first = np.cumsum(parts * blocks) - parts * blocks
    n_pieces = int((parts * blocks).sum())
    pieces = spark.sparkContext.broadcast((parts, blocks, first, own))
    routed = unique.select("node_id", "vector").mapInArrow(_router(centroids, pieces, k + 1), "piece int, own boolean, asks boolean, node_id long, vector binary")
    n_tasks = max(1, min(MAX_TASKS, n_pieces))
    found = routed.repartitionById(n_tasks, F.col("piece") % n_tasks).mapInArrow(_piece_search(k), FOUND_SCHEMA)
    best = _best(found, k)
    return _with_copies(best, members, k) if has_copies else best


def _with_copies(best: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Put the copies back: as neighbours by their first ids, as nodes all of them.

    Only the k + 1 smallest ids of a group of copies can be anyone's neighbours.
    They are found per salt first, so no group is ranked in one task as a whole.
    """
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")
    heads = members.withColumn("salt", salt)
    for keys in (["rep", "salt"], ["rep"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("member"))
        heads = heads.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    heads = stage(heads.select("rep", "member"), "heads")
    wide = best.join(heads.withColumnRenamed("rep", "neighbour_id"), "neighbour_id", "left").select(
        "node_id", F.coalesce("member", "neighbour_id").alias("neighbour_id"), "similarity"
    )
    own = heads.select(F.col("rep").alias("node_id"), F.col("member").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    wide = wide.unionByName(own)
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour_id").alias("id"))))
    lists = stage(wide.groupBy("node_id").agg(F.slice(ranked, 1, k + 1).alias("near")), "lists")
    is_rep = members.select(F.col("rep").alias("node_id")).distinct()
    single = lists.join(is_rep, "node_id", "left_anti").select("node_id", "near")
    salted = lists.join(is_rep, "node_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = members.withColumn("salt", salt).join(salted.withColumnRenamed("node_id", "rep"), ["rep", "salt"])
    every = single.unionByName(each.select(F.col("member").alias("node_id"), "near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("node_id")), 1, k)
    return every.select("node_id", F.explode(others).alias("near")).select(
        "node_id", F.col("near.id").alias("neighbour_id"), (-F.col("near.d")).alias("similarity")
    )


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """Pairs (smaller id first) of at least the similarity ``least``."""
    return (
        found.where(F.col("similarity") >= least)
        .select(F.least("node_id", "neighbour_id").alias("node_id_a"), F.greatest("node_id", "neighbour_id").alias("node_id_b"))
        .where("node_id_a <> node_id_b")
        .distinct()
    )
