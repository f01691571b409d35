"""Parent-child links to full hierarchies, by level-wise frontier joins.

Roots (ids that hold others and have no holder) form level 0.  Each round joins
the frontier with the links whose holder it contains and thereby extends path,
depth and root by one level.  An id becomes final when *all* of its holders are
final, so an id that is also reachable from a loop is never reported as part of
a tree.  Ids that no round reaches lie on a loop or below one; their loop is
found by pointer doubling, in as many rounds as the logarithm of the loop.

Defined cases
-------------
* null ids, ended links and other relation types are no links; repeated links
  and both spellings of one link count once.
* an empty table gives an empty result; ids need not occur in ``nodes``.
* several holders: depth is the smallest one, root and path come from the
  holder with the smallest (depth, root, id).
* on or below a loop: depth -1, root the smallest id of the loop (with several
  holders on loops: of the loop found by following the smallest holder), path
  null.  A self-reference is a loop of one.
* descendants: on or below a loop, and under several holders, too; every id
  above counts once, with its shortest distance; no id is its own descendant.
* further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.staging import Levels, stage

SCHEMA = "node_id long, root_id long, depth int, path array<long>"


def containment_links(edges: DataFrame) -> DataFrame:
    """Current links (holder, item) of the containment rows of ``edges``."""
    rel = F.lower(F.trim(F.col("relation_type")))
    holds = rel == "contains"
    held = rel == "contained_by"
    return (
        edges.where(F.col("valid_to_commit").isNull() & (holds | held))
        .select(
            F.when(holds, F.col("source_id")).otherwise(F.col("target_id")).cast("long").alias("holder"),
            F.when(holds, F.col("target_id")).otherwise(F.col("source_id")).cast("long").alias("item"),
        )
        .where("holder is not null and item is not null")
        .distinct()
    )


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """One row per id of ``links(holder, item)``: node_id, root_id, depth, path.

    ``path`` lists the ids from the root to the node itself; without ``with_path`` it
    is left null, and its bytes, which grow with the sum of all depths, unwritten.
    All levels are parts of one table, so the result is a single scan however deep
    the trees are, and the number of rows written tells when to end.
    """
    spark = links.sparkSession
    degree = links.groupBy("item").agg(F.count(F.lit(1)).alias("n_holders"))
    linked = stage(links.select("holder", "item").join(degree, "item").select("holder", "item", "n_holders"), "links")
    several = not linked.where("n_holders > 1").isEmpty()
    levels = Levels(spark, SCHEMA)

    roots = linked.select("holder").distinct().join(linked.select(F.col("item").alias("holder")), "holder", "left_anti")
    path = F.array("holder") if with_path else F.lit(None).cast("array<long>")
    levels.add(roots.select(F.col("holder").alias("node_id"), F.col("holder").alias("root_id"), F.lit(0).alias("depth"), path.alias("path")))
    waiting = None
    while levels.last_rows:
        frontier = levels.last()
        longer = F.concat("path", F.array("item")) if with_path else F.lit(None).cast("array<long>")
        reached = linked.join(frontier, linked["holder"] == frontier["node_id"]).select(
            F.col("item").alias("node_id"),
            "n_holders",
            F.struct((F.col("depth") + 1).alias("depth"), "root_id", F.col("holder"), longer.alias("path")).alias("best"),
        )
        new = reached.where("n_holders = 1") if several else reached
        new = new.select("node_id", "best.root_id", "best.depth", "best.path")
        if several:
            part = reached.where("n_holders > 1").withColumn("got", F.lit(1).cast("long"))
            if waiting is not None:
                part = part.unionByName(waiting)
            held = stage(
                part.groupBy("node_id", "n_holders").agg(F.min("best").alias("best"), F.sum("got").alias("got")), "held"
            )
            waiting = held.where("got < n_holders")
            new = new.unionByName(
                held.where("got = n_holders").select("node_id", "best.root_id", "best.depth", "best.path")
            )
        levels.add(new)

    done = levels.all()
    open_links = stage(linked.join(done.select(F.col("node_id").alias("item")), "item", "left_anti").select("holder", "item"), "open")
    looped = open_links.join(open_links.select(F.col("item").alias("holder")).distinct(), "holder", "left_semi")
    pointers = stage(looped.groupBy(F.col("item").alias("node_id")).agg(F.min("holder").alias("next")), "loops")
    if pointers.isEmpty():
        return done
    bad = loop_minimum(pointers).select(
        "node_id",
        F.col("loop_id").alias("root_id"),
        F.lit(-1).alias("depth"),
        F.lit(None).cast("array<long>").alias("path"),
    )
    return done.unionByName(bad)


def loop_minimum(pointers: DataFrame) -> DataFrame:
    """(node_id, loop_id) of ``pointers(node_id, next)``, each leading into a loop.

    After round k, ``jump`` is 2**k steps away and ``low`` the smallest of those
    2**k ids.  The smallest id seen from where the jump lands is the loop's own
    as soon as every id agrees with the one it points to: within a component the
    value is then constant, and some id of the loop lands on the smallest one.
    """
    first = pointers.select("node_id", "next")
    state = pointers.select("node_id", F.col("next").alias("jump"), F.col("node_id").alias("low"))
    while True:
        far = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        both = stage(state.join(far, "jump"), "jumps")
        found = both.select("node_id", F.col("low2").alias("loop_id"))
        ahead = found.select(F.col("node_id").alias("next"), F.col("loop_id").alias("ahead"))
        differs = first.join(found, "node_id").join(ahead, "next").where("loop_id <> ahead")
        if differs.isEmpty():
            return found
        state = both.select("node_id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"))


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node below another one.

    The rows grow with the sum of all depths; no node's descendants are
    gathered into one value, so a root holding a third of all rows is no
    hot group.
    """
    at = tree.where("depth > 0").select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return at.where(F.col("pos") < F.col("depth")).select(
        "ancestor_id", "node_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance")
    )


def descendant_pairs(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node of ``tree`` and each other id above it.

    ``tree`` is all or some rows of ``hierarchy(links)``.  A node whose path is the
    only way up takes its pairs from the path.  For all others (on or below a
    loop, with several holders, or below an id with several) frontier joins climb
    ``links`` from holder to holder; a pair seen before is not followed again, so
    loops end, every holder counts, and the distance is the shortest one.  No id
    is its own ancestor.
    """
    several = links.groupBy(F.col("item").alias("ancestor_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ancestor_id")
    on_path = tree.where("depth >= 0").select("node_id", F.explode("path").alias("ancestor_id"))
    odd = tree.where("depth < 0").select("node_id").unionByName(on_path.join(several, "ancestor_id", "left_semi").select("node_id").distinct())
    odd = stage(odd, "odd")
    if odd.isEmpty():
        return ancestor_pairs(tree)
    direct = ancestor_pairs(tree.join(odd, "node_id", "left_anti"))
    up = links.select(F.col("item").alias("at"), F.col("holder").alias("ancestor_id"))
    level = stage(up.withColumnRenamed("at", "node_id").join(odd, "node_id", "left_semi").where("ancestor_id <> node_id").distinct().withColumn("distance", F.lit(1)), "pairs")
    climbed, n_parts = level, 1
    while not level.isEmpty():
        further = level.select("node_id", F.col("ancestor_id").alias("at"), "distance").join(up, "at").where("ancestor_id <> node_id")
        further = further.select("node_id", "ancestor_id", (F.col("distance") + 1).alias("distance")).distinct()
        level = stage(further.join(climbed.select("node_id", "ancestor_id"), ["node_id", "ancestor_id"], "left_anti").select("ancestor_id", "node_id", "distance"), "pairs")
        climbed = climbed.unionByName(level)
        n_parts += 1
        if n_parts == 16:  # short plans, however long a loop is
            climbed, n_parts = stage(climbed, "pairs"), 1
    return direct.unionByName(climbed)


def descendant_counts(tree: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node_id, n_descendants), zero for leaves; partial sums precede the shuffle.

    With ``links`` every way up counts (see ``descendant_pairs``), else the paths alone.
    """
    pairs = ancestor_pairs(tree) if links is None else descendant_pairs(links, tree)
    below = pairs.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return tree.select("node_id").join(below, "node_id", "left").select(
        "node_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_descendants")
    )


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "/")
