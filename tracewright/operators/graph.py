"""Closures, components and paths over edge tables.

Loops keep their state as staged tables; see ``checkpointed``.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("unknown", "probable", "confirmed")
#: So many frontiers are united in a plan before they are written as one table.
MERGED = 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(start, node, depth): everything reachable, with the smallest depth; cycles end where a node was met before.

    Each round writes its own frontier alone; what was met is their union.
    """
    steps = checkpointed(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("next is not null").distinct())
    rounds = [checkpointed(steps.select(F.col("node").alias("start"), F.col("next").alias("node")).distinct().withColumn("depth", F.lit(1)))]
    for depth in count(2):
        found = rounds[-1].join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        met = reduce(DataFrame.unionByName, [r.select("start", "node") for r in rounds])
        frontier = checkpointed(found.join(met, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(frontier)
        if len(rounds) > MERGED:
            rounds = [checkpointed(reduce(DataFrame.unionByName, rounds[:-1])), frontier]


def components(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """(node, component): weakly connected components named by the smallest node; singletons stay.

    Smallest labels are passed to neighbours and then jump along labels, so the rounds grow with the logarithm of the diameter.
    """
    both = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("jump")).where("new <> jump")
        moved = checkpointed(moved.join(jump, "new", "left").select("node", F.coalesce("jump", "new").alias("label"), "old"))
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")


def islands(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str, mode: str) -> DataFrame:
    """Components over confirmed edges (strict) or confirmed and probable ones (extended), with degrees."""
    allowed = {"strict": CONFIDENCE[2:], "extended": CONFIDENCE[1:]}[mode]
    kept = edges.where(F.col("confidence").isin(*allowed))
    ends = kept.select(F.col(source).alias("node")).unionByName(kept.select(F.col(target).alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return components(nodes, kept, node, source, target).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def shortest_paths(edges: DataFrame, source: str, target: str, start: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, hops, path): a shortest path to each node within ``max_hops``; ties go to the smallest path."""
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null").distinct()
    frontier = start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node"), F.lit(0).alias("hops"), F.array(F.col(start.columns[0])).alias("path"))
    rounds = [checkpointed(frontier)]
    for hop in range(1, max_hops + 1):
        found = rounds[-1].join(steps, "node").select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        met = reduce(DataFrame.unionByName, [r.select("start", "node") for r in rounds])
        found = found.groupBy("start", "node").agg(F.min("path").alias("path")).join(met, ["start", "node"], "left_anti")
        frontier = checkpointed(found.select("start", "node", F.lit(hop).alias("hops"), "path"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def simple_paths(edges: DataFrame, source: str, target: str, start: DataFrame, goals: DataFrame, max_hops: int, max_branching: int | None = None) -> DataFrame:
    """Simple paths from ``start`` to ``goals``: (path, hops, confidence, complete, stop_reason).

    A path ends at a goal (complete), where nothing leaves it (``no_outgoing``), where only met nodes follow (``cycle_prevented``) or
    at ``max_hops_reached``. ``max_branching`` keeps the smallest neighbours of a node and is off unless asked for. Confidence is that of the weakest step.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")) - 1, F.lit(0)) if "confidence" in edges.columns else F.lit(2)
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("next"), rank.cast("int").alias("step_rank")).groupBy("node", "next").agg(F.max("step_rank").alias("step_rank"))
    if max_branching:
        from pyspark.sql.window import Window as W

        steps = steps.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("next"))).where(F.col("_n") <= max_branching).drop("_n")
    goal = goals.select(F.col(goals.columns[0]).alias("node")).distinct().withColumn("goal", F.lit(True))
    first = F.col(start.columns[0])
    live = start.select(first.alias("node"), F.array(first).alias("path"), F.lit(2).alias("rank"))
    done = None
    for hop in range(max_hops + 1):
        marked = live.join(goal, "node", "left") if hop else live.withColumn("goal", F.lit(None).cast("boolean"))
        ended = [marked.where("goal").select("path", "rank", F.lit(True).alias("complete"), F.lit(None).cast("string").alias("stop_reason"))]
        going = marked.where("goal is null").drop("goal")
        if hop == max_hops:
            ended.append(going.select("path", "rank", F.lit(False).alias("complete"), F.lit("max_hops_reached").alias("stop_reason")))
        else:
            out = going.join(steps, "node", "left")
            fresh = ~F.array_contains("path", F.col("next"))
            stopped = out.groupBy("path", "rank").agg(F.bool_or(F.coalesce(fresh, F.lit(False))).alias("moves"), F.bool_or(F.col("next").isNotNull()).alias("leaves"))
            ended.append(stopped.where("not moves").select("path", "rank", F.lit(False).alias("complete"), F.when(F.col("leaves"), "cycle_prevented").otherwise("no_outgoing").alias("stop_reason")))
            live = checkpointed(out.where(fresh).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.least("rank", "step_rank").alias("rank")))
        for e in ended:
            done = e if done is None else done.unionByName(e)
    names = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("rank") + 1)
    return done.select("path", (F.size("path") - 1).alias("hops"), names.alias("confidence"), "complete", "stop_reason")


def inherited_members(types: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effective members of types (type_id, parent_id) and (type_id, member): (effective, gaps).

    A type's own member beats inherited ones, a nearer ancestor a farther one; different declarations at one depth are a gap.
    """
    up = closure(types.where("parent_id is not null"), "type_id", "parent_id").select(F.col("start").alias("type_id"), F.col("node").alias("declared_in"), "depth")
    own = members.select("type_id", "member", F.col("type_id").alias("declared_in"), F.lit(0).alias("depth"))
    inherited = up.where("type_id <> declared_in").join(members.select(F.col("type_id").alias("declared_in"), "member"), "declared_in").select("type_id", "member", "declared_in", "depth")
    every = own.unionByName(inherited)
    nearest = every.groupBy("type_id", "member").agg(F.min("depth").alias("depth"))
    chosen = every.join(nearest, ["type_id", "member", "depth"]).groupBy("type_id", "member", "depth").agg(F.count_distinct("declared_in").alias("n"), F.min("declared_in").alias("declared_in"))
    return chosen.where("n = 1").drop("n"), chosen.where("n > 1").select("type_id", "member", F.lit("ambiguous_inherited_field").alias("gap_kind"), F.col("n").alias("candidate_count"))


def neighbourhood(edges: DataFrame, source: str, target: str, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` in either direction, with their distance."""
    both = edges.select(source, target).unionByName(edges.select(F.col(target).alias(source), F.col(source).alias(target)))
    return shortest_paths(both, source, target, start, hops).select("start", "node", "hops")


def path_text(path: str = "path", separator: str = ">") -> Column:
    return F.array_join(F.transform(F.col(path), lambda x: x.cast("string")), separator)

