"""Joins that keep ambiguity and gaps as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.ids import stable_id

#: Rows of a key on either side of a cell of ``block_join``, so a cell gives about a million pairs.
BLOCK_ROWS = 1000
#: Pairs that one task of ``block_join`` makes, about.
TASK_PAIRS = 2_000_000
#: Rows that one task of a dealt table gets, about.
TASK_ROWS = 500_000


def unique_or_ambiguous(facts: DataFrame, candidates: DataFrame, key: str | Sequence[str], candidate_id: str) -> DataFrame:
    """``facts`` with candidate_count, status (matched, ambiguous, unresolved) and the id of a unique candidate.

    The right side is reduced to one row per key before the join, so facts are never multiplied; a null key is unresolved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    per_key = candidates.where(F.col(candidate_id).isNotNull()).groupBy(*keys).agg(F.count_distinct(candidate_id).alias("candidate_count"), F.min(candidate_id).alias("_only"))
    joined = facts.join(per_key, keys, "left")
    count = F.coalesce("candidate_count", F.lit(0).cast("long"))
    status = F.when(count == 1, "matched").when(count > 1, "ambiguous").otherwise("unresolved")
    return joined.withColumn("candidate_count", count).withColumn("status", status).withColumn("selected_id", F.when(count == 1, F.col("_only"))).drop("_only")


def gaps(matched: DataFrame, subject: str, layer: str) -> DataFrame:
    """A row with a stable id for everything that ``unique_or_ambiguous`` left open."""
    kind = F.concat(F.col("status"), F.lit(f"_{layer}"))
    return matched.where("status <> 'matched'").select(stable_id("gap", F.lit(layer), F.col(subject), F.col("status")).alias("gap_id"), F.col(subject).alias("subject_id"), kind.alias("gap_kind"), "candidate_count")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with a key that no parent has."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def with_exists(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """EXISTS as a column."""
    there = other.select(F.col(other_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_count(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """A correlated count as a column, aggregated before the join."""
    n = other.groupBy(F.col(other_key).alias(key)).agg(F.count("*").alias(name))
    return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def either_endpoint(edges: DataFrame, nodes: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Edges that touch one of ``nodes``: each end is flagged by an equi-join, in place of an OR; the edges are read once."""
    ids = nodes.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    at = lambda column, flag: ids.select(F.col(key).alias(column), F.lit(True).alias(flag))
    flagged = edges.join(at(left, "_left"), left, "left").join(at(right, "_right"), right, "left")
    return flagged.where(F.col("_left") | F.col("_right")).select(*edges.columns)


def list_membership(df: DataFrame, lists: DataFrame, id_column: str, list_column: str) -> DataFrame:
    """Rows of ``df`` with each list that holds their id, by explode and equi-join."""
    return df.join(lists.withColumn(id_column, F.explode(F.array_distinct(list_column))), id_column)


def first_tier(facts: DataFrame, fact_id: str, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], target: str, exclude: Column | None = None) -> DataFrame:
    """Candidates of the first tier that has any.

    ``tiers`` are (name, targets with the join columns and ``target``, join columns), best first. ``exclude`` drops candidates,
    such as those of the fact's own repository, before the tier is chosen.
    """
    found, rest = None, facts.where(F.col(fact_id).isNotNull())
    for rank, (name, targets, keys) in enumerate(tiers, 1):
        hits = rest.join(targets, list(keys))
        if exclude is not None:
            hits = hits.where(~exclude)
        hits = hits.select(fact_id, F.col(target).alias("target_id"), F.lit(rank).alias("tier"), F.lit(name).alias("tier_name")).distinct()
        found = hits if found is None else found.unionByName(hits)
        rest = rest.join(hits.select(fact_id).distinct(), fact_id, "left_anti")  # later tiers are for what is left
    return found


def first_tier_counts(facts: DataFrame, fact_id: str, tiers: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``verdict`` over ``first_tier`` where the facts themselves are the targets, each for all others.

    Candidates are counted per key before the join, so a key of many facts makes no pairs. Only ids that come with several
    keys are paired, as their candidates can overlap.
    """
    columns = list(dict.fromkeys(c for _, keys in tiers for c in keys))
    known = facts.where(F.col(fact_id).isNotNull()).select(fact_id, *columns).distinct()
    n_keys = known.groupBy(fact_id).agg(F.count("*").alias("_n"))
    once = known.join(n_keys.where("_n = 1").select(fact_id), fact_id, "left_semi")
    several = known.join(n_keys.where("_n > 1").select(fact_id), fact_id, "left_semi")
    hits = None
    for rank, (name, keys) in enumerate(tiers, 1):
        per_key = known.groupBy(*keys).agg(F.count_distinct(fact_id).alias("_of_key"), F.min(fact_id).alias("_least"), F.max(fact_id).alias("_most")).where("_of_key > 1")
        other = F.when(F.col("_of_key") == 2, F.when(F.col("_least") == F.col(fact_id), F.col("_most")).otherwise(F.col("_least")))
        hit = once.join(per_key, list(keys)).select(fact_id, F.struct(F.lit(rank).alias("tier"), F.lit(name).alias("tier_name"), (F.col("_of_key") - 1).alias("candidate_count"), other.alias("target_id")).alias("_hit"))
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy(fact_id).agg(F.min("_hit").alias("_hit")).select(fact_id, "_hit.*")
    targets = known.withColumnRenamed(fact_id, "_target")
    paired = first_tier(several, fact_id, [(name, targets.select("_target", *keys).distinct(), keys) for name, keys in tiers], "_target", F.col(fact_id) == F.col("_target"))
    paired = verdict(paired, several.select(fact_id).distinct(), fact_id).where("tier is not null").drop("status")
    joined = facts.select(fact_id).join(best.unionByName(paired), fact_id, "left")
    n = F.coalesce("candidate_count", F.lit(0).cast("long"))
    return joined.select(fact_id, "tier", "tier_name", n.alias("candidate_count"), F.when(n == 0, "unresolved").when(n == 1, "matched").otherwise("ambiguous").alias("status"), "target_id")


def verdict(candidates: DataFrame, facts: DataFrame, fact_id: str) -> DataFrame:
    """One row per fact: tier, candidate_count, status, and the target if it is unique."""
    per_fact = candidates.groupBy(fact_id).agg(F.min("tier").alias("tier"), F.min("tier_name").alias("tier_name"), F.count("*").alias("candidate_count"), F.min("target_id").alias("_only"))
    joined = facts.select(fact_id).join(per_fact, fact_id, "left")
    n = F.coalesce("candidate_count", F.lit(0).cast("long"))
    return joined.select(fact_id, "tier", "tier_name", n.alias("candidate_count"), F.when(n == 0, "unresolved").when(n == 1, "matched").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("_only")).alias("target_id"))


def covered_keys(pairs: DataFrame, declared: DataFrame, group: Sequence[str]) -> DataFrame:
    """Declared keys (``group`` + key_id, key_columns) all of whose columns a join of the group uses (``group`` + column)."""
    used = pairs.groupBy(*group).agg(F.collect_set("column").alias("used_columns"))
    return declared.join(used, list(group)).where(F.size(F.array_except("key_columns", "used_columns")) == 0)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over so many tasks that each gets about TASK_ROWS of ``rows``: what a task sorts or keeps doesn't grow with the table."""
    return df.repartition(rows // TASK_ROWS + 1, *keys)


def block_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on few keys that have many rows on both sides, whose result is far larger than its inputs.

    The rows of a key are cut into blocks of about BLOCK_ROWS by the hash of the row, and each pair of blocks is a cell of its own; cells are dealt over
    tasks by the number of pairs. A row is repeated for each block of the other side, so what is shuffled is the inputs and a share of 2 / BLOCK_ROWS of the result.
    Only keys that are cut are broadcast, at most two for BLOCK_ROWS rows. Equal rows share a block.
    """
    a, b = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    sizes = a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    share = lambda x, rows: int((x or 0) // rows) + 1
    pairs, a_copies, b_copies = sizes.agg(F.sum(F.col("_a").cast("double") * F.col("_b")), F.sum(F.col("_a") * blocks("_b")), F.sum(F.col("_b") * blocks("_a"))).first()
    tasks = max(share(pairs, TASK_PAIRS), share((a_copies or 0) + (b_copies or 0), TASK_ROWS))
    cut = F.broadcast(sizes.where(F.greatest("_a", "_b") > BLOCK_ROWS).select(key, blocks("_a").cast("int").alias("_a"), blocks("_b").cast("int").alias("_b")))

    def dealt(df: DataFrame, own: str, other: str, copies: int) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        hashed = df.withColumn("_h", F.xxhash64(*df.columns))
        # one task makes a bounded number of copies, however few files there are
        spread = hashed.repartition(copies, "_h") if copies > 1 else hashed
        block = F.pmod("_h", n(own)).cast("int").alias(f"{own}_block")
        cells = spread.join(cut, key, "left").select(*df.columns, block, F.explode(F.sequence(F.lit(0), n(other) - 1)).alias(f"{other}_block"))
        return cells.repartition(tasks, key, "_a_block", "_b_block")

    # a broadcast of the copies would grow with the result
    cells = dealt(a, "_a", "_b", share(a_copies, TASK_ROWS)).hint("merge").join(dealt(b, "_b", "_a", share(b_copies, TASK_ROWS)), [key, "_a_block", "_b_block"])
    return cells.drop("_a_block", "_b_block")
