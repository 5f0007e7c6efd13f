"""Matching of service calls to endpoints, and what the matches cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.ids import path_suffixes, stable_id, url_path

# Hosts that name the machine itself; they bind to nothing, nor does what ends with ``.localhost``.
LOOPBACK = ("localhost", "0.0.0.0", "::", "::1")
_ADDRESS = {"authority": 4, "service": 3, "property": 2, "none": 0}


def binding_authority(authority: Column) -> Column:
    """The authority in lower case, or null where it is a placeholder or the machine itself."""
    plain = F.lower(F.trim(authority))
    host = F.regexp_replace(F.regexp_replace(plain, r"^\[([^\]]*)\](:\d+)?$", "$1"), r"^([^:]*):\d+$", "$1")
    loopback = host.isin(*LOOPBACK) | host.endswith(".localhost")
    return F.when(~loopback & ~plain.rlike(r"^(\$\{.*|\{.*\})$") & (plain != ""), plain)


def candidates(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """Candidate routes of each call: interface_id, target_id, tier, address_rank, path_rank.

    Both sides have interface_id, repo_id, method, path; calls also authority, service and base_property, routes authority and service. A base-URL property
    is looked up among services. The first of the tiers authority, service, property, method and path that has
    routes of other repositories is the only one used. A path that matches by its end needs an address.
    """
    calls = outbound.select(
        "interface_id",
        F.col("repo_id").alias("own_repo"),
        F.upper("method").alias("method"),
        url_path(F.col("path")).alias("path"),
        binding_authority(F.col("authority")).alias("authority"),
        F.lower("service").alias("service"),
        F.lower("base_property").alias("base_property"),
    )
    routes = inbound.select(F.col("interface_id").alias("target_id"), F.col("repo_id").alias("target_repo"), F.upper("method").alias("target_method"), url_path(F.col("path")).alias("target_path"), binding_authority(F.col("authority")).alias("t_authority"), F.lower("service").alias("t_service"))
    routes = routes.withColumn("lookup", F.explode(path_suffixes(F.col("target_path")))).withColumn("path_rank", F.when(F.col("lookup") == F.col("target_path"), 3).otherwise(2))
    method = F.coalesce(F.col("target_method") == F.col("method"), F.lit(False)) | F.coalesce(F.col("target_method") == "", F.lit(True))
    other = F.col("own_repo") != F.col("target_repo")
    found = None
    for tier, (name, keys) in enumerate({"authority": ("authority", "t_authority"), "service": ("service", "t_service"), "property": ("base_property", "t_service"), "none": None}.items(), 1):
        on = F.col("path") == F.col("lookup")
        if keys:
            on = on & (F.col(keys[0]) == F.col(keys[1]))
        hits = calls.join(routes, on & other & method)
        if not keys:
            hits = hits.where("path_rank = 3")
        hits = hits.groupBy("interface_id", "target_id").agg(F.max("path_rank").alias("path_rank")).select("interface_id", "target_id", F.lit(tier).alias("tier"), F.lit(_ADDRESS[name]).alias("address_rank"), "path_rank")
        found = hits if found is None else found.unionByName(hits)
        calls = calls.join(hits.select("interface_id").distinct(), "interface_id", "left_anti")  # later tiers are for what is left
    return found


def match(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """One row per call: matched to the only best route, ambiguous, or unresolved; with a confidence."""
    ranked = candidates(outbound, inbound).withColumn("r", F.rank().over(W.partitionBy("interface_id").orderBy(F.desc("address_rank"), F.desc("path_rank"))))
    top = ranked.where("r = 1").groupBy("interface_id").agg(F.count("*").alias("candidate_count"), F.min("target_id").alias("sole"), F.max("address_rank").alias("address_rank"), F.max("path_rank").alias("path_rank"))
    joined = outbound.select("interface_id", "repo_id").join(top, "interface_id", "left")
    n = F.coalesce("candidate_count", F.lit(0).cast("long"))
    status = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unresolved")
    confidence = F.when((n == 1) & (F.col("address_rank") >= 3) & (F.col("path_rank") == 3), "confirmed").when(n == 1, "probable").otherwise("unknown")
    return joined.select(stable_id("interaction", F.col("interface_id")).alias("interaction_id"), "interface_id", "repo_id", n.alias("candidate_count"), status.alias("status"), F.when(n == 1, F.col("sole")).alias("target_id"), confidence.alias("confidence"))


def repository_coverage(repositories: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts per repository and the ladder: no calls, all matched, or partial."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    per = matched.groupBy("repo_id").agg(F.count("*").alias("outbound"), count("matched"), count("ambiguous"), count("unresolved"))
    out = repositories.select("repo_id").distinct().join(per, "repo_id", "left").fillna(0, ["outbound", "matched", "ambiguous", "unresolved"])
    ladder = F.when(F.col("outbound") == 0, "not_applicable").when((F.col("matched") == F.col("outbound")) & (F.col("ambiguous") + F.col("unresolved") == 0), "complete").otherwise("partial")
    return out.withColumn("coverage_status", ladder)


def field_contracts(requests: DataFrame, members: DataFrame, matched: DataFrame) -> DataFrame:
    """Request fields of matched calls beside the members of their target, by normal path: matched, missing_in_target or missing_in_source."""
    from tracewright.functions.ids import correspondence_path

    pairs = matched.where("status = 'matched'").select("interaction_id", "interface_id", "target_id")
    left = pairs.join(requests, "interface_id").select("interaction_id", F.col("wire_path").alias("source_path"), correspondence_path(F.col("wire_path")).alias("k"))
    right = pairs.join(members.withColumnRenamed("interface_id", "target_id"), "target_id").select("interaction_id", F.col("wire_path").alias("target_path"), correspondence_path(F.col("wire_path")).alias("k"))
    status = F.when(F.col("source_path").isNull(), "missing_in_source").when(F.col("target_path").isNull(), "missing_in_target").otherwise("matched")
    return left.join(right, ["interaction_id", "k"], "full").select("interaction_id", F.col("k").alias("normal_path"), "source_path", "target_path", status.alias("status"))
