"""Decision ladders over facts; the order of the rules is part of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of relations that a reader of business sources doesn't want to see.
HIDDEN = ("internal_intermediate", "external_or_shared_intermediate")


def relation_role(kind: Column, named: Column, writes: Column, reads: Column, drops: Column, technical: Column, owned: Column) -> Column:
    """struct(role, confidence) from a relation's kind, use, name and namespace."""
    of = lambda role, confidence: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))
    return (
        F.when(kind.isin("cte", "derived", "generated", "temporary"), of("internal_intermediate", "confirmed"))
        .when(~kind.isin("physical", "physical_template") | ~named, of("unknown", "unresolved"))
        .when((writes > 0) & ((reads > 0) | (drops > 0)), of("internal_intermediate", "confirmed"))
        .when(writes > 0, of("output_target", "confirmed"))
        .when(technical & owned & (reads > 0), of("internal_intermediate", "probable"))
        .when(technical & owned, of("external_or_shared_intermediate", "probable"))
        .otherwise(of("external_source", "confirmed"))
    )


def join_readiness(exact: Column, targets: Column, keys: Column, single: Column, derivations: Column) -> Column:
    """struct(status, readiness) of a storage join from counts of signatures, targets, key expressions and derivations."""
    of = lambda status, readiness: F.struct(F.lit(status).alias("status"), F.lit(readiness).alias("readiness"))
    return (
        F.when(exact == 1, of("strongly_supported", "executable_storage_join"))
        .when(exact > 1, of("ambiguous", "ambiguous"))
        .when((targets > 1) | (keys > 1), of("ambiguous", "ambiguous"))
        .when((targets == 1) & (keys == 1) & single, of("strongly_supported", "executable_storage_join"))
        .when((targets == 1) & (keys == 1), of("strongly_supported", "transformation_required"))
        .when((derivations > 0) & (targets > 0), of("strongly_supported", "requires_validation"))
        .otherwise(of("unresolved", "not_ready"))
    )


def extension_join(polymorphic: Column, embedded_key: Column, correspondences: Column, single: Column, derivations: Column, targets: Column) -> Column:
    """struct(method, confidence, readiness): how an attribute of a related entity is reached; the first rule that holds wins."""
    of = lambda method, confidence, readiness: F.struct(F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(readiness).alias("readiness"))
    return (
        F.when(polymorphic, of("resolve_reference_collection", "confirmed", "unresolved_requires_subtype_or_representation"))
        .when(embedded_key, of("derive_source_identity_from_target_key", "confirmed", "transformation_required"))
        .when(correspondences > 0, of("resolve_reference_value_to_target_key", "confirmed", "transformation_required"))
        .when(single, of("equals", "confirmed", "direct_candidate_requires_physical_representation_check"))
        .when((derivations > 0) & (targets > 0), of("resolve_reference_value_to_target_key", "strongly_supported", "transformation_required"))
        .otherwise(of("not_established", "unresolved", "unresolved"))
    )


def usefulness(method: Column, confidence: Column, polymorphic: Column, exact_sql: Column, many: Column, storage_fields: Column) -> Column:
    """What a consumer may do with an extension join: unresolved, ambiguity, confirmed, strongly_supported or probable."""
    sure = confidence == "confirmed"
    supported = F.when(confidence.isin("confirmed", "strongly_supported"), "probable").otherwise("unresolved")
    return (
        F.when(method == "not_established", "unresolved")
        .when(polymorphic | (method == "resolve_reference_collection"), "ambiguity")
        .when(exact_sql, "confirmed")
        .when((method == "derive_source_identity_from_target_key") & many, F.when(sure, "strongly_supported").otherwise("probable"))
        .when(method == "resolve_reference_value_to_target_key", F.when(sure & (storage_fields > 0), "strongly_supported").otherwise(supported))
        .when(method == "equals", F.when(sure, "probable").otherwise("unresolved"))
        .otherwise(supported)
    )


def value_preservation(transformation: Column) -> Column:
    return (
        F.when(transformation.isin("identity", "extracted"), "preserved")
        .when(transformation.isin("normalized", "formatted", "combined"), "partially_preserved")
        .when(transformation.isin("hashed", "derived"), "transformed")
        .otherwise("unknown")
    )


def confidence_views(df: DataFrame, confidence: str) -> dict[str, DataFrame]:
    """strict: confirmed; working: confirmed and derived; exploratory: all but rejected."""
    c = F.lower(confidence)
    return {"strict": df.where(c == "confirmed"), "working": df.where(c.isin("confirmed", "derived")), "exploratory": df.where(F.coalesce(c != "rejected", F.lit(True)))}


def business_view(df: DataFrame, role: str = "role") -> DataFrame:
    return df.where(~F.coalesce(F.col(role).isin(*HIDDEN), F.lit(False)))
