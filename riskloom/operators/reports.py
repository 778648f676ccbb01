"""What is read from the marts: overviews, top lists, searches and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


TIER_COUNTS = ("total_sanctions_match_count", "high_confidence_match_count", "medium_confidence_match_count", "review_required_match_count")
TIERS = ("high", "medium", "review", "low_or_no_known_match")


def risk_overview(risk: DataFrame) -> DataFrame:
    """One row: entities per tier and matches in all."""
    return risk.agg(F.count("*").alias("total_entities"), *[F.count_if(_c("risk_tier") == t).alias(f"{t}_count") for t in TIERS], F.coalesce(F.sum("total_sanctions_match_count"), F.lit(0)).alias("total_matches"))


def risk_tier_distribution(risk: DataFrame) -> DataFrame:
    """Entities per tier, worst first."""
    order = F.element_at(F.map_from_arrays(F.array(*map(F.lit, TIERS)), F.array(*map(F.lit, range(1, 5)))), _c("risk_tier"))
    return risk.groupBy("risk_tier").agg(F.count("*").alias("entity_count")).withColumn("tier_order", order).orderBy("tier_order")


def in_order_of_risk(rows: DataFrame) -> DataFrame:
    """The highest score first, then most matches, name and lei."""
    return rows.orderBy(_c("risk_score").desc(), _c("total_sanctions_match_count").desc(), _c("legal_name_normalized").asc_nulls_last(), "lei")


def top_risk_entities(risk: DataFrame, k: int = 25, lists: bool = True) -> DataFrame:
    """The matched entities of highest score; each task keeps k, nothing is sorted whole. Without ``lists`` they come with their ids instead of their subjects, to be attached to the few that are kept."""
    shown = ["lei", "legal_name_normalized", "country", "entity_status", "registration_status", "risk_score", "risk_tier", *TIER_COUNTS, "source_entity_keys" if lists else "entity_candidate_id"]
    return in_order_of_risk(risk.where("risk_tier != 'low_or_no_known_match'").select(*shown)).limit(k)


def search_entities(master: DataFrame, risk: DataFrame, term: str, k: int = 50) -> DataFrame:
    """Entities whose lei or name holds the term in any case; hits at the beginning come first. Terms under 2 characters find nothing."""
    said = term.strip().lower()
    like = lambda c: F.contains(F.lower(c), F.lit(said))
    starts = lambda c: F.startswith(F.lower(c), F.lit(said))
    rank = F.when(starts(_c("lei")), 1).when(starts(_c("legal_name_normalized")), 2).when(starts(_c("legal_name")), 3).otherwise(4)
    hits = master.where(F.lit(len(said) >= 2) & (like(_c("lei")) | like(_c("legal_name")) | like(_c("legal_name_normalized"))))
    shown = ["entity_candidate_id", "lei", "legal_name_normalized", "country", "entity_status", "registration_status", "legal_jurisdiction"]
    out = hits.select(*shown, rank.alias("hit_rank")).join(risk.select("entity_candidate_id", "risk_score", "risk_tier", *TIER_COUNTS), "entity_candidate_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("low_or_no_known_match" if c == "risk_tier" else 0)) for c in ("risk_score", "risk_tier", *TIER_COUNTS)})
    return out.orderBy("hit_rank", _c("risk_score").desc(), _c("total_sanctions_match_count").desc(), _c("legal_name_normalized").asc_nulls_last(), "lei").limit(k)


def entity_profile(master: DataFrame, risk: DataFrame) -> DataFrame:
    """Every entity with its score, and what stands for no match."""
    wanted = risk.select("entity_candidate_id", "risk_score", "risk_tier", "total_sanctions_match_count")
    out = master.select("entity_candidate_id", "lei", "legal_name", "country", "has_any_parent").join(wanted, "entity_candidate_id", "left")
    fill = {"risk_score": 0, "risk_tier": "low_or_no_known_match", "total_sanctions_match_count": 0}
    return out.withColumns({c: F.coalesce(_c(c), F.lit(v)) for c, v in fill.items()})


def entity_matches_ranked(screening: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """All matches with their place within the entity: best rank, then score, source, name. ``within`` are columns by which the rows are dealt, if an entity has one value of them."""
    order = [_c("match_quality_rank").asc(), _c("match_quality_score").desc(), _c("sanctions_source").asc(), _c("sanctions_name").asc_nulls_last(), _c("entity_sanctions_match_id").asc()]
    place = F.row_number().over(Window.partitionBy(*within, "entity_candidate_id").orderBy(*order))
    return screening.select("entity_candidate_id", "entity_sanctions_match_id", "sanctions_source", "sanctions_name", "match_quality_score", "match_quality_rank", place.alias("match_place"))
