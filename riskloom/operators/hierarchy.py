"""Ownership: one parent per entity, edges, chains of ancestors, and what they say about an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import dates as D
from riskloom.functions import text as X
from riskloom.operators.rows import latest_by_key, require_keys
from riskloom.sources.shared import SMALL_ROWS, settle

DIRECT, ULTIMATE = "IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY"


def _c(name: str) -> Column:
    return F.col(name)


def _latest(last: str) -> list[Column]:
    """The newest load (one without date counts as newest), then the latest start, update and key."""
    return [_c("source_load_date").desc_nulls_first(), *[_c(c).desc_nulls_last() for c in ("relationship_period_start", "last_update_date", last)]]


def stage_relationships(raw: DataFrame) -> DataFrame:
    """One cleaned row per child, parent and type."""
    rows = require_keys(raw, ["start_node_id", "end_node_id", "relationship_type"]).select(
        "raw_id", "source_load_date", *[X.clean_text(_c(c), "upper").alias(c) for c in ("start_node_id", "end_node_id", "relationship_type")],
        F.coalesce(X.clean_text(_c("relationship_status"), "lower"), F.lit("unknown")).alias("relationship_status"), X.normalize_status(_c("registration_status")).alias("registration_status"),
        D.iso_date_prefix(_c("relationship_period_start_raw")).alias("relationship_period_start"), D.iso_date_prefix(_c("last_update_date_raw")).alias("last_update_date"),
    )
    rows = rows.withColumn("relationship_key", X.md5_key(_c("start_node_id"), _c("end_node_id"), _c("relationship_type"), null_slot=True))
    return latest_by_key(rows, ["relationship_key"], _latest("raw_id"))


def active_relationships(rr: DataFrame, relationship_type: str) -> DataFrame:
    """Relations of a type that are active or unknown and not withdrawn."""
    status, registration = _c("relationship_status"), _c("registration_status")
    return rr.where(
        (_c("relationship_type") == relationship_type) & (status.isNull() | status.isin("active", "unknown")) & (registration.isNull() | ~registration.isin("annulled", "rejected", "retired"))
    )


def pick_parent(rr: DataFrame, relationship_type: str) -> DataFrame:
    """At most one parent of a type per child."""
    return latest_by_key(active_relationships(rr, relationship_type), ["start_node_id"], _latest("relationship_key")).select(_c("start_node_id").alias("lei"), _c("end_node_id").alias("parent_lei"))


def parent_summary(lei: DataFrame, rr: DataFrame) -> DataFrame:
    """Every entity with its direct and ultimate parent, and their names where they are entities."""
    out = lei.select("lei")
    for kind, relationship_type in (("direct", DIRECT), ("ultimate", ULTIMATE)):
        out = out.join(pick_parent(rr, relationship_type).withColumnRenamed("parent_lei", f"{kind}_parent_lei"), "lei", "left")
        names = lei.select(_c("lei").alias(f"{kind}_parent_lei"), _c("legal_name").alias(f"{kind}_parent_name"))
        out = out.join(names, f"{kind}_parent_lei", "left")
    has = {f"has_{k}_parent": _c(f"{k}_parent_lei").isNotNull() for k in ("direct", "ultimate")}
    return out.withColumns(has).withColumn("has_any_parent", _c("has_direct_parent") | _c("has_ultimate_parent"))


def entity_master(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Every entity with its parents; without any the flags are false."""
    out = candidates.join(parents, "lei", "left")
    return out.withColumns({f"has_{k}_parent": F.coalesce(_c(f"has_{k}_parent"), F.lit(False)) for k in ("direct", "ultimate", "any")})


def relationship_edges(master: DataFrame) -> DataFrame:
    """Direct and ultimate edges from one scan; an ultimate edge to the entity itself is left out."""
    direct, ultimate = _c("direct_parent_lei"), _c("ultimate_parent_lei")
    depth = F.when(direct.isNotNull() & ultimate.isNotNull() & (direct != ultimate), 2).otherwise(1)
    edge = lambda kind, lei, name, d: F.struct(F.lit(kind).alias("relationship_type"), lei.alias("parent_lei"), name.alias("parent_name"), d.alias("relationship_depth"))
    both = F.array(edge("direct_parent", direct, _c("direct_parent_name"), F.lit(1)), edge("ultimate_parent", ultimate, _c("ultimate_parent_name"), depth))
    rows = master.select(_c("entity_candidate_id").alias("child_entity_candidate_id"), _c("lei").alias("child_lei"), _c("legal_name").alias("child_legal_name"), _c("legal_name_normalized").alias("child_legal_name_normalized"), _c("country").alias("child_country"), "source_load_date", F.inline(both))
    rows = rows.where(_c("parent_lei").isNotNull() & ((_c("relationship_type") == "direct_parent") | ~_c("parent_lei").eqNullSafe(_c("child_lei"))))
    return rows.withColumn("relationship_edge_id", X.md5_key(_c("child_lei"), _c("relationship_type"), _c("parent_lei"), null_slot=True))


def ancestors(master: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, way): each entity that has a parent, and its ancestors in order, ``max_depth`` at most, by doubling.

    Ways of 1, 2, 4, 8 steps are joined with the ways of their last nodes, so the joins grow with the logarithm of the depth.  The map is broadcast
    if it is proven small; beyond that adaptive execution splits a common ancestor's rows.  Ways may run around a cycle.
    """
    reach = master.where("direct_parent_lei is not null").select(_c("lei").alias("node"), F.array("direct_parent_lei").alias("way"))
    few, steps = reach.count() <= SMALL_ROWS, 1
    while steps < max_depth:
        more = reach.select(_c("node").alias("_end"), _c("way").alias("_more"))
        met = reach.join(F.broadcast(more) if few else more, F.element_at("way", -1) == _c("_end"), "left")
        reach = met.select("node", F.slice(F.concat("way", F.coalesce("_more", F.array().cast("array<string>"))), 1, max_depth).alias("way"))
        steps *= 2
        reach = settle(reach) if steps < max_depth else reach
    return reach


def parent_paths(master: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every ancestor of every entity up to ``max_depth`` steps: one row each, with the way as text.

    A way ends at an unknown parent, at itself, or where it would return to a node it has passed: as each node has one parent, what follows the
    first return holds nothing new, so the different nodes of a way are the way up to there.  ``master`` should be a written table.
    """
    known = master.where("direct_parent_lei is not null")
    roots = known.select(
        _c("lei").alias("node"), "entity_candidate_id", _c("legal_name").alias("root_legal_name"), _c("legal_name_normalized").alias("root_legal_name_normalized"), _c("country").alias("root_country"), "source_load_date",
    )
    ways = ancestors(master, max_depth).select("node", F.array_distinct(F.concat(F.array("node"), "way")).alias("way"))
    each = ways.where("size(way) > 1").withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("way") - 1)))
    steps = each.select(
        "node", "depth", F.get("way", _c("depth") - 1).alias("_below"), F.get("way", _c("depth")).alias("ancestor_lei"), F.array_join(F.slice("way", F.lit(1), _c("depth") + 1), " > ").alias("path"),
        (_c("depth") == F.size("way") - 1).alias("is_furthest_ancestor"),
    )
    names = known.select(_c("lei").alias("_below"), _c("direct_parent_name").alias("ancestor_name"))
    path_id = F.md5(F.concat(F.coalesce("node", F.lit("")), F.lit("|path|"), F.coalesce("ancestor_lei", F.lit("")), F.lit("|"), _c("depth").cast("string")))
    return steps.join(names, "_below").join(roots, "node").select(
        path_id.alias("relationship_path_id"), "entity_candidate_id", _c("node").alias("root_lei"), "root_legal_name", "root_legal_name_normalized", "root_country", "ancestor_lei", "ancestor_name", "depth",
        "path", "is_furthest_ancestor", "source_load_date",
    )


def child_counts(edges: DataFrame) -> DataFrame:
    """Direct children per parent."""
    return edges.where("relationship_type = 'direct_parent'").groupBy("parent_lei").agg(F.count_distinct("child_lei").alias("known_child_count"))


def descendant_counts(paths: DataFrame) -> DataFrame:
    """A root comes once per ancestor, so a plain count is distinct, and adds up before the shuffle."""
    return paths.groupBy(_c("ancestor_lei").alias("parent_lei")).agg(F.count("*").alias("total_descendant_count"))


def sibling_group_size(master: DataFrame) -> DataFrame:
    """Entities per direct parent."""
    return master.where("direct_parent_lei is not null").groupBy("direct_parent_lei").agg(F.count("*").alias("same_parent_group_size"))


def path_summary(paths: DataFrame) -> DataFrame:
    """How far up an entity's chain goes, and where it ends."""
    far = lambda c: F.max(F.when(_c("is_furthest_ancestor"), _c(c)))
    return paths.groupBy("entity_candidate_id").agg(
        F.max("depth").alias("parent_chain_depth"), F.count("*").alias("parent_path_count"), far("ancestor_lei").alias("furthest_known_ancestor_lei"), far("ancestor_name").alias("furthest_known_ancestor_name")
    )


def relationship_context(master: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Every entity with its children, descendants, siblings and chain, and a sentence about them."""
    out = master.join(child_counts(edges).withColumnRenamed("parent_lei", "lei"), "lei", "left").join(descendant_counts(paths).withColumnRenamed("parent_lei", "lei"), "lei", "left")
    out = out.join(sibling_group_size(master), "direct_parent_lei", "left").join(path_summary(paths), "entity_candidate_id", "left")
    zero = {c: F.coalesce(_c(c), F.lit(0)) for c in ("known_child_count", "total_descendant_count", "parent_chain_depth", "parent_path_count")}
    out = out.withColumns(zero)
    any_parent, below = _c("has_any_parent"), _c("total_descendant_count") > 0
    said = (
        F.when(~any_parent & ~below, F.lit("No known parent or child relationships.")).when(any_parent & ~below, F.lit("Entity has known parent relationship context."))
        .when(~any_parent & below, F.lit("Entity has known child or descendant entities but no known parent.")).otherwise(F.lit("Entity has both parent and child or descendant relationship context."))
    )
    same = F.when(_c("direct_parent_lei").isNull(), F.lit(0)).otherwise(F.greatest(F.coalesce("same_parent_group_size", F.lit(0)) - 1, F.lit(0)))
    return out.select(
        "entity_candidate_id", "lei", "country", "direct_parent_lei", "ultimate_parent_lei", "has_any_parent", *zero, same.cast("long").alias("same_parent_entity_count"), "furthest_known_ancestor_lei",
        (_c("known_child_count") > 0).alias("has_known_children"), said.alias("relationship_context_summary"),
    )


def descendants_of(paths: DataFrame, master: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The descendants of the given ancestors (column ``ancestor_lei``), direct or indirect."""
    known = master.select(_c("lei").alias("root_lei"), "legal_name", "country")
    kind = F.when(_c("depth") == 1, F.lit("direct_child")).otherwise(F.lit("indirect_descendant"))
    return paths.join(ancestors, "ancestor_lei").join(known, "root_lei").select("ancestor_lei", "root_lei", "legal_name", "country", "depth", kind.alias("relation"))


def same_parent_entities(master: DataFrame) -> DataFrame:
    """Who has which siblings, as membership: each entity with its direct parent and how many others have the same one.

    Two entities are siblings exactly if they share ``direct_parent_lei``; no pair is written out, however large a parent is.
    """
    group = sibling_group_size(master)
    known = master.where("direct_parent_lei is not null").select("direct_parent_lei", "entity_candidate_id", "lei", "legal_name", "country")
    return known.join(group, "direct_parent_lei").withColumn("sibling_count", _c("same_parent_group_size") - 1)


def siblings_of(master: DataFrame, entities: DataFrame) -> DataFrame:
    """The siblings of the entities asked for (column ``lei``)."""
    asked = master.join(entities.select("lei").distinct(), "lei", "left_semi").where("direct_parent_lei is not null").select(_c("lei").alias("asked_lei"), "direct_parent_lei")
    others = master.select("direct_parent_lei", _c("lei").alias("sibling_lei"), _c("legal_name").alias("sibling_name"), _c("country").alias("sibling_country"))
    return asked.join(others, "direct_parent_lei").where("asked_lei != sibling_lei")
