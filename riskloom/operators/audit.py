"""Job runs, health, freshness, manifests, and checks of landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import dates as D
from riskloom.operators.rows import latest_by_key

GOOD = ("success", "success_with_warnings")


def _c(name: str) -> Column:
    return F.col(name)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per job and target; runs without target are one group."""
    return latest_by_key(runs, ["job_name", "target_table"], [_c("started_at").desc_nulls_first(), _c("job_run_id").desc_nulls_first()])


def run_history(runs: DataFrame) -> DataFrame:
    """Counts of good and other runs per job and target, when the last of each ended (null where none has), and when the last began and ended."""
    good = _c("status").isin(*GOOD)
    return runs.groupBy("job_name", "target_table").agg(
        F.count("*").alias("total_run_count"), F.count_if(good).alias("success_run_count"), F.count_if(~good).alias("failed_or_incomplete_run_count"),
        F.max(F.when(good, _c("finished_at"))).alias("last_success_at"), F.max(F.when(~good, _c("finished_at"))).alias("last_failure_at"),
        F.max("started_at").alias("last_started_at"), F.max("finished_at").alias("last_finished_at"),
    )


def audit_history_join(latest: DataFrame, history: DataFrame) -> DataFrame:
    """The latest run with the history of its job and target, where a missing target equals a missing one."""
    h = history.select(_c("job_name").alias("_j"), _c("target_table").alias("_t"), *[c for c in history.columns if c not in ("job_name", "target_table")])
    return latest.join(h, (_c("job_name") == _c("_j")) & _c("target_table").eqNullSafe(_c("_t")), "left").drop("_j", "_t")


def pipeline_health(status: Column, last_success: Column) -> Column:
    """Healthy, or failed after a success, or never successful."""
    return F.when(status.isin(*GOOD), F.lit("healthy")).when(last_success.isNotNull(), F.lit("latest_failed_previous_success_available")).otherwise(F.lit("not_healthy"))


def audit_status(runs: DataFrame) -> DataFrame:
    """The latest run of each job and target with its history, duration and health."""
    joined = audit_history_join(latest_runs(runs), run_history(runs))
    good = _c("status").isin(*GOOD)
    return joined.select(
        "job_run_id", "job_name", "target_table", "status", "started_at", "finished_at", D.run_duration(_c("started_at"), _c("finished_at")).alias("duration_seconds"), "effective_load_date",
        F.coalesce("freshness_status", F.lit("unknown")).alias("freshness_status"), "snapshot_age_days", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_read", "rows_inserted")], "error_message",
        "total_run_count", "success_run_count", "failed_or_incomplete_run_count", "last_success_at", "last_failure_at", "last_started_at", "last_finished_at", _c("last_success_at").isNotNull().alias("has_successful_run"), good.alias("is_successful_latest_run"), (~good).alias("is_failed_or_incomplete_latest_run"),
        pipeline_health(_c("status"), _c("last_success_at")).alias("pipeline_health_status"),
    )


def _severity() -> Column:
    health = _c("pipeline_health_status")
    return F.when(health == "not_healthy", 1).when(health == "latest_failed_previous_success_available", 2).when(health == "healthy", 3).otherwise(4)


def worst_audit_per_table(audit: DataFrame) -> DataFrame:
    """The unhealthiest row of each target, then failed before not, then newest."""
    order = [_severity().asc(), _c("is_failed_or_incomplete_latest_run").desc_nulls_first(), _c("started_at").desc_nulls_last(), _c("job_run_id").desc_nulls_last()]
    return latest_by_key(audit, ["target_table"], order)


def expected_tables_status(expected: DataFrame, audit: DataFrame) -> DataFrame:
    """Every active expected table with its worst audit row, or missing_run."""
    wanted = ["target_table", "job_name", "status", "pipeline_health_status", "freshness_status", "total_run_count", "is_successful_latest_run", "is_failed_or_incomplete_latest_run"]
    out = expected.where("is_active").select("target_table", "display_name", "sort_order").join(worst_audit_per_table(audit).select(*wanted), "target_table", "left")
    fill = {"pipeline_health_status": "missing_run", "freshness_status": "unknown", "total_run_count": 0, "is_successful_latest_run": False, "is_failed_or_incomplete_latest_run": False}
    return out.withColumns({c: F.coalesce(_c(c), F.lit(v)) for c, v in fill.items()})


def pipeline_metrics(status: DataFrame) -> DataFrame:
    """One row: how many expected tables are in which state."""
    health = _c("pipeline_health_status")
    return status.agg(
        F.count("*").alias("monitored_tables"), F.coalesce(F.sum("total_run_count"), F.lit(0)).alias("total_runs"), F.count_if(health == "healthy").alias("healthy_tables"),
        F.count_if(health == "latest_failed_previous_success_available").alias("warning_tables"), F.count_if(health == "not_healthy").alias("not_healthy_tables"),
        F.count_if(health == "missing_run").alias("missing_run_tables"), F.count_if("is_failed_or_incomplete_latest_run").alias("tables_with_failed_latest_run"),
    )


def latest_loads(expected: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit rows of active expected tables, worst first."""
    out = audit.join(expected.where("is_active").select("target_table", "display_name", "sort_order"), "target_table")
    return out.orderBy(_severity(), _c("is_failed_or_incomplete_latest_run").desc(), _c("started_at").desc_nulls_last(), "sort_order", "job_name")


def inherited_freshness(model_sources: DataFrame, runs: DataFrame) -> DataFrame:
    """A model is as fresh as the newest successful runs of its sources, which are targets in comma-separated lists, as are a run's own.

    Any stale one makes it stale, else any unknown or missing one unknown; it is fresh only if all are.
    """
    split = lambda c: F.explode(F.split(F.trim(c), r"\s*,\s*")).alias("target_table")
    wanted = model_sources.select("model", split("targets")).where("target_table != ''").distinct()
    done = runs.where(_c("status").isin(*GOOD)).select(split("target_table"), "freshness_status", "snapshot_age_days", "finished_at", "started_at", "job_run_id")
    newest = latest_by_key(done, ["target_table"], [_c("finished_at").desc_nulls_last(), _c("started_at").desc_nulls_last(), _c("job_run_id").desc_nulls_first()])
    each = wanted.join(newest, "target_table", "left")
    said = F.coalesce("freshness_status", F.lit("unknown"))
    status = F.when(F.count_if(said == "stale") > 0, "stale").when(F.count_if(said != "fresh") > 0, "unknown").otherwise("fresh")
    return each.groupBy("model").agg(status.alias("freshness_status"), F.max("snapshot_age_days").alias("snapshot_age_days"), F.count("*").alias("source_count"))


def quality_summary(checks: DataFrame, by: str = "file_id") -> DataFrame:
    """Checks of each file: passed, failed with severity warning, and failed otherwise."""
    passed = F.coalesce(_c("status") == "passed", F.lit(False))
    warning = ~passed & F.coalesce(_c("severity") == "warning", F.lit(False))
    return checks.groupBy(by).agg(F.count_if(passed).alias("passed_count"), F.count_if(warning).alias("warning_count"), F.count_if(~passed & ~warning).alias("error_count"), F.count("*").alias("total_count"))


def manifest_status(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Per source and load date: files that failed and all others, warnings and errors of their quality summaries, bytes, and the status that follows.

    Failed files or errors leave a manifest with successes at success_with_warnings, others at failed; warnings alone at success_with_warnings.
    ``manifests`` (source, load_date) adds those without files, which are a success.
    """
    key = ["source", "load_date"]
    failed = F.coalesce(_c("status") == "failed", F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = files.groupBy(*key).agg(
        F.count("*").alias("file_count"), F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("failed_count"), total("warning_count").alias("warning_count"), total("error_count").alias("error_count"),
        total("downloaded_bytes").alias("downloaded_bytes"),
    )
    if manifests is not None:
        out = manifests.select(*key).distinct().join(out, key, "full").na.fill(0)
    bad = (_c("failed_count") > 0) | (_c("error_count") > 0)
    status = F.when(bad & (_c("success_count") > 0), "success_with_warnings").when(bad, "failed").when(_c("warning_count") > 0, "success_with_warnings").otherwise("success")
    return out.withColumn("manifest_status", status)


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The newest manifest per source that succeeded, with or without warnings."""
    return latest_by_key(manifests.where(_c("manifest_status").isin(*GOOD)), ["source"], [_c("load_date").desc_nulls_last()])


def stage_pages(pages: DataFrame) -> DataFrame:
    """One row per load date, candidate and object (missing parts count as empty)."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("source_load_date", "candidate_id", "source_object_key")]
    return latest_by_key(pages.select("*", *parts), ["_source_load_date", "_candidate_id", "_source_object_key"], [_c("raw_id").desc_nulls_last()]).drop("_source_load_date", "_candidate_id", "_source_object_key")


def page_quality_checks(pages: DataFrame, markers: list[str], min_bytes: int, key: str = "page_id", content: str = "content") -> DataFrame:
    """Pass or fail of each check of each page: size, markers, valid UTF-8. One scan."""
    body = _c(content)
    checks = [("min_size", F.octet_length(body) >= min_bytes), *[(f"marker:{m}", F.contains(body, F.lit(m))) for m in markers], ("utf8", F.is_valid_utf8(body))]
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed").alias("check_status")) for name, ok in checks])
    return pages.select(key, F.inline(rows))


def required_columns_check(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: whether the table has it, and in how many of its rows it holds a value (0 without the column)."""
    held = {c: F.count(F.nullif(F.trim(_c(c).cast("string")), F.lit(""))) if c in df.columns else F.lit(0).cast("long") for c in required}
    counted = df.agg(F.count("*").alias("_rows"), *[n.alias(f"_{i}") for i, n in enumerate(held.values())])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), _c(f"_{i}").alias("filled_rows"), _c("_rows").alias("all_rows")) for i, c in enumerate(required)]
    return counted.select(F.inline(F.array(*rows)))
