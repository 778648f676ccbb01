"""Time series of indicators, and the pressure they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import dates as D
from riskloom.functions import text as X
from riskloom.operators.rows import latest_by_key, running_sum
from riskloom.sources.shared import proven_small, settle

#: Members of the euro area.
EURO_AREA = ("AT", "BE", "HR", "CY", "EE", "FI", "FR", "DE", "GR", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PT", "SK", "SI", "ES")
#: What is said of each level.
SUMMARIES = {
    "high": "Euro area macro pressure is currently high. Current ECB indicators are elevated and recent trend signals point to continued pressure.",
    "elevated": "Euro area macro pressure is elevated. ECB indicators show increased financing and rate pressure compared with their historical range.",
    "moderate": "Euro area macro pressure is moderate. ECB indicators show some pressure, but not at elevated or high levels.",
    "low": "Euro area macro pressure is currently low based on the selected ECB indicators.",
}
#: Why the indicators apply to an entity, and what is said of those to which they don't fully.
REASONS = {
    "unknown": "Applicability unknown because the entity jurisdiction is missing or could not be mapped. ECB indicators are shown as general macroeconomic context.",
    "applicable": "Entity jurisdiction is part of the euro area. ECB indicators are relevant as regional macroeconomic context.",
    "reduced": "Reduced applicability because the entity jurisdiction is outside the euro area. ECB indicators are shown as broader macroeconomic context only.",
}
ENTITY_SUMMARIES = {
    "reduced": "ECB macro indicators are shown with reduced applicability for this entity because its jurisdiction is outside the euro area.",
    "unknown": "ECB macro indicators are shown as general context because applicability could not be determined.",
}
SERIES, GROUP = ["indicator_code", "ref_area", "series_key"], ["indicator_code", "ref_area"]


def _c(name: str) -> Column:
    return F.col(name)


def stage_observations(raw: DataFrame) -> DataFrame:
    """One cleaned row per dataset, series and period: the latest snapshot.

    The flow stands for the dataset where there is one; codes, keys and areas are in upper case; a series is named by its full key without
    the flow, else by its own; what a period means depends on the frequency.
    """
    name, upper = X.clean_text(_c("indicator_name")), lambda c: X.clean_text(_c(c), "upper")
    flow, frequency = F.coalesce(upper("dataflow"), upper("dataset_code")), F.coalesce(upper("freq"), upper("frequency"))
    area = X.effective_area(_c("ref_area"), flow)
    rows = raw.select(
        "raw_id", "source_load_date", flow.alias("dataset_code"), X.strip_series_prefix(X.clean_text(_c("ecb_key")), flow, upper("series_key")).alias("series_key"), name.alias("indicator_name"),
        X.indicator_slug(name).alias("indicator_code"), frequency.alias("frequency"), upper("unit").alias("unit"), area.alias("ref_area"), X.area_name(area).alias("reference_area_name"), X.clean_text(_c("time_period")).alias("time_period"),
        D.period_to_date(_c("time_period"), frequency).alias("obs_date"), D.guarded_decimal(_c("obs_value")).cast("double").alias("obs_value"),
    )
    return latest_by_key(rows, ["dataset_code", "series_key", "time_period"], [_c("source_load_date").desc_nulls_last(), _c("raw_id").desc_nulls_last()])


def _series() -> Window:
    return Window.partitionBy(*SERIES).orderBy(_c("obs_date").asc_nulls_last())


def series_lag(observations: DataFrame) -> DataFrame:
    """Each observation of a named indicator with the one before it in its series."""
    known = observations.where("obs_date is not null and obs_value is not null and indicator_name is not null")
    return known.withColumns({"previous_obs_value": F.lag("obs_value").over(_series()), "previous_obs_date": F.lag("obs_date").over(_series())})


def series_change(lagged: DataFrame) -> DataFrame:
    """Absolute change, and relative to the size of the value before (null where that is missing or 0)."""
    change = _c("obs_value") - _c("previous_obs_value")
    return lagged.withColumns({"change_abs": change, "change_pct": F.when(_c("previous_obs_value") != 0, change / F.abs("previous_obs_value"))})


def rolling_averages(ts: DataFrame) -> DataFrame:
    """Means of the last 3, 6 and 12 observations: they share one sort with the lag."""
    return ts.withColumns({f"rolling_avg_{n}_obs": F.avg("obs_value").over(_series().rowsBetween(1 - n, 0)) for n in (3, 6, 12)})


def series_rank_latest(ts: DataFrame) -> DataFrame:
    """Place from the newest observation of a series, and how many it has."""
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(_c("obs_date").desc_nulls_last()))
    ranked = ts.withColumns({"recency_rank": newest, "observation_count": F.count("*").over(Window.partitionBy(*SERIES))})
    return ranked.withColumn("is_latest_observation", _c("recency_rank") == 1)


def timeseries(observations: DataFrame) -> DataFrame:
    """Observations with all that is worked out along their series."""
    return series_rank_latest(rolling_averages(series_change(series_lag(observations))))


def _cume(ts: DataFrame, value: Column, out: str, spread: bool) -> DataFrame:
    """Cumulative share per value of a group, from counts of distinct values, so that few large groups sort only these."""
    counts = ts.groupBy(*GROUP, value.alias("_v")).agg(F.count("*").alias("_n"))
    if spread:
        whole = counts.groupBy(*[_c(g).alias(f"_all_{g}") for g in GROUP]).agg(F.sum("_n").alias("_all"))
        same = (_c("indicator_code") == _c("_all_indicator_code")) & _c("ref_area").eqNullSafe(_c("_all_ref_area"))
        return running_sum(counts, GROUP, ["_v"], _c("_n"), "_up").join(whole, same).select(*GROUP, "_v", (_c("_up") / _c("_all")).alias(out))
    whole = Window.partitionBy(*GROUP)
    return counts.select(*GROUP, "_v", (F.sum("_n").over(whole.orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(whole)).alias(out))


#: A group of an indicator and area with more rows than this, as counted, isn't sorted by one task where its values may be spread.
GROUP_ROWS = 1_000_000


def _measures() -> list[tuple[Column, str]]:
    return [(_c("obs_value"), "current_level_percentile"), (F.coalesce("change_abs", F.lit(0.0)), "momentum_percentile")]


def _by_windows(ts: DataFrame) -> DataFrame:
    """Both percentiles of groups that one task can sort: dealt by group once, and joined with nothing."""
    group = Window.partitionBy(*GROUP)
    share = lambda value: F.count("*").over(group.orderBy(value.asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)) / F.count("*").over(group)
    return ts.where("indicator_code is not null").withColumns({name: share(value) for value, name in _measures()}).where("obs_value is not null")


def level_momentum_percentile(ts: DataFrame, spread: bool = False, most: int | None = None) -> DataFrame:
    """Cumulative distribution of the value, and of its change (0 where there is none), per indicator and area.

    With ``spread`` no group of more than ``most`` rows (``GROUP_ROWS``), as counted, is sorted by one task: its different values are dealt in ranges
    and summed by prefixes, for groups of many millions of values; the other groups are windows.  Otherwise a group's different values are one window.
    """
    if not spread:
        return _by_values(ts, spread=False)
    large = proven_small(ts.groupBy(*GROUP).agg(F.count("*").alias("_n")).where(_c("_n") > (GROUP_ROWS if most is None else most)).select(*[_c(g).alias(f"_large_{g}") for g in GROUP]))
    if large.isEmpty():
        return _by_windows(ts)
    same = (_c("indicator_code") == _c("_large_indicator_code")) & _c("ref_area").eqNullSafe(_c("_large_ref_area"))
    return _by_windows(ts.join(large, same, "left_anti")).unionByName(_by_values(ts.join(large, same, "left_semi"), spread=True))


def _by_values(ts: DataFrame, spread: bool) -> DataFrame:
    """Both percentiles, worked out for different values and joined to the rows."""
    out = ts
    for value, name in _measures():
        shares = _cume(ts, value, name, spread).select(*[_c(g).alias(f"_{g}") for g in GROUP], "_v", name)
        on = (_c("indicator_code") == _c("_indicator_code")) & _c("ref_area").eqNullSafe(_c("_ref_area")) & (value == _c("_v"))
        out = out.join(shares, on).drop("_v", *[f"_{g}" for g in GROUP])
    return out


def trend_slope(ts: DataFrame, n: int = 12) -> DataFrame:
    """Slope of the value over epoch seconds in the last ``n`` observations of an indicator and area: by date, then series and value, as series of an area share dates."""
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(_c("obs_date").desc_nulls_last(), _c("series_key").asc_nulls_last(), _c("obs_value").asc_nulls_last()))
    last = ts.withColumn("_r", rank).where(_c("_r") <= n)
    seconds = F.unix_date("obs_date").cast("double") * 86400
    return last.groupBy(*GROUP).agg(F.regr_slope("obs_value", seconds).alias("raw_trend_slope"), F.count("*").alias("trend_observation_count"))


def indicator_pressure(scored: DataFrame, trends: DataFrame) -> DataFrame:
    """The latest observation of each weighted series with level, momentum, trend and pressure scores.

    Trends join by plain equality: without an area there is none.
    """
    latest = scored.where("is_latest_observation").withColumn("indicator_weight", X.indicator_weight(_c("indicator_code"))).where("indicator_weight > 0")
    out = latest.join(trends, GROUP, "left")
    slope = _c("raw_trend_slope")
    points = F.when(slope > 0, 75.0).when(slope < 0, 25.0).otherwise(50.0)
    direction = F.when(slope.isNull(), "unknown").when(slope > 0, "upward").when(slope < 0, "downward").otherwise("stable")
    level, momentum = _c("current_level_percentile"), _c("momentum_percentile")
    exact = F.lit(50.0) * level + F.lit(30.0) * momentum + F.lit(0.2) * points
    return out.select(
        X.md5_key(_c("indicator_code"), _c("ref_area"), _c("series_key"), null_slot=True).alias("pressure_indicator_id"), *SERIES, "indicator_name", _c("obs_date").alias("latest_obs_date"), _c("obs_value").alias("latest_obs_value"),
        F.round(level * 100, 2).alias("current_level_score"), F.round(momentum * 100, 2).alias("momentum_score"), direction.alias("trend_direction"), points.alias("trend_projection_score"),
        F.round(exact, 2).alias("indicator_pressure_score"), "indicator_weight", "trend_observation_count",
    )


def weighted_macro_score(indicators: DataFrame) -> DataFrame:
    """One row: the weighted pressure, and the weighted direction of trends."""
    sign = F.when(_c("trend_direction") == "upward", 1).when(_c("trend_direction") == "downward", -1).otherwise(0)
    total = F.nullif(F.sum("indicator_weight"), F.lit(0.0))
    return indicators.agg(
        F.round(F.sum(_c("indicator_pressure_score") * _c("indicator_weight")) / total, 2).alias("macro_pressure_score"), F.round(F.sum(sign * _c("indicator_weight")) / total, 4).alias("weighted_trend_signal")
    )


def macro_level(score: DataFrame) -> DataFrame:
    """Level, direction and sentence that follow from score and signal."""
    points, signal = _c("macro_pressure_score"), _c("weighted_trend_signal")
    level = F.when(points >= 75, "high").when(points >= 50, "elevated").when(points >= 25, "moderate").otherwise("low")
    trend = F.when(signal > 0.15, "upward").when(signal < -0.15, "downward").otherwise("stable")
    said = F.lit(SUMMARIES["low"])
    for name in ("moderate", "elevated", "high"):
        said = F.when(level == name, F.lit(SUMMARIES[name])).otherwise(said)
    return score.withColumns({"macro_pressure_level": level, "macro_trend_direction": trend, "macro_pressure_summary": said})


def pressure(observations: DataFrame) -> DataFrame:
    """Indicator rows, each with the one overall score."""
    ts = settle(timeseries(observations))  # read five times
    indicators = settle(indicator_pressure(level_momentum_percentile(ts), trend_slope(ts)))  # read for the rows and for the score
    return indicators.crossJoin(F.broadcast(_one_row(macro_level(weighted_macro_score(indicators)))))


def macro_summary(pressure_rows: DataFrame) -> DataFrame:
    """The overall score with the newest observation behind it."""
    keys = ["macro_pressure_score", "macro_pressure_level", "macro_trend_direction", "weighted_trend_signal", "macro_pressure_summary"]
    return pressure_rows.groupBy(*keys).agg(F.max("latest_obs_date").alias("latest_obs_date"))


def macro_applicability(entities: DataFrame) -> DataFrame:
    """How far the indicators apply to each entity, by its country, and why."""
    country = _c("country")
    kind = F.when(country.isNull() | (F.trim(country) == ""), "unknown").when(F.upper(country).isin(*EURO_AREA), "applicable").otherwise("reduced")
    weight, said = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, w in (("unknown", 0.30), ("applicable", 1.0), ("reduced", 0.35)):
        weight, said = F.when(kind == name, F.lit(w)).otherwise(weight), F.when(kind == name, F.lit(REASONS[name])).otherwise(said)
    return entities.select("entity_candidate_id", "lei", "legal_name", "legal_name_normalized", "country", _c("source_load_date").alias("entity_source_load_date"), F.coalesce(F.upper(country).isin(*EURO_AREA), F.lit(False)).alias("is_euro_area_country"), kind.alias("macro_context_applicability"), weight.alias("macro_applicability_weight"), said.alias("macro_context_applicability_reason"))


def _one_row(df: DataFrame) -> DataFrame:
    """A table that must have one row (or none): more are an error when it is read."""
    one = df.agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns])
    return one.where(F.when(_c("_n") > 1, F.raise_error(F.lit("one row was expected")).cast("boolean")).otherwise(_c("_n") == 1)).drop("_n")


def macro_context(entities: DataFrame, summary: DataFrame) -> DataFrame:
    """Every entity with the one overall score, and its own: that score times how far it applies to the entity.

    Without a summary no entity has a context; a summary of several rows is an error.
    """
    kind = _c("macro_context_applicability")
    out = macro_applicability(entities).crossJoin(F.broadcast(_one_row(summary)))
    score = F.round(_c("macro_pressure_score").cast("decimal(12,2)") * _c("macro_applicability_weight").cast("decimal(4,2)"), 2).cast("double")
    said = F.when(kind == "applicable", _c("macro_pressure_summary")).when(kind == "reduced", F.lit(ENTITY_SUMMARIES["reduced"])).otherwise(F.lit(ENTITY_SUMMARIES["unknown"]))
    return out.withColumns({
        "entity_macro_context_id": F.md5(F.concat(F.coalesce("entity_candidate_id", F.lit("")), F.lit("|ecb_macro_context"))),
        "entity_macro_context_score": score, "entity_macro_context_summary": said,
    })


def indicator_options(ts: DataFrame) -> DataFrame:
    """The indicators there are."""
    return ts.select("indicator_code", "indicator_name").distinct()


def filter_series(ts: DataFrame, indicator_code: str | None = None) -> DataFrame:
    """The observations of one indicator, or of all, in order."""
    chosen = ts if indicator_code is None else ts.where(_c("indicator_code") == indicator_code)
    return chosen.orderBy("indicator_code", "ref_area", "series_key", "obs_date")


def latest_observations(ts: DataFrame) -> DataFrame:
    """The newest observation of each series."""
    return ts.where("is_latest_observation")


def pressure_indicators(pressure_rows: DataFrame) -> DataFrame:
    """The indicators behind the score, heaviest first."""
    return pressure_rows.orderBy(_c("indicator_weight").desc(), "indicator_code", "ref_area")
