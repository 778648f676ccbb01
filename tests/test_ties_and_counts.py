"""Results that don't hang on the order of rows, and counts per name."""

import datetime

from riskloom.operators import macro as M
from riskloom.plans.catalog import QUERIES, Inputs

SF = "/root/testdata/sf0.001"


def test_slopes_of_series_that_share_dates(spark):
    """Two series of an area have the same twenty days, so that the twelfth row is one of two: always that of the first series."""
    rows = [("i", "U2", s, datetime.date(2024, 1, d), float(d * d if s == "a" else 100 - d)) for d in range(1, 21) for s in ("a", "b")]
    rows += [("i", "ODD", "a", datetime.date(2024, 1, d), float(d)) for d in range(1, 12)] + [("i", "ODD", s, datetime.date(2023, 1, 1), v) for s, v in (("b", 1.0), ("a", 5.0), ("a", 9.0))]
    of = lambda rows: {r["ref_area"]: (r["raw_trend_slope"], r["trend_observation_count"]) for r in M.trend_slope(spark.createDataFrame(rows, "indicator_code string, ref_area string, series_key string, obs_date date, obs_value double").coalesce(1)).collect()}
    got, turned = of(rows), of(rows[::-1])
    for area in ("U2", "ODD"):
        last = sorted((r for r in rows if r[1] == area), key=lambda r: (-r[3].toordinal(), r[2], r[4]))[:12]
        x, y = [r[3].toordinal() * 86400 for r in last], [r[4] for r in last]
        want = sum((a - sum(x) / 12) * (b - sum(y) / 12) for a, b in zip(x, y, strict=True)) / sum((a - sum(x) / 12) ** 2 for a in x)
        assert all(abs(g[area][0] * 1e9 - want * 1e9) < 1e-3 and g[area][1] == 12 for g in (got, turned))


def test_counts_per_name(spark):
    """Each name of a subject with its different addresses, birth dates, identifications and citizenships."""
    rows = Inputs(spark, SF).fsf.where("name_normalized is not null").collect()
    want = {}
    for r in rows:
        sets = want.setdefault((r["subject_key"], r["name_key"]), [set() for _ in range(4)])
        for s, c in zip(sets, ("address", "birth_date", "identification", "citizenship"), strict=True):
            s.update({r[f"{c}_logical_id"]} - {None})
    got = {(r["subject_key"], r["name_key"]): [r["name_count"], r["address_count"], r["birth_date_count"], r["identification_count"], r["citizenship_count"]] for r in QUERIES["fsf_name_rollup"](spark, SF).collect()}
    assert got == {k: [1, *map(len, sets)] for k, sets in want.items()} and any(n > 1 for v in got.values() for n in v[1:])


def test_wide_rows_are_compiled(spark):
    """Rows of 45 parsed columns are not one generated method beyond what the JVM compiles; a lower setting stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for said, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, said)
            QUERIES["extract_json_row"](spark, SF)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
