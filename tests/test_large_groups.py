"""Work that is dealt though it belongs to one group, files that are split, loads that can break off, checks while writing."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import macro as M
from riskloom.operators import rows as R
from riskloom.sources import files as I


def test_sums_along_one_hot_key(spark):
    """Nearly all rows are of one key, and are summed by several tasks; null keys are a key; the sums are those of one window."""
    rnd = random.Random(2)
    rows = [("hot", i, rnd.randrange(9)) for i in range(3000)] + [(k, i, 1) for k in ("a", None) for i in range(7)]
    rnd.shuffle(rows)
    out = R.running_sum(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], ["at"], F.col("v"), "up")
    want, sums = {}, {}
    for k, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[k, at] = sums[k] = sums.get(k, 0) + v
    assert {(r["k"], r["at"]): r["up"] for r in out.collect()} == want and out.columns == ["k", "at", "v", "up"]
    assert R.running_sum(spark.createDataFrame([], "k string, at int"), ["k"], ["at"], F.lit(1), "n").count() == 0


def test_a_large_object_is_numbered_by_many_tasks(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("line"), F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("object"))
    out = I.with_lineage(rows, F.concat(F.lit("files/"), "object"), F.lit("2024-05-01"), ["line"])
    got = {}
    for r in out.collect():
        got.setdefault(r["source_object_key"], []).append((r["line"], r["row_number"]))
    assert set(got) == {"files/small", "files/large"}
    assert all([n for _, n in sorted(of)] == list(range(1, len(of) + 1)) for of in got.values())


def test_cumulative_shares_of_one_group(spark):
    """One indicator and area with thousands of values: the same shares as by a window."""
    rnd = random.Random(3)
    rows = [("i", "A", rnd.randrange(900) / 4, rnd.choice([None, 1.0, -2.5])) for _ in range(3000)] + [("k", None, 1.0, None), ("k", None, 2.0, 1.0)]
    ts = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, indicator_code string, ref_area string, obs_value double, change_abs double")
    plain, spread = ({r["n"]: (round(r["current_level_percentile"], 9), round(r["momentum_percentile"], 9)) for r in M.level_momentum_percentile(ts, s).collect()} for s in (False, True))
    assert plain == spread and len(plain) == len(rows)
    values = sorted(v for i, _, v, _ in rows if i == "i")
    assert plain[0][0] == round(sum(v <= rows[0][2] for v in values) / len(values), 9)


def test_csv_is_split_unless_values_hold_line_breaks(spark, tmp_path):
    schema = "id string, name string"
    (tmp_path / "plain").mkdir()
    body = "".join(f'{i};"name ""{i}"" of; many"\n' for i in range(40_000))
    (tmp_path / "plain" / "x.csv").write_bytes(b"\xef\xbb\xbfid;name\n" + body.encode() + b"bad;\xff\xfe\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = I.read_csv_snapshot(spark, str(tmp_path / "plain"), schema, ";")
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 40_001
        assert rows.where("id = '7'").first()["name"] == 'name "7" of; many' and rows.where("id = 'bad'").first()["name"] == "\ufffd\ufffd"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "broken" / "load_date=2024-05-01").mkdir(parents=True)
    (tmp_path / "broken" / "load_date=2024-05-01" / "x.csv").write_text('id,name\n1,"two\nlines"\n2,b\n')
    got = I.read_csv_snapshot(spark, str(tmp_path / "broken"), schema).orderBy("id").collect()
    assert [(r["id"], r["name"], str(r["load_date"])) for r in got] == [("1", "two\nlines", "2024-05-01"), ("2", "b", "2024-05-01")]
    (tmp_path / "odd.csv").write_text("id,n\n1,5\n2,x\n3,6,7\n")
    got = I.read_csv_snapshot(spark, str(tmp_path / "odd.csv"), "id int, n int", broken=True).orderBy("id").collect()
    assert [(r["id"], r["n"], r[I.BROKEN]) for r in got] == [(1, 5, None), (2, None, "2,x"), (3, 6, "3,6,7")]


def test_loads_replace_objects_and_may_break_off(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *of: spark.createDataFrame(list(of), "source_object_key string, v int")
    table = lambda: sorted((r["source_object_key"], r["v"]) for r in spark.read.parquet(path).collect())
    I.load_objects(rows(("a", 1), ("a", 2), ("b", 3)), path)
    I.load_objects(rows(("b", 4), ("c", 5)), path)
    want = [("a", 1), ("a", 2), ("b", 4), ("c", 5)]
    assert table() == want
    I.load_objects(rows(("b", 4), ("c", 5)), path)
    assert table() == want
    with pytest.raises(Exception, match="broke off"):
        I.load_objects(rows(("a", 9), ("d", 9)).repartition(2).withColumn("v", F.when(F.col("source_object_key") == "d", F.raise_error(F.lit("broke off"))).otherwise(F.col("v"))), path)
    assert table() == want


def test_checks_while_writing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "k string, v int")
    counted = I.write_mart(df, str(tmp_path / "mart"), not_null=["k", "v"], accepted={"k": ["a"]})
    assert counted == {"rows": 3, "null_k": 1, "null_v": 1, "unexpected_k": 1}
    assert {f"null_{c}": n for c, n in zip(("k", "v"), R.check_not_null(df, ["k", "v"]).first(), strict=True)} == {"null_k": 1, "null_v": 1}
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 3
