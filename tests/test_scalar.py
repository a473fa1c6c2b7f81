from datetime import date, datetime

from pyspark.sql import functions as F

from keyfold.functions import scalar as S


def test_calendar_edges(spark):
    days = [date(2016, 1, 1), date(2017, 1, 1), date(2017, 12, 31), date(2017, 1, 7), date(2017, 1, 8)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: (r["month"], r["week"], r["dayofweek"], r["day"]) for r in
           df.select("d", *S.calendar_parts("d")).collect()}
    for d in days:
        assert got[d] == (d.month, int(d.strftime("%U")), (d.weekday() + 1) % 7 + 1, d.day)
    assert got[date(2017, 12, 31)][1] == 53 and got[date(2016, 1, 1)][1] == 0


def test_day_differences(spark):
    df = spark.createDataFrame([(datetime(2017, 3, 14, 23), datetime(2017, 3, 15, 1))], "a timestamp, b timestamp")
    r = df.select(S.whole_days_between("a", "b").alias("whole"),
                  S.days_since(F.col("b").cast("date"), date(2017, 3, 15)).alias("since"),
                  S.days_since(F.col("a").cast("date"), date(2017, 3, 15)).alias("before")).first()
    assert (r["whole"], r["since"], r["before"]) == (0, 0, -1)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.4,), (1.7,), (None,)], "x double")
    assert [r[0] for r in df.select(S.clip_unit("x")).collect()] == [0.0, 0.0, 0.4, 1.0, None]


def test_log_buckets_are_exact_on_powers(spark):
    df = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("e"))
    twos = df.select("e", S.log2_bucket(F.pow(F.lit(2.0), "e") - 1).alias("b")).collect()
    assert all(r["e"] == r["b"] for r in twos)
    tens = df.filter("e <= 15").select("e", S.log10_bucket(F.pow(F.lit(10.0), "e") - 1).alias("b")).collect()
    assert all(r["e"] == r["b"] for r in tens)
