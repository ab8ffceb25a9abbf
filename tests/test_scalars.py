from pyspark.sql import functions as F

from gridlens.functions import labels, ratios, times


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_probe_time_forms(spark):
    forms = [
        "20170201T000000+0000", "2017-02-01T00:00:00", "20170201T000000Z", "2017-02-01T00:00:00+00:00",
        "2017-02-01T00:00:00Z", "not a time", None,
    ]
    assert column(spark, forms, "string", times.parse_probe_time) == [1485907200] * 5 + [None, None]


def test_day_label_and_start(spark):
    assert column(spark, [1485907200 + 86399], "bigint", times.day_label) == ["01-February-2017"]
    assert column(spark, [1485907200 + 86399], "bigint", times.day_start) == [1485907200]
    assert times.to_epoch("2017-02-01T00:00:00") == 1485907200


def test_slot_trim_by_number_of_ats(spark):
    hosts = ["node", "slot1@node", "slot1@glide@node", "a@b@c@d", None]
    assert column(spark, hosts, "string", labels.slot_trim) == ["node", "node", "node", "c@d", None]
    assert column(spark, [None, "x@y@z"], "string", labels.host_default) == ["Unknown", "z"]


def test_bucket_label(spark):
    assert column(spark, [0.5, 50.0, 149.9], "double", labels.bucket_label) == [
        "0 to 50", "50 to 100", "100 to 150",
    ]


def test_lumosity_is_zero_without_events(spark):
    rows = spark.createDataFrame([(2.0, 4.0), (2.0, 0.0)], "w double, k double")
    got = rows.select(
        ratios.lumosity(F.col("w"), F.col("k")), ratios.mean_lumos(F.col("w"), F.col("k"))
    ).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (0.0, None)]


def test_zero_fill_needs_one_side(spark):
    rows = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None)], "a double, b double")
    got = rows.select(*ratios.zero_fill_pair(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 2.0), (None, None)]


def test_titles(spark):
    row = spark.createDataFrame([("a", "B", 1487030400, "n1")], "s string, d string, t bigint, h string")
    s, d, t, h = (F.col(c) for c in "sdth")
    got = row.select(
        labels.page_title(s, d, t), labels.page_title(s, d, t, h), labels.task_title(h, t, s)
    ).first()
    assert tuple(got) == (
        "a to B on 14-February-2017", "a to B at n1 on 14-February-2017", "n1 on 14-February-2017 at a",
    )
