import pytest
from pyspark.sql import functions as F

from gridlens.operators import filters, joins, probes, reshape, sorting, terms


def longs(spark, values, kind="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def kept(df):
    return sorted(r.v for r in df.collect())


def test_ranges_are_open(spark):
    rows = longs(spark, [10, 11, 19, 20])
    assert kept(rows.filter(filters.in_period(F.col("v"), (10, 20)))) == [11, 19]
    millis = longs(spark, [10000, 10001, 19999, 20000])
    assert kept(millis.filter(filters.in_period_ms(F.col("v"), (10, 20)))) == [10001, 19999]


def test_midnight_belongs_to_no_day(spark):
    rows = longs(spark, [86400, 87000, 172200, 172800, 173400, 259200, 259800])
    assert kept(rows.filter(filters.within_days(F.col("v"), (86400, 172800)))) == [87000, 172200, 173400]


def test_multiples_belong_to_no_bucket(spark):
    rows = longs(spark, [-1.0, 0.0, 0.5, 50.0, 50.5, 100.0], "double")
    assert kept(rows.filter(filters.bucket_interior(F.col("v")))) == [0.5, 50.5]


def test_undefined_p_is_not_significant(spark):
    rows = spark.createDataFrame([(0.01, 0.01), (0.01, 0.05), (None, 0.01)], "a double, b double")
    flags = [r[0] for r in rows.select(filters.significant(F.col("a"), F.col("b"))).collect()]
    assert flags == [True, False, False]


def test_offsite_job_conditions(spark):
    rows = spark.createDataFrame(
        [("Processing", 1, "Offsite"), ("Analysis", 1, "Offsite"), ("Processing", 2, "Offsite"), ("Processing", 1, "Onsite")],
        "CMS_JobType string, DataLocationsCount int, InputData string",
    )
    assert filters.offsite_jobs(rows).count() == 1


def sites(spark):
    return spark.createDataFrame([("t1_a", "GA"), ("t2_b", "GB")], "cms_site string, grid_site string")


def test_site_joins_ignore_case_and_keep_the_data_site_text(spark):
    jobs = spark.createDataFrame(
        [(1, "T1_A", ["T2_B", "x"]), (2, "T1_A", ["T9_Z"]), (3, "T9_Z", ["T2_B"]), (4, "T1_A", []), (5, "T1_A", None)],
        "id int, Site string, DataLocations array<string>",
    )
    assert {r.id for r in joins.semi_data_site(jobs, sites(spark)).collect()} == {1, 3}
    assert {r.id for r in joins.semi_work_site(jobs, sites(spark)).collect()} == {1, 2, 4, 5}
    named = joins.join_site_names(jobs, sites(spark)).collect()
    assert [(r.id, r.src, r.dest, r.grid_src, r.grid_dest) for r in named] == [(1, "t1_a", "T2_B", "GA", "GB")]


def probe_rows(spark):
    return spark.createDataFrame(
        [(1, "a", "a", "b"), (2, "b", "a", "b"), (3, "a", "a", "a"), (4, "z", "a", "b")],
        "id int, MA string, src string, dest string",
    )


def test_probe_side_and_quarantine(spark):
    rows = probe_rows(spark)
    assert {r.id: r.side for r in probes.with_side(rows).collect()} == {1: "src", 2: "dest", 3: "src"}
    assert [r.id for r in probes.quarantine(rows).collect()] == [4]
    with pytest.raises(Exception, match="neither src nor dest"):
        probes.with_side(rows, strict=True).collect()


def test_top_terms_break_ties_by_value(spark):
    rows = longs(spark, ["b", "b", "a", "a", "c", None], "string")
    assert [tuple(r) for r in terms.top_terms(rows, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert terms.top_terms(rows, "v", None).count() == 3


def test_throughput_sides_share_a_series(spark):
    names = [s + m for m in ("Throughput", "Packet", "Latency") for s in ("meansrc", "meandest")]
    rows = spark.createDataFrame(
        [(1, 5.0, 6.0, 0.1, None, None, None), (2, None, 7.0, None, None, 1.0, 2.0), (3, None, None, 1.0, 1.0, 1.0, 1.0)],
        "k int, " + ", ".join(f"{n} double" for n in names),
    )
    got = sorted(tuple(r) for r in reshape.union_throughput_sides(rows, ["k"]).collect())
    assert got == [(1, "srcPacket", 5.0, 0.1, 0.0), (1, "srcPacket", 6.0, 0.1, 0.0), (2, "srcLatency", 7.0, 1.0, 2.0)]


def test_sort_in_groups(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), ("a", 1)], "k string, t int")
    got = [tuple(r) for r in sorting.sort_in_groups(rows, ["k"], "t").collect()]
    assert got == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]
    assert [r.t for r in sorting.sort_latest_first(rows, "t").collect()] == [3, 2, 1, 1]
