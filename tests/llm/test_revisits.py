"""Revisits take the body of their response; validators agree as the archive means them."""

from gridlens.llm import warc

RECORDS = "record_id bigint, time bigint, url string, kind string, headers map<string,string>, body_chars bigint, body string"


def test_bodies_and_validators(spark):
    day = {"last-modified": "Mon, 01 Jan 2024 00:00:00 GMT"}
    rows = [
        (1, 1, "http://a.x/p", "response", {"etag": '"x"'}, 3, "one"),
        (2, 2, "http://a.x/p", "revisit", {"etag": 'W/"x"'}, 0, None),
        (3, 3, "http://a.x/p", "revisit", {"etag": '"y"'}, 0, None),
        (4, 1, "http://b.x/", "response", day, 5, "three"),
        (5, 2, "http://b.x", "revisit", day, 0, None),
        (6, 3, "http://b.x", "revisit", {"last-modified": "later"}, 0, None),
        (7, 3, "http://c.x", "revisit", day, 0, None),
        (8, 4, "http://a.x/p", "revisit", {"etag": '"x"'} | day, 0, None),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    found = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {i: (r.response_id, r.outcome, r.body_chars, r.body) for i, r in found.items()} == {
        2: (1, "resolved", 3, "one"), 3: (None, "changed", None, None), 5: (4, "resolved", 5, "three"),
        6: (None, "changed", None, None), 7: (None, "no response", None, None), 8: (1, "resolved", 3, "one"),
    }
    assert "body" not in warc.resolve_revisits(records.drop("body")).columns


def test_awkward_records(spark):
    """No URL, equal times, repeated rows, no headers, other columns of names the operator uses."""
    rows = [
        (1, 5, None, "response", {"etag": "x"}, 1, "a", 0, "z"), (2, 6, None, "revisit", {"etag": "x"}, 0, None, 0, "z"),
        (3, 7, "http://w.x/a?utm_source=q", "response", {"etag": "y"}, 2, "b", 0, "z"),
        (5, 7, "https://www.w.x:443/a#top", "response", {"etag": "z"}, 3, "c", 0, "z"),
        (6, 7, "w.x/a", "revisit", {"etag": "z"}, 0, None, 0, "z"), (4, 7, "w.x/a", "revisit", {"etag": "y"}, 0, None, 0, "z"),
        (8, 9, "w.x/a", "revisit", None, 0, None, 0, "z"), (8, 9, "w.x/a", "revisit", None, 0, None, 0, "z"),
        (9, None, "w.x/a", "revisit", {"etag": "z"}, 0, None, 0, "z"),
    ]
    records = spark.createDataFrame(rows, RECORDS + ", slice int, latest string")
    found = sorted((r.record_id, r.response_id, r.outcome) for r in warc.resolve_revisits(records).collect())
    assert found == [
        (2, None, "no response"), (4, 3, "resolved"), (6, 5, "resolved"), (8, None, "changed"), (8, None, "changed"),
        (9, None, "no response"),
    ]
    assert warc.resolve_revisits(records.limit(0)).count() == 0
    assert warc.resolve_revisits(records.drop("body").limit(0)).count() == 0
