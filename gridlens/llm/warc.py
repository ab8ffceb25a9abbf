"""Revisit records resolved to the response they stand for.

A web archive stores an unchanged page as a revisit: headers without a body. Resolving it is an
as-of join: the latest earlier full response of the same canonical URL. If its validators agree, the
revisit takes its body and headers, with the headers that a not-modified answer may change taken
from the revisit.

The join sorts no URL as a whole: time is cut at quantiles, each (URL, slice) pair is one window,
and the last response of the slices before it is carried in from one small aggregate.

Defined results: null URLs match nothing; records of equal time follow their id; a revisit without
any validator in common with the response does not resolve; entity tags agree as weak ones, with or
without ``W/``; repeated rows are separate records; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import table, written

# Slices of time: each (URL, slice) pair is one group, a URL has at most this many carried rows.
SLICES = 256

# Headers that describe the stored body and are never replaced by a revisit's.
BODY_HEADERS = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding"]
# Query parameters that do not choose the content.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """No scheme, fragment, ``www.``, default port, tracking parameter or closing slash; host in
    lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", r"$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/+$", "")
    return F.concat(host, rest)


def _slice(records: DataFrame) -> Column:
    """Which of SLICES quantile ranges of time a record is in."""
    cuts = records.agg(F.percentile_approx("time", [i / SLICES for i in range(1, SLICES)], 10 * SLICES)).first()[0]
    bounds = sorted(set(cuts or []))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("time")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with its response.

    ``records``: ``record_id``, ``time`` (bigint), ``url``, ``kind`` ('response' or 'revisit'),
    ``headers`` (map, names in lower case), ``body_chars`` and, if there is one, ``body``. Result:
    ``record_id``, ``canonical_url``, ``response_id``, ``outcome`` ('resolved', 'changed', 'no
    response'), ``headers``, ``body_chars`` and ``body`` if it was given. Bodies are joined last.
    """
    own = records.select(
        F.col("record_id").cast("bigint"), F.col("time").cast("bigint"), canonical_url(F.col("url")).alias("canonical_url"),
        "kind", "headers", F.col("body_chars").cast("bigint"),
    )
    # Written once: the slices, the responses they carry on and the revisits are read from it.
    placed = written(own.withColumn("slice", _slice(own)), "revisit-records")
    full = F.struct("time", "record_id", F.col("headers").alias("full_headers"), F.col("body_chars").alias("full_chars"))
    offered = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull(), full)
    key = F.struct("time", "record_id")
    latest = placed.groupBy("canonical_url", "slice").agg(
        F.max_by(offered, F.when(offered.isNotNull(), key)).alias("latest")
    )
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("canonical_url", "slice", F.last("latest", True).over(earlier).alias("carried"))
    inside = Window.partitionBy("canonical_url", "slice").orderBy("time", "record_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(offered, True).over(before)).filter("kind = 'revisit'")
    found = near.join(carried, ["canonical_url", "slice"], "left").withColumn("full", F.coalesce("near", "carried"))
    same = [
        F.regexp_replace(F.col("headers")["etag"], "^W/", "") == F.regexp_replace(F.col("full.full_headers")["etag"], "^W/", ""),
        F.col("headers")["last-modified"] == F.col("full.full_headers")["last-modified"],
    ]
    # Validators that both records have must agree, and at least one must be there.
    agrees = F.coalesce(same[0], same[1], F.lit(False)) & F.coalesce(same[1], F.lit(True))
    outcome = F.when(F.col("full").isNull(), "no response").when(agrees, "resolved").otherwise("changed")
    fresh = F.map_filter("headers", lambda k, _: ~k.isin(BODY_HEADERS))
    kept = F.map_filter("full.full_headers", lambda k, _: ~F.map_contains_key(fresh, k))
    ok = F.col("outcome") == "resolved"
    resolved = found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url",
        F.when(ok, F.col("full.record_id")).alias("response_id"), "outcome",
        F.when(ok, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("full.full_chars")).alias("body_chars"),
    )
    if "body" not in records.columns:
        return resolved
    # Written, so that a response with many revisits is a join of two scans, which Spark can split.
    bodies = written(
        records.filter("kind = 'response'")
        .groupBy(F.col("record_id").cast("bigint").alias("response_id"))
        .agg(F.min("body").alias("body")),
        "revisit-bodies",
    )
    return resolved.join(bodies, "response_id", "left").select(
        "record_id", "canonical_url", "response_id", "outcome", "headers", "body_chars", "body"
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl that asks again for every page.

    A page is one response with its body. It is asked for again later, and the answer is a revisit that
    names the validators the crawler holds. Pages take turns: a strong entity tag on both records, a weak
    one on the response, a modification time instead of a tag, the tag of another content, the same tag
    with another modification time. Every eleventh page has lost its URL. Ids order the crawl: visit n of
    page p is record 2 p + n; the second round comes half a table of ids after the first.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    turn = F.col("page_id") % 5
    tag = F.concat(F.lit('"'), F.md5(body.cast("binary")), F.lit('"'))
    changed = F.concat(F.lit('"'), F.md5(F.concat(body, F.lit("new")).cast("binary")), F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    later = F.floor(F.col("page_id") / 2)

    def headers(**values: Column) -> Column:
        """A header for each value that is not null."""
        named = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()])
        return F.map_from_entries(F.filter(named, lambda e: e["value"].isNotNull()))

    first = headers(
        etag=F.when(turn == 1, F.concat(F.lit("W/"), tag)).when(turn != 2, tag), last_modified=F.when(turn.isin(2, 4), modified),
        content_type=F.lit("text/html"), date=F.col("page_id").cast("string"), server=F.lit("a"),
        content_length=F.octet_length(body).cast("string"),
    )
    again = headers(
        etag=F.when(turn == 3, changed).when(turn != 2, tag),
        last_modified=F.when(turn == 2, modified).when(turn == 4, F.concat(modified, F.lit("b"))),
        date=(F.col("page_id") + later).cast("string"), content_length=F.lit("0"), cache_control=F.lit("max-age=60"),
    )
    visits = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("time"), F.lit("response").alias("kind"),
                 first.alias("headers"), F.char_length(body).alias("body_chars"), body.alias("body")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + later).alias("time"),
                 F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(0).alias("body_chars"), F.lit(None).cast("string").alias("body")),
    )
    return pages.select(F.when(F.col("page_id") % 11 != 7, F.col("url")).alias("url"), F.inline(visits))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages; headers as sorted ``name: value`` lines, the body they take as its digest."""
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id", "canonical_url", "response_id", "outcome", F.array_join(lines, "\n").alias("headers"), "body_chars",
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


OP9_SQL = r"""
with u as (
  select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(
    trim(case when page_id % 11 <> 7 then url end), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages),
h as (
  select page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
      '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g') as rest from u),
p as (
  select page_id, html, page_id % 5 as turn, case when page_id % 5 <> 2 then '"' || md5(html) || '"' end as tag,
    'day ' || page_id as day, host || regexp_replace(regexp_replace(rest, '[?&]+$', ''), '/+$', '') as canonical_url from h),
v as (
  select page_id, canonical_url, page_id * 2 + 1 as record_id, page_id + cast(floor(page_id / 2) as bigint) as time,
    case when turn = 3 then '"' || md5(html || 'new') || '"' else tag end as tag,
    case turn when 2 then day when 4 then day || 'b' end as day from p),
j as (
  select v.*, r.page_id as full_page, r.tag as full_tag, case when r.turn in (2, 4) then r.day end as full_day,
    r.turn as full_turn, r.html as full_html,
    row_number() over (partition by v.record_id order by r.page_id desc nulls last) as n
  from v left join p as r on r.canonical_url = v.canonical_url
    and (r.page_id < v.time or (r.page_id = v.time and r.page_id * 2 < v.record_id))),
k as (
  select *, coalesce(tag = full_tag, day = full_day, false) and coalesce(day = full_day, true) as agrees from j where n = 1)
select record_id, canonical_url,
  case when agrees then full_page * 2 end as response_id,
  case when full_page is null then 'no response' when agrees then 'resolved' else 'changed' end as outcome,
  concat_ws(chr(10), 'cache-control: max-age=60',
    'content-length: ' || case when agrees then strlen(full_html) else 0 end,
    case when agrees then 'content-type: text/html' end, 'date: ' || time,
    'etag: ' || coalesce(tag, case when agrees then case when full_turn = 1 then 'W/' else '' end || full_tag end),
    'last-modified: ' || coalesce(day, case when agrees then full_day end),
    case when agrees then 'server: a' end) as headers,
  case when agrees then length(full_html) end as body_chars, case when agrees then md5(full_html) end as body_md5
from k
"""
