"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates of all kinds are hashed and counted by distinct owners and repositories over the whole
corpus. A widely copied string is an example; a string of one owner that looks random is live. Base
matches are always reported; the frequency adds ``owned`` spans: random-looking tokens without any
marker, which only their ownership tells from shared identifiers.

Positions are code points. A span's place follows from the gaps that ``split`` leaves between the
matches, summed by a window over one document's matches.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one
owner of its own; repeated rows are separate rows of the same owner; other columns are ignored
(``redact`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.common import table, written

# The base kinds in their order, with what a match needs besides the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "owned"]

# A token without a marker: its length and how many different characters look random.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
DISTINCT_CHARS = 10
# Owners up to which a token is one owner's, and from which a string is a copied example.
LIVE_OWNERS = 1
COPIED_OWNERS = 3

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": TOKEN}
FOUND = "array<struct<kind:int,at:int,gap:int,chars:int,value:string>>"


def _found(text: Column, kind: str) -> Column:
    """Matches of one kind with the code points between each and the one before."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def place(match: Column, i: Column) -> Column:
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        return F.struct(
            F.lit(no).alias("kind"), i.alias("at"), F.element_at(gaps, i + 1).alias("gap"),
            F.char_length(match).alias("chars"), value.alias("value"),
        )

    return F.when(text.rlike(pattern), F.transform(matches, place)).otherwise(F.array().cast(FOUND))


def _looks_random(value: Column) -> Column:
    letters = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (letters >= DISTINCT_CHARS)


def scan(rows: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Matches of every row: ``row``, ``owner``, ``repository``, ``kind``, ``start``, ``end``,
    ``value_hash``. ``rows`` has ``row`` and ``found``; dropped matches still move the later ones."""
    matches = rows.filter(F.size("found") > 0).select(
        "row", owner.alias("owner"), repository.alias("repository"), F.inline("found")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("chars")).over(so_far)
    spans = matches.select(
        "row", "owner", "repository", "kind", "value", (end - F.col("chars")).alias("start"), end.alias("end")
    )
    base = F.col("kind") < 3
    kept = F.when(F.col("kind") == 0, F.char_length("value") >= ASSIGN_CHARS).otherwise(base | _looks_random(F.col("value")))
    spans = spans.filter(kept)
    # A marked match explains the token inside it, not one that goes on before or after it.
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    ended = F.max(F.when(base, F.col("end"))).over(in_order)
    clear = F.coalesce(ended, F.lit(0)) < F.col("end")
    return (
        spans.withColumn("clear", base | clear)
        .filter("clear")
        .select("row", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("value_hash"))
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate hash, over the whole corpus."""
    once = spans.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    return once.groupBy("value_hash").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("owner", "repository").alias("repositories"),
        F.sum("places").alias("places"),
    )


def judged(spans: DataFrame) -> DataFrame:
    """Spans to report, each ``live`` (one owner) or ``copied`` (many), else neither."""
    counted = spans.join(ownership(spans), "value_hash")
    reported = (F.col("kind") < 3) | (F.col("owners") <= LIVE_OWNERS)
    return counted.filter(reported).select(
        "row", "kind", "start", "end", "value_hash", "owners", "repositories",
        (F.col("owners") <= LIVE_OWNERS).alias("live"), (F.col("owners") >= COPIED_OWNERS).alias("copied"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _owner(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00"))


def _all_found(text: Column) -> Column:
    return F.concat(*[_found(text, kind) for kind in KINDS])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "lang") -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans, live and copied.

    A repository is one owner's ``repo_col``. The scan is written once without the texts; counting
    and reporting read that narrow table.
    """
    rows = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), _owner(owner_col).alias("owner"),
            _owner(repo_col).alias("repository"), _all_found(_text(text_col)).alias("found"),
        ).withColumn("row", F.expr("uuid()")),
        "secret-scan",
    )
    spans = written(scan(rows, F.col("owner"), F.col("repository")), "secret-spans")
    place = F.struct("start", "kind", "end", "live", "copied")
    by_row = judged(spans).groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("all"))
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,copied:boolean>>"))
    names = F.array(*[F.lit(x) for x in KINDS])

    def listed(spans: Column) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
        return F.array_join(one, ",")

    def count(test) -> Column:
        return F.size(F.filter(F.col("every"), test)).cast("bigint")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    base = F.filter(F.col("every"), lambda s: s["kind"] < 3)
    return (
        rows.select("row", "doc_id")
        .join(by_row, "row", "left")
        .select("doc_id", every.alias("every"))
        .select(
            "doc_id",
            *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(listed(base), 256).alias("base_sha256"),
            listed(F.col("every")).alias("spans"),
            count(lambda s: s["live"]).alias("n_live"),
            count(lambda s: s["copied"]).alias("n_copied"),
        )
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           repo_col: str = "lang") -> DataFrame:
    """``docs`` with every reported span replaced by ``<kind>``; overlapping spans become one.

    Only rows with a candidate are joined with their spans; all others pass through untouched.
    """
    body = _text(text_col)
    candidate = body.rlike(ASSIGN) | body.rlike(ACCESS) | body.rlike(HEX) | body.rlike(TOKEN)
    names = docs.columns
    some = written(docs.filter(candidate).withColumn("__row", F.expr("uuid()")), "secret-texts")
    rows = some.select(
        F.col("__row").alias("row"), _owner(owner_col).alias("owner"), _owner(repo_col).alias("repository"),
        _all_found(body).alias("found"),
    )
    spans = written(scan(rows, F.col("owner"), F.col("repository")), "secret-spans")
    # Runs of overlapping spans: a new one starts beyond all earlier ends.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("row").orderBy("start", "kind")
    begins = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True))
    runs = (
        judged(spans)
        .withColumn("begins", begins.cast("int"))
        .withColumn("run", F.sum("begins").over(order))
        .groupBy("row", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    )
    after = Window.partitionBy("row").orderBy("run")
    cuts = (
        runs.withColumn("from", F.coalesce(F.lag("end").over(after), F.lit(0)))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("from", "start", "end", "kind"))).alias("__cuts"))
        .withColumnRenamed("row", "__row")
    )
    labels = F.array(*[F.lit(f"<{x}>") for x in KINDS])

    def piece(cut: Column) -> Column:
        kept = F.substring(body, (cut["from"] + 1).cast("int"), (cut["start"] - cut["from"]).cast("int"))
        return F.concat(kept, F.element_at(labels, cut["kind"] + 1))

    rest = F.substring(body, (F.element_at("__cuts", -1)["end"] + 1).cast("int"), F.char_length(body))
    clean = F.concat(F.array_join(F.transform("__cuts", piece), ""), rest)
    changed = some.join(cuts, "__row", "left").withColumn(
        text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(clean)
    )
    return docs.filter(~candidate).select(*names).unionByName(changed.select(*names))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
