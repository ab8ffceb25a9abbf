"""DuckDB SQL for every registered query, built from the view texts of the fixtures.

The SQL states each operator its own way - windows as a range join on a cell list, p-values by
the gamma-function form of the t distribution - so agreement is a check, not a copy.
"""

from __future__ import annotations

from gridlens import fixtures as fx
from gridlens.catalog.settle import digits_of, settle_sql, settled_sql
from gridlens.plans.points import JOB_POINTS, NETWORK_POINTS
from gridlens.schemas import DAY, JOB_METRIC_SOURCE, JOB_METRICS, NETWORK_SERIES, STATS

START, END = fx.PERIOD
INNER = (START + 5 * DAY, START + 20 * DAY)
KEYS = "task_type, src, dest, Workflow, LastRemoteHost, beginDate"
SLOT = "day, src, dest, LastRemoteHost, Workflow"
PAIR = "day, src, dest, Workflow"
FIT = ["slope", "intercept", "r", "p", "stderr"]
ALL_METRICS = [*JOB_METRICS, "DiskUsage", "BytesRecvd"]
SUMMARY_TASKS = "('DIGIRECO','RECO','DIGI','DataProcessing')"

STAT_SQL = {
    "min": "min({0})", "mean": "avg({0})", "max": "max({0})", "median": "median({0})",
    "std": "stddev_pop({0})",
}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def _stats(metrics: list[str]) -> str:
    return ", ".join(f"{STAT_SQL[s].format(m)} AS {s}{m}" for m in metrics for s in STATS)


JOBS = f"""jobs AS (
  SELECT *, CASE WHEN DataLocationsCount=2 THEN [DataLocation0,'T2_SITE_9'] ELSE [DataLocation0] END AS DataLocations
  FROM (SELECT {_columns(fx.JOB_COLUMNS)} FROM lineitem
        {" ".join(f"JOIN {t} ON {a}={b}" for t, a, b in fx.JOB_TABLES)}))"""

PROBES = f"""probes AS (
  SELECT {_columns(fx.PROBE_COLUMNS)}, cast(floor(epoch(ts)) AS bigint) AS ts_s,
         cast(floor(epoch(ts)) AS bigint)*1000 AS timestamp_ms FROM events)"""

SITES = f"site_map AS (SELECT {_columns(fx.SITE_COLUMNS)} FROM region WHERE r_regionkey < 4)"

HOST = "coalesce(regexp_replace(LastRemoteHost,'^[^@]*@([^@]*@)?',''),'Unknown')"

SELECTED = f"""selected AS (
  SELECT TaskType AS task_type, a.cms_site AS src, DataLocations[1] AS dest, a.grid_site AS grid_src,
         b.grid_site AS grid_dest, Workflow, {HOST} AS LastRemoteHost, JobCurrentStartDate, JobFinishedHookDone,
         {", ".join(f"{JOB_METRIC_SOURCE.get(m, m)} AS {m}" for m in ALL_METRICS if m != "Lumosity")},
         CASE WHEN KEvents>0 THEN WallClockHr/KEvents ELSE 0e0 END AS Lumosity
  FROM jobs JOIN site_map a ON lower(Site)=a.cms_site JOIN site_map b ON lower(DataLocations[1])=b.cms_site
  WHERE CMS_JobType='Processing' AND Status='Completed' AND TaskType IN {SUMMARY_TASKS}
    AND DataLocationsCount=1 AND InputData='Offsite' AND CMSSWKLumis IS NOT NULL
    AND ChirpCMSSWEventRate IS NOT NULL AND InputGB IS NOT NULL
    AND JobFinishedHookDone>{START} AND JobFinishedHookDone<{END})"""

GRID = f"grid AS (SELECT unnest(generate_series({START - 600}, {END}, 600)) AS beginDate)"

JOB_CELLS = """job_cells AS (
  SELECT * FROM selected JOIN grid ON JobCurrentStartDate<=beginDate AND JobFinishedHookDone>=beginDate+600)"""

NET = f"""taken AS (
  SELECT *, ts_s-14400 AS t0, ts_s AS t1,
         CASE WHEN MA=src THEN 'src' WHEN MA=dest THEN 'dest' END AS side FROM probes
  WHERE mtype IN ('throughput','latency','packet_loss_rate') AND srcSite IS NOT NULL AND destSite IS NOT NULL
    AND timestamp_ms>{START * 1000} AND timestamp_ms<{END * 1000}),
probe_cells AS (
  SELECT srcSite, destSite, beginDate,
         {", ".join(f"CASE WHEN side='{side}' AND mtype='{mtype}' THEN {value} END AS {side}{suffix}"
                    for mtype, suffix, value in (("throughput", "Throughput", "throughput"),
                                                 ("packet_loss_rate", "Packet", "packet_loss"),
                                                 ("latency", "Latency", "delay_mean"))
                    for side in ("src", "dest"))}
  FROM taken JOIN grid ON t0<=beginDate AND t1>=beginDate+600 WHERE side IS NOT NULL),
net AS (SELECT srcSite, destSite, beginDate, {_stats(NETWORK_SERIES)} FROM probe_cells GROUP BY ALL)"""

HEALTH = f"""job_stats AS (
  SELECT task_type, src, dest, grid_src, grid_dest, Workflow, LastRemoteHost, beginDate, {_stats(ALL_METRICS)}
  FROM job_cells GROUP BY ALL),
net_health AS (
  SELECT j.*, j.beginDate+600 AS endDate, n.* EXCLUDE (srcSite, destSite, beginDate)
  FROM job_stats j LEFT JOIN net n ON j.grid_src=n.srcSite AND j.grid_dest=n.destSite AND j.beginDate=n.beginDate)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


W_JOBS = _with(JOBS, SITES)
W_PROBES = _with(PROBES)
W_SELECTED = _with(JOBS, SITES, SELECTED)
W_HEALTH = _with(JOBS, SITES, SELECTED, GRID, JOB_CELLS, PROBES, NET, HEALTH)

SLICED = f"(SELECT *, beginDate-beginDate%{DAY} AS day FROM net_health WHERE beginDate%{DAY}<>0)"
SLICED_RECO = f"(SELECT * FROM {SLICED} WHERE task_type='DIGIRECO')"


def _unpivot(source: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{s}' AS series, mean{s} AS x FROM {source} WHERE mean{s} IS NOT NULL"
        for s in NETWORK_SERIES
    )


def _sides(source: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, 'src{kind}' AS series, mean{side}Throughput AS x,"
        f" coalesce(meansrc{kind},0e0) AS y_src, coalesce(meandest{kind},0e0) AS y_dest FROM {source}"
        f" WHERE mean{side}Throughput IS NOT NULL"
        f" AND (meansrc{kind} IS NOT NULL OR meandest{kind} IS NOT NULL)"
        for side in ("src", "dest")
        for kind in ("Packet", "Latency")
    )


def _p_value(t: str, df: str) -> str:
    """1 - P(|T| <= t): the finite angle series with its coefficients from the gamma function."""
    ratio = f"({df}/({df}+{t}*{t}))"
    angle = f"atan({t}/sqrt({df}))"
    odd = (
        f"(2/pi()*({angle}+sin({angle})*coalesce(list_sum(list_transform(range(1,cast(({df}-1)/2 AS bigint)+1),"
        f" lambda k: sqrt({ratio})*pow({ratio},k-1)*exp(lgamma(k)+lgamma(1.5e0)-lgamma(k+0.5e0)))),0e0)))"
    )
    even = (
        f"(sin({angle})*coalesce(list_sum(list_transform(range(0,cast({df}/2 AS bigint)),"
        f" lambda k: pow({ratio},k)*exp(lgamma(k+0.5e0)-lgamma(0.5e0)-lgamma(k+1)))),0e0))"
    )
    return f"least(1e0,greatest(0e0,1-CASE WHEN cast({df} AS bigint)%2=1 THEN {odd} ELSE {even} END))"


def _fits(source: str, keys: str, responses: dict[str, str], x: str = "x") -> str:
    """Fits of every response (prefix -> y) on x, as the columns n, slope, intercept, r, p, stderr."""
    sums = ", ".join(
        f"regr_count({y},{x})::bigint AS {p}n, regr_avgx({y},{x}) AS {p}ax, regr_avgy({y},{x}) AS {p}ay,"
        f" regr_sxx({y},{x}) AS {p}sxx, regr_syy({y},{x}) AS {p}syy, regr_sxy({y},{x}) AS {p}sxy"
        for p, y in responses.items()
    )
    flat = ", ".join(
        f"{p}sxx<=1e-24*{p}n*{p}ax*{p}ax AS {p}fx, {p}syy<=1e-24*{p}n*{p}ay*{p}ay AS {p}fy" for p in responses
    )
    slopes = ", ".join(
        f"CASE WHEN NOT {p}fx THEN CASE WHEN {p}fy THEN 0e0 ELSE {p}sxy/{p}sxx END END AS {p}slope,"
        f" CASE WHEN {p}fx OR {p}fy THEN 0e0"
        f" WHEN abs({p}sxy/sqrt({p}sxx*{p}syy))>1-1e-12 THEN sign({p}sxy)::double"
        f" ELSE {p}sxy/sqrt({p}sxx*{p}syy) END AS {p}r"
        for p in responses
    )
    tests = ", ".join(
        f"{p}ay-{p}slope*{p}ax AS {p}intercept, NOT {p}fx AND {p}n>2 AS {p}ok, ({p}n-2)::double AS {p}df,"
        f" CASE WHEN {p}n>2 THEN abs({p}r)*sqrt(({p}n-2)/((1-{p}r+1e-20)*(1+{p}r+1e-20))) END AS {p}t"
        for p in responses
    )
    final = ", ".join(
        f"{p}n, {p}slope, {p}intercept, {p}r,"
        f" CASE WHEN {p}ok THEN {_p_value(p + 't', p + 'df')} END AS {p}p,"
        f" CASE WHEN {p}ok THEN sqrt((1-{p}r*{p}r)*{p}syy/{p}sxx/{p}df) END AS {p}stderr"
        for p in responses
    )
    return (
        f"SELECT {keys}, {final} FROM (SELECT *, {tests} FROM (SELECT *, {slopes} FROM (SELECT *, {flat} FROM"
        f" (SELECT {keys}, {sums} FROM ({source}) GROUP BY ALL))))"
    )


def _show(fits: str, keys: str, prefixes: list[str], flags: str = "") -> str:
    columns = ", ".join(
        f"{p}n, " + ", ".join(f"{settle_sql(p + f)} AS {p}{f}" for f in FIT) for p in prefixes
    )
    return f"SELECT {keys}, {columns}{flags} FROM ({fits})"


def _flagged(fits: str) -> str:
    return f"SELECT *, coalesce(c_p<0.05e0 AND e_p<0.05e0, false) AS significant FROM ({fits})"


CE = {"c_": "y_src", "e_": "y_dest"}
NETWORK_FITS = _flagged(_fits(_sides(SLICED_RECO, SLOT), SLOT + ", series", CE))
OVERBYTE_FITS = _flagged(
    _fits(
        _unpivot(SLICED_RECO, SLOT + ", meanCpuEff, meanInputGB"),
        SLOT + ", series",
        {"c_": "meanCpuEff", "e_": "meanInputGB"},
    )
)
SCATTER_FITS = _flagged(
    _fits(
        _unpivot(SLICED_RECO, SLOT + ", meanCpuEff, meanEventRate"),
        SLOT + ", series",
        {"c_": "meanCpuEff", "e_": "meanEventRate"},
    )
)
LUMOSITY_FITS = _fits(SLICED, PAIR, {"c_": "meanCpuEff"}, "meanKEvents")
VSLUMOS_FITS = _fits(
    f"SELECT *, CASE WHEN meanWallClockHr<>0 THEN meanKEvents/meanWallClockHr END AS x FROM {SLICED}",
    PAIR,
    {"c_": "meanCpuEff", "e_": "meanEventRate"},
)
OPPOSED = "(c_slope>0 AND e_slope<0 OR c_slope<0 AND e_slope>0)"


def _effects(fits: str, effect: str, kinds: dict[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{kind}' AS key_kind, p.key, coalesce(h.hits,0) AS hits,"
        f" (SELECT count(*) FROM ({fits}) WHERE significant) AS total"
        f" FROM (SELECT DISTINCT {key} AS key FROM {SLICED_RECO}) p"
        f" LEFT JOIN (SELECT {key} AS key, count(*) AS hits FROM ({fits}) WHERE significant AND {effect}"
        f" GROUP BY 1) h ON p.key=h.key"
        for kind, key in kinds.items()
    )
    return f"SELECT * FROM ({parts})"


WORKFLOW_SLOT = {"workflow": "Workflow", "slot": "LastRemoteHost"}
PAIR_SLOT = {"pair": "concat(src,'TO',dest)", "slot": "LastRemoteHost"}
NETWORK_EFFECTS = _effects(NETWORK_FITS, OPPOSED, WORKFLOW_SLOT)
OVERBYTE_EFFECTS = _effects(OVERBYTE_FITS, "c_slope<0", PAIR_SLOT)
SCATTER_EFFECTS = _effects(SCATTER_FITS, OPPOSED, WORKFLOW_SLOT)


def _shares(counts: str) -> str:
    return (
        f"SELECT key_kind, key, hits, total, CASE WHEN total<>0 THEN hits::double/total END AS share FROM"
        f" ({counts} UNION ALL SELECT 'overall', 'Total', sum(hits)::bigint, max(total) FROM ({counts}))"
    )


def _content(where: str = "") -> str:
    return (
        f"SELECT task_type, count(*) AS n, min(beginDate) AS first, max(beginDate) AS last,"
        f" {settle_sql('avg(meanCpuEff)')} AS cpu_eff, count(meansrcPacket) AS with_packet"
        f" FROM net_health {where} GROUP BY ALL"
    )


def _report_lines(fits: str, x: str, responses: dict[str, str], slots: bool = True) -> str:
    """Report blocks of the significant fits per slot and series, or of all fits per site pair."""
    number = "coalesce(printf('%.6f', {}),'nan')"
    titles = ["Slope", "Intercept", "R Value", "P Value", "std err"]
    lines = [
        "strftime(make_timestamp(day*1000000),'%d-%B-%Y')",
        "concat('Workflow: ',Workflow)",
        "concat('Work site: ',src)",
        "concat('Data site: ',dest)",
    ]
    if slots:
        lines.append("concat('Slot: ',LastRemoteHost)")
    for prefix, y in responses.items():
        lines.append(f"concat('X: ',{x},'  Y: ',{y})")
        lines += [
            f"concat('{prefix}{t}: ',{number.format(prefix + f)})" for t, f in zip(titles, FIT, strict=True)
        ]
    lines.append("''")
    keys = SLOT + ", series" if slots else PAIR
    shown = _show(f"SELECT * FROM ({fits})" + " WHERE significant" * slots, keys, list(responses))
    return (
        f"SELECT {keys}, unnest(range({len(lines)}))::integer AS position,"
        f" unnest([{', '.join(lines)}]) AS line FROM ({shown})"
    )


def _intervals(throughput: bool) -> str:
    named = f"""named AS (
      SELECT a.cms_site AS src, DataLocations[1] AS dest, a.grid_site AS grid_src, b.grid_site AS grid_dest,
             JobCurrentStartDate AS t0, JobFinishedHookDone AS t1, CpuEff, ChirpCMSSWEventRate
      FROM jobs JOIN site_map a ON lower(Site)=a.cms_site JOIN site_map b ON lower(DataLocations[1])=b.cms_site
      WHERE CMS_JobType='Processing' AND DataLocationsCount=1 AND InputData='Offsite' AND EventRate>=0
        AND CompletionDate>{START} AND CompletionDate<{END}),
    pairs AS (SELECT DISTINCT src, dest, grid_src, grid_dest FROM named),
    found AS (SELECT * FROM probes WHERE (MA=src OR MA=dest) AND mtype<>'traceroute'
      AND timestamp_ms>{START * 1000} AND timestamp_ms<{END * 1000})"""
    both = (
        "(srcSite,destSite) IN (SELECT (srcSite,destSite) FROM found GROUP BY srcSite,destSite"
        " HAVING count(throughput)>0 AND count(packet_loss)>0)"
    )
    series = {
        "packet_loss": both if throughput else "true",
        "throughput": both if throughput else "false",
        "delay_mean": "true",
        "delay_median": "true",
        "delay_sd": "true",
    }
    probe_rows = " UNION ALL ".join(
        f"SELECT p.src, p.dest, '{s}' AS series, ts_s-14400 AS t0, ts_s AS t1, {s} AS value FROM found f"
        f" JOIN pairs p ON f.srcSite=p.grid_src AND f.destSite=p.grid_dest WHERE {s} IS NOT NULL AND {c}"
        for s, c in series.items()
    )
    return _with(JOBS, SITES, PROBES, named) + (
        f"SELECT src, dest, series, t0, t1, {settle_sql('value')} AS value FROM ("
        f"SELECT src, dest, 'CpuEff' AS series, t0, t1, CpuEff AS value FROM named WHERE CpuEff IS NOT NULL"
        f" UNION ALL SELECT src, dest, 'EventRate', t0, t1, ChirpCMSSWEventRate FROM named"
        f" WHERE ChirpCMSSWEventRate IS NOT NULL UNION ALL {probe_rows})"
    )


def _bucket_points(source: str, k: str, x: str, y: str) -> str:
    low = f"cast(floor({k}/50e0)*50 AS bigint)"
    return (
        f"SELECT {low} AS bucket, concat({low},' to ',{low}+50) AS label, {settle_sql(x)} AS x,"
        f" {settle_sql(y)} AS y FROM {source} WHERE {k}>0 AND {k}%50<>0 AND {x} IS NOT NULL AND {y} IS NOT NULL"
    )


STAMP = "make_timestamp(ts_s*1000000)"
ISO = f"strftime({STAMP},'%Y-%m-%dT%H:%M:%S')"
BASIC = f"strftime({STAMP},'%Y%m%dT%H%M%S')"
FINISHED = "make_timestamp(JobFinishedHookDone*1000000)"
DAY_TEXT = "strftime(make_timestamp(day*1000000),'%d-%B-%Y')"
DONE = f"(SELECT * FROM jobs WHERE CompletionDate>{START} AND CompletionDate<{END})"
LOC = "DataLocations[1]"

ORACLES: dict[str, str] = {
    "scan_jobs": W_JOBS + "SELECT * EXCLUDE (DataLocation0, DataLocations) FROM jobs",
    "scan_probes": W_PROBES + "SELECT * FROM probes",
    "scan_probes_iso": W_PROBES
    + f"SELECT event_id, mtype, CASE WHEN event_id%2=1 THEN {ISO} END AS timestamp, ts_s, timestamp_ms FROM probes",
    "scan_summary": W_HEALTH + f"SELECT {KEYS}, endDate, {settled_sql('meanCpuEff', 'meanKEvents')} FROM net_health",
    "scan_summary_task": W_HEALTH
    + f"SELECT {KEYS}, {settled_sql('meanCpuEff', 'meanInputGB')} FROM net_health WHERE task_type='DIGIRECO'",
    "site_allowlist": W_JOBS
    + "SELECT cms_site, count(*) AS n FROM jobs JOIN site_map ON lower(Site)=cms_site GROUP BY ALL",
    "site_map": W_JOBS
    + "SELECT lower(Site) AS cms_site, grid_site, count(*) AS n FROM jobs LEFT JOIN site_map ON lower(Site)=cms_site"
    " GROUP BY ALL",
    "site_map_as_of": W_JOBS
    + "SELECT cms_site, concat('OLD_',grid_site) AS grid_site, count(*) AS n"
    f" FROM jobs JOIN (SELECT {_columns(fx.SITE_COLUMNS)} FROM region) ON lower(Site)=cms_site GROUP BY ALL",
    "sink_summary": W_HEALTH + _content(),
    "reset_summary": W_HEALTH + _content(),
    "bulk_copy_days": W_PROBES
    + "SELECT strftime(d,'%Y-%m-%d') AS day, count(p.ts_s)>0 AS ok, count(p.ts_s) AS rows FROM"
    " (SELECT unnest(range(date '2024-01-01', date '2024-02-01', interval 1 day)) AS d)"
    f" LEFT JOIN (SELECT ts_s, {STAMP}::date AS pd FROM probes) p ON p.pd=d::date GROUP BY 1",
    "bulk_copy_content": W_PROBES
    + f"SELECT * FROM probes WHERE {STAMP}::date BETWEEN date '2024-01-01' AND date '2024-01-31'",
    "report_lines": W_HEALTH
    + _report_lines(OVERBYTE_FITS, "series", {"c_": "'meanCpuEff'", "e_": "'meanInputGB'"}),
    "report_scatter": W_HEALTH
    + _report_lines(SCATTER_FITS, "series", {"c_": "'meanCpuEff'", "e_": "'meanEventRate'"}),
    "report_network": W_HEALTH
    + _report_lines(
        NETWORK_FITS,
        "'Throughput'",
        {"c_": "'mean'||series", "e_": "CASE series WHEN 'srcPacket' THEN 'meandestPacket' ELSE 'meandestLatency' END"},
    ),
    "report_shares": W_HEALTH
    + f"SELECT key_kind, key, concat(key,' occurs ',coalesce(printf('%.6f',{settle_sql('share')}),'nan')) AS line"
    f" FROM ({_shares(OVERBYTE_EFFECTS)})",
    "filter_jobs": W_JOBS
    + "SELECT JobId, TaskType, Site FROM jobs WHERE CMS_JobType='Processing' AND Status='Completed'"
    " AND DataLocationsCount=1 AND InputData='Offsite' AND lower(Site) IN (SELECT cms_site FROM site_map)",
    "filter_exists": W_JOBS
    + "SELECT JobId, CMSSWKLumis, ChirpCMSSWEventRate, InputGB FROM jobs WHERE CMSSWKLumis IS NOT NULL"
    " AND ChirpCMSSWEventRate IS NOT NULL AND InputGB IS NOT NULL",
    "filter_time_range": W_JOBS
    + f"SELECT JobId, JobFinishedHookDone FROM jobs WHERE JobFinishedHookDone>{INNER[0]} AND"
    f" JobFinishedHookDone<{INNER[1]}",
    "filter_completion_range": W_JOBS
    + f"SELECT JobId, CompletionDate FROM jobs WHERE CompletionDate>{INNER[0]} AND CompletionDate<{INNER[1]}",
    "filter_probe_range": W_PROBES
    + f"SELECT event_id, mtype, timestamp_ms FROM probes WHERE timestamp_ms>{INNER[0] * 1000}"
    f" AND timestamp_ms<{INNER[1] * 1000}",
    "filter_probe_range_iso": W_PROBES
    + f"SELECT event_id, {ISO} AS timestamp FROM probes WHERE ts_s>{INNER[0]} AND ts_s<{INNER[1]}",
    "filter_min_rate": W_JOBS + f"SELECT JobId, {settled_sql('EventRate')} FROM jobs WHERE EventRate>=0",
    "filter_day_slice": W_HEALTH
    + f"SELECT {KEYS}, day FROM {SLICED} WHERE beginDate>{INNER[0]} AND beginDate<{INNER[1] + DAY}",
    "filter_bucket": W_JOBS
    + "SELECT JobId, cast(floor(KEvents/50e0)*50 AS bigint) AS bucket FROM jobs WHERE KEvents>0 AND KEvents%50<>0",
    "semi_data_site": W_JOBS
    + f"SELECT JobId, {LOC} AS location FROM jobs WHERE lower({LOC}) IN (SELECT cms_site FROM site_map)",
    "filter_probe_sites": W_PROBES
    + "SELECT event_id, srcSite, destSite FROM probes WHERE srcSite IS NOT NULL AND destSite IS NOT NULL",
    "probe_quarantine": W_PROBES + "SELECT event_id, MA, src, dest FROM probes WHERE MA<>src AND MA<>dest",
    "filter_metric_present": W_HEALTH
    + f"SELECT task_type, series, count(*) AS n FROM ({_unpivot('net_health', 'task_type')}) GROUP BY ALL",
    "filter_significant": W_HEALTH
    + _show(f"SELECT * FROM ({SCATTER_FITS}) WHERE significant", SLOT + ", series", ["c_", "e_"]),
    "filter_task_set": W_JOBS + f"SELECT JobId, TaskType FROM jobs WHERE TaskType IN {SUMMARY_TASKS}",
    "filter_pair_slot": W_HEALTH
    + f"SELECT {KEYS}, {settled_sql('meanCpuEff')} FROM net_health WHERE src='t2_site_0' AND dest='T2_SITE_1'"
    " AND LastRemoteHost='node0'",
    "parse_probe_time": W_PROBES
    + f"SELECT event_id, CASE event_id%4 WHEN 0 THEN concat({BASIC},'+0000') WHEN 1 THEN {ISO}"
    f" WHEN 2 THEN concat({BASIC},'Z') ELSE concat({ISO},'+00:00') END AS timestamp, ts_s AS ts FROM probes",
    "utc_stamp": W_PROBES + f"SELECT event_id, {ISO} AS text, ts_s AS stamp FROM probes",
    "utc_date": W_JOBS + f"SELECT JobId, strftime({FINISHED},'%Y-%m-%d %H:%M:%S') AS finished FROM jobs",
    "day_label": W_JOBS + f"SELECT strftime({FINISHED},'%d-%B-%Y') AS label, count(*) AS n FROM jobs GROUP BY ALL",
    "slot_trim": W_JOBS
    + "SELECT JobId, split_part(LastRemoteHost,'@',3) AS two, Workflow AS one, Workflow AS none,"
    " CASE WHEN LastRemoteHost IS NOT NULL THEN concat(split_part(LastRemoteHost,'@',3),'@x') END AS three FROM jobs",
    "host_default": W_JOBS
    + "SELECT coalesce(split_part(LastRemoteHost,'@',3),'Unknown') AS host, count(*) AS n FROM jobs GROUP BY ALL",
    "lumosity": W_JOBS
    + f"SELECT JobId, {settle_sql('CASE WHEN KEvents>0 THEN WallClockHr/KEvents ELSE 0e0 END')} AS lumosity FROM jobs",
    "mean_lumos": W_HEALTH
    + f"SELECT {KEYS}, {settle_sql('CASE WHEN meanWallClockHr<>0 THEN meanKEvents/meanWallClockHr END')} AS lumos"
    " FROM net_health",
    "probe_interval": W_PROBES + "SELECT event_id, ts_s-14400 AS t0, ts_s AS t1 FROM probes",
    "probe_side": W_PROBES
    + "SELECT event_id, CASE WHEN MA=src THEN 'src' ELSE 'dest' END AS side FROM probes WHERE MA=src OR MA=dest",
    "zero_fill_pair": W_HEALTH
    + f"SELECT {KEYS}, {settle_sql('coalesce(meansrcPacket,0e0)')} AS src_packet,"
    f" {settle_sql('coalesce(meandestPacket,0e0)')} AS dest_packet FROM net_health"
    " WHERE meansrcPacket IS NOT NULL OR meandestPacket IS NOT NULL",
    "pair_label": W_HEALTH + "SELECT concat(src,'TO',dest) AS label, count(*) AS n FROM net_health GROUP BY ALL",
    "cast_probe": W_PROBES
    + "SELECT event_id, coalesce(throughput,packet_loss,delay_mean)::double AS value, ts_s::integer AS ts,"
    " event_id::varchar AS id_text FROM probes WHERE mtype<>'traceroute'",
    "bucket_label": W_JOBS
    + "SELECT concat(cast(floor(KEvents/50e0)*50 AS bigint),' to ',cast(floor(KEvents/50e0)*50 AS bigint)+50) AS label,"
    " count(*) AS n FROM jobs WHERE KEvents>0 AND KEvents%50<>0 GROUP BY ALL",
    "page_title": W_HEALTH
    + f"SELECT concat(src,' to ',dest,' on ',{DAY_TEXT}) AS title,"
    f" concat(src,' to ',dest,' at ',LastRemoteHost,' on ',{DAY_TEXT}) AS slot_title,"
    f" concat(LastRemoteHost,' on ',{DAY_TEXT},' at ',src) AS task_title, n"
    f" FROM (SELECT day, src, dest, LastRemoteHost, count(*) AS n FROM {SLICED} GROUP BY ALL)",
    "join_site_names": W_JOBS
    + f"SELECT JobId, lower(Site) AS src, {LOC} AS dest, a.grid_site AS grid_src, b.grid_site AS grid_dest FROM jobs"
    f" JOIN site_map a ON lower(Site)=a.cms_site JOIN site_map b ON lower({LOC})=b.cms_site",
    "join_job_windows": _with(JOBS, SITES, SELECTED, GRID, JOB_CELLS)
    + f"SELECT {KEYS}, count(*) AS n FROM job_cells GROUP BY ALL",
    "join_window_probes": W_HEALTH
    + f"SELECT {KEYS}, {settled_sql('meanCpuEff', *['mean' + s for s in NETWORK_SERIES])} FROM net_health",
    "semi_probe_pairs": _with(JOBS, SITES, SELECTED, PROBES)
    + "SELECT event_id, srcSite, destSite, mtype FROM probes"
    " WHERE (srcSite,destSite) IN (SELECT DISTINCT (grid_src,grid_dest) FROM selected)",
    "pairs_present": W_HEALTH
    + f"SELECT day, src, dest, LastRemoteHost, count(*) AS n FROM {SLICED} GROUP BY ALL",
    "top_terms": W_HEALTH
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{f}' AS field, {f} AS term, count(*) AS n FROM net_health GROUP BY ALL"
        " ORDER BY n DESC, term LIMIT 10)"
        for f in ("src", "dest", "LastRemoteHost")
    ),
    "top_terms_filtered": W_JOBS
    + "SELECT Workflow AS term, count(*) AS n FROM jobs WHERE CMS_JobType='Processing' AND DataLocationsCount=1"
    " AND InputData='Offsite' AND ChirpCMSSWEventRate IS NOT NULL AND InputGB IS NOT NULL"
    f" AND TaskType='DataProcessing' AND JobFinishedHookDone>{INNER[0]} AND JobFinishedHookDone<{INNER[1]}"
    " GROUP BY ALL ORDER BY n DESC, term LIMIT 10",
    "max_kevents": W_HEALTH
    + f"SELECT 'summary' AS source, {settle_sql('max(meanKEvents)')} AS max_kevents FROM net_health"
    f" UNION ALL SELECT 'jobs', {settle_sql('max(KEvents)')} FROM jobs",
    "count_matches": W_SELECTED + "SELECT task_type, src, count(*) AS n FROM selected GROUP BY ALL",
    "job_window_stats": _with(JOBS, SITES, SELECTED, GRID, JOB_CELLS)
    + f"SELECT {KEYS}, {settled_sql(*[s + 'CpuEff' for s in STATS])} FROM"
    f" (SELECT {KEYS}, {_stats(['CpuEff'])} FROM job_cells GROUP BY ALL)",
    "probe_window_stats": _with(GRID, PROBES, NET)
    + f"SELECT srcSite, destSite, beginDate, {settled_sql(*[s + m for m in NETWORK_SERIES for s in STATS])} FROM net",
    "distinct_keys": W_JOBS
    + f"SELECT DISTINCT {LOC} AS location, Workflow AS workflow,"
    " coalesce(split_part(LastRemoteHost,'@',3),'Unknown') AS host FROM jobs",
    "regress_xy": W_JOBS
    + _show(_fits("SELECT * FROM jobs", "TaskType, Site", {"c_": "CpuEff"}, "KEvents"), "TaskType, Site", ["c_"]),
    "effect_opposed": W_HEALTH
    + f"SELECT *, 'network' AS analysis FROM ({NETWORK_EFFECTS}) UNION ALL"
    f" SELECT *, 'scatter' AS analysis FROM ({SCATTER_EFFECTS})",
    "effect_negative": W_HEALTH + OVERBYTE_EFFECTS,
    "effect_shares": W_HEALTH
    + " UNION ALL ".join(
        f"SELECT '{a}' AS analysis, key_kind, key, hits, total, {settled_sql('share')} FROM ({_shares(e)})"
        for a, e in (("network", NETWORK_EFFECTS), ("overbyte", OVERBYTE_EFFECTS), ("scatter", SCATTER_EFFECTS))
    ),
    "data_site_share": W_HEALTH
    + f"SELECT dest, groups, {settle_sql('groups::double/sum(groups) OVER ()')} AS share FROM"
    f" (SELECT dest, count(*) AS groups FROM (SELECT DISTINCT {SLOT} FROM {SLICED_RECO}) GROUP BY ALL)",
    "report_data_sites": W_HEALTH
    + "SELECT dest, concat(dest,' data location ',printf('%.6f',share)) AS line FROM"
    f" (SELECT dest, {settle_sql('groups::double/sum(groups) OVER ()')} AS share FROM"
    f" (SELECT dest, count(*) AS groups FROM (SELECT DISTINCT {SLOT} FROM {SLICED_RECO}) GROUP BY ALL))",
    "window_grid": W_JOBS
    + "SELECT beginDate, beginDate+600 AS endDate FROM (SELECT unnest(generate_series("
    "min(JobCurrentStartDate)-600, max(JobFinishedHookDone), 600)) AS beginDate FROM jobs)",
    "window_day": W_HEALTH
    + f"SELECT day, count(*) AS n FROM {SLICED} WHERE beginDate>{INNER[0]} AND beginDate<{INNER[1] + DAY} GROUP BY ALL",
    "sort_probes": W_PROBES
    + "SELECT event_id, mtype, ts_s FROM probes WHERE mtype<>'traceroute' AND srcSite IS NOT NULL"
    " AND destSite IS NOT NULL ORDER BY ts_s",
    "sort_jobs_in_group": W_SELECTED
    + f"SELECT src, dest, Workflow, LastRemoteHost, JobCurrentStartDate, {settled_sql('CpuEff')} FROM selected",
    "sort_summary_desc": W_HEALTH
    + f"SELECT {KEYS}, {settled_sql('meanCpuEff')} FROM net_health ORDER BY beginDate DESC",
    "union_throughput_sides": W_HEALTH
    + f"SELECT {KEYS}, series, {settled_sql('x', 'y_src', 'y_dest')} FROM ({_sides('net_health', KEYS)})",
    "unpivot_series": W_HEALTH + f"SELECT {KEYS}, series, {settled_sql('x')} FROM ({_unpivot('net_health', KEYS)})",
    "summary_build": W_HEALTH
    + f"SELECT {KEYS}, endDate, "
    + settled_sql(*[s + m for m in [*ALL_METRICS, *NETWORK_SERIES] for s in STATS])
    + " FROM net_health",
    "network_regression": W_HEALTH + _show(NETWORK_FITS, SLOT + ", series", ["c_", "e_"], ", significant"),
    "overbyte_regression": W_HEALTH + _show(OVERBYTE_FITS, SLOT + ", series", ["c_", "e_"], ", significant"),
    "scatter_regression": W_HEALTH + _show(SCATTER_FITS, SLOT + ", series", ["c_", "e_"], ", significant"),
    "lumosity_regression": W_HEALTH + _show(LUMOSITY_FITS, PAIR, ["c_"]),
    "vslumos_regression": W_HEALTH + _show(VSLUMOS_FITS, PAIR, ["c_", "e_"]),
    "report_lumosity": W_HEALTH + _report_lines(LUMOSITY_FITS, "'meanKEvents'", {"c_": "'meanCpuEff'"}, False),
    "report_vslumos": W_HEALTH
    + _report_lines(VSLUMOS_FITS, "'meanLumosity'", {"c_": "'meanCpuEff'", "e_": "'meanEventRate'"}, False),
    "points_kevent": W_HEALTH + _bucket_points("net_health", "meanKEvents", "meanCpuEff", "meanEventRate"),
    "points_kevent_hr": W_JOBS + _bucket_points(DONE, "KEvents", "CpuEff", "CoreHr"),
    "points_kevent_rate": W_JOBS + _bucket_points(DONE, "KEvents", "CpuEff", "ChirpCMSSWEventRate"),
    "points_task_type": W_JOBS
    + f"SELECT JobFinishedHookDone-JobFinishedHookDone%{DAY} AS day, lower(Site) AS site, TaskType AS task_type,"
    f" {settle_sql('CpuEff')} AS x, {settle_sql('ChirpCMSSWEventRate')} AS y FROM jobs"
    " WHERE TaskType IN ('RECO','DIGIRECO') AND InputData='Offsite' AND ChirpCMSSWEventRate IS NOT NULL"
    f" AND lower(Site) IN (SELECT cms_site FROM site_map) AND JobFinishedHookDone%{DAY}<>0",
    "interval_series": _intervals(True),
    "interval_series_reduced": _intervals(False),
}

# However the summary is built, it has the same rows.
ORACLES["summary_build_skewed"] = ORACLES["summary_build"]

for _name, (_x, _ys) in JOB_POINTS.items():
    ORACLES[_name] = (
        W_HEALTH
        + f"SELECT day, src, dest, {settle_sql('mean' + _x, digits_of(_x))} AS x, "
        + ", ".join(f"{settle_sql('mean' + y, digits_of(y))} AS {y}" for y in _ys)
        + f" FROM {SLICED}"
    )

for _name, _ys in NETWORK_POINTS.items():
    ORACLES[_name] = (
        W_HEALTH
        + f"SELECT day, src, dest, series, {settle_sql('x')} AS x, "
        + ", ".join(f"{settle_sql('mean' + y, digits_of(y))} AS {y}" for y in _ys)
        + " FROM ("
        + _unpivot(SLICED, "day, src, dest, " + ", ".join("mean" + y for y in _ys))
        + ")"
    )
