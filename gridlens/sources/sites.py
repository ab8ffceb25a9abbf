"""Site allow-list and site-to-grid-name map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Allowed work and data sites with their grid names.
SITES = {
    "t0_ch_cern": "CERN-PROD",
    "t1_de_kit": "FZK-LCG2",
    "t1_es_pic": "pic",
    "t1_fr_ccin2p3": "IN2P3-CC",
    "t1_it_cnaf": "INFN-T1",
    "t1_ru_jinr": "JINR-T1",
    "t1_uk_ral": "RAL-LCG2",
    "t1_us_fnal": "USCMS-FNAL-WC1",
    "t2_at_vienna": "Hephy-Vienna",
    "t2_be_iihe": "BEgrid-ULB-VUB",
    "t2_be_ucl": "BelGrid-UCL",
    "t2_br_sprace": "SPRACE",
    "t2_ch_cscs": "CSCS-LCG2",
    "t2_cn_beijing": "BEIJING-LCG2",
    "t2_de_desy": "DESY-HH",
    "t2_es_ifca": "IFCA-LCG2",
    "t2_fi_hip": "FI_HIP_T2",
    "t2_fr_grif_irfu": "GRIF",
    "t2_fr_iphc": "IN2P3-IRES",
    "t2_gr_ioannina": "GR-07-UOI-HEPLAB",
    "t2_hu_budapest": "BUDAPEST",
    "t2_in_tifr": "INDIACMS-TIFR",
    "t2_it_rome": "INFN-ROMA1",
    "t2_pt_ncg_lisbon": "NCG-INGRID-PT",
    "t2_ru_ihep": "RU-Protvino-IHEP",
    "t2_ru_itep": "ITEP",
    "t2_ru_jinr": "JINR-LCG2",
    "t2_ru_pnpi": "ru-PNPI",
    "t2_uk_sgrid_bristol": "UKI-SOUTHGRID-BRIS-HEP",
    "t2_uk_sgrid_ralpp": "UKI-SOUTHGRID-RALPP",
    "t2_us_florida": "UFlorida-HPC",
    "t2_us_nebraska": "Nebraska",
    "t2_us_purdue": "Purdue-Hadoop",
    "t2_us_vanderbilt": "Vanderbilt",
    "t2_us_wisconsin": "GLOW",
}


def default_site_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITES.items()), "cms_site string, grid_site string")


# Documents may be kept in one folder per version, named after the day a version holds from.
VERSION = "version="


def current_version(spark: SparkSession, path: str, as_of: str | None = None) -> str:
    """The newest version folder of ``path``, or the newest not after the date ``as_of``; ``path``
    itself if it holds no versions."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()] if files.isDirectory(folder) else []
    versions = sorted(n for n in names if n.startswith(VERSION))
    if not versions:
        return path
    held = [n for n in versions if as_of is None or n.removeprefix(VERSION) <= as_of]
    if not held:
        raise ValueError(f"no version of {path} holds on {as_of}")
    return f"{path.rstrip('/')}/{held[-1]}"


def read_allowlist(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """``{"locations": [..]}`` as one row per site."""
    found = current_version(spark, path, as_of)
    document = spark.read.schema("locations array<string>").json(found, multiLine=True)
    return document.select(F.explode("locations").alias("cms_site"))


def read_site_map(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """``{"<site>": "<grid name>", ..}`` as one row per site."""
    document = spark.read.text(current_version(spark, path, as_of), wholetext=True)
    return document.select(
        F.explode(F.from_json("value", "map<string,string>")).alias("cms_site", "grid_site")
    )


def write_sites(site_map: DataFrame, path: str, version: str) -> None:
    """Write a version of both documents, ``<path>/allowed`` and ``<path>/names``: one row per site,
    so each is one small document. A version is replaced as a whole."""
    listed = site_map.agg(F.sort_array(F.collect_list("cms_site")).alias("locations"))
    named = site_map.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cms_site", "grid_site")))).alias("names"))
    for name, document in (("allowed", F.to_json(F.struct("locations"))), ("names", F.to_json("names"))):
        rows = (listed if name == "allowed" else named).select(document.alias("value"))
        rows.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}/{VERSION}{version}")
