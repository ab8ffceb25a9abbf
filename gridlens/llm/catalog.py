"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm.alignment import op11_alignment
from gridlens.llm.byte_pairs import op4_byte_pairs
from gridlens.llm.jaccard import OP7_SQL, op7_jaccard_join
from gridlens.llm.licenses import op13_licenses
from gridlens.llm.mixing import op8_mixing
from gridlens.llm.nearest import OP2_SQL, op2_nearest
from gridlens.llm.quality import op3_quality
from gridlens.llm.ranking import OP12_SQL, op12_ranking
from gridlens.llm.repeats import op6_repeats
from gridlens.llm.secrets import op5_secrets
from gridlens.llm.syncmers import op10_syncmers
from gridlens.llm.token_files import op1_token_files
from gridlens.llm.warc import OP9_SQL, op9_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_byte_pairs": op4_byte_pairs,
    "op5_secrets": op5_secrets,
    "op6_repeats": op6_repeats,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_revisits": op9_revisits,
    "op10_syncmers": op10_syncmers,
    "op11_alignment": op11_alignment,
    "op12_ranking": op12_ranking,
    "op13_licenses": op13_licenses,
}

ORACLES: dict[str, str] = {
    "op2_nearest": OP2_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_revisits": OP9_SQL,
    "op12_ranking": OP12_SQL,
}
