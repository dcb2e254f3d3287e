"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, topk
from .decontaminate import op10_decontaminate
from .jaccard_join import op5_jaccard_join
from .language import op2_language
from .line_dedup import op6_line_dedup
from .licenses import op8_licenses
from .pack import op7_pack
from .quality import op4_quality
from .secrets_scan import op9_secrets
from .substring_dedup import op1_substring_dedup
from .topk import op3_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language": op2_language,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_pack": op7_pack,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op3_topk": topk.ORACLE,
    "op5_jaccard_join": oracles.OP5,
    "op10_decontaminate": oracles.OP10,
}
