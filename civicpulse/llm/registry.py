"""The queries of this subpackage and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op7_embedding_dedup
from .language_id import op5_language_id
from .license_scan import OP2_SQL, op2_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op4_mixing
from .packing import op3_packing
from .pii import op8_pii
from .quality import OP9_SQL, op9_quality
from .simhash import op10_simhash
from .token_counts import op6_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_packing": op3_packing,
        "op4_mixing": op4_mixing,
        "op5_language_id": op5_language_id,
        "op6_token_counts": op6_token_counts,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_pii": op8_pii,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op2_license_scan": OP2_SQL,
        "op9_quality": OP9_SQL,
    }
