"""Queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP1_SQL, op1_decontaminate
from .embedding_dedup import op4_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extract import OP12_SQL, op12_html_text
from .packing import op5_packing
from .quality import op2_quality_pu
from .secrets import op6_secrets
from .sharding import op8_kd_sharding
from .simhash import op3_simhash
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import op10_suffix_dedup
from .warc import OP7_SQL, op7_warc
from .whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_quality_pu, op3_simhash, op4_embedding_dedup, op5_packing, op6_secrets, op7_warc, op8_kd_sharding,
             op9_substring_dedup, op10_suffix_dedup, op11_hard_negatives,
             op12_html_text, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op7_warc": OP7_SQL, "op9_substring_dedup": OP9_SQL,
            "op11_hard_negatives": OP11_SQL, "op12_html_text": OP12_SQL}
