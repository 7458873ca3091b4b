"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op6_nearest_neighbours
from .bpe import op8_bpe
from .class_lm import op12_class_language_model
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op13_source_divergence
from .media import op9_media_columns
from .packing_bfd import op3_token_matrices
from .packing_cg import op4_packing
from .quality import op10_quality_classifier
from .sharding import op1_sharding
from .simhash import op2_simhash
from .toxicity import op5_toxicity
from .turns import op11_conversation_repair
from .turns_sql import SQL as REPAIR_SQL
from .urls import op7_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_simhash": op2_simhash,
        "op3_token_matrices": op3_token_matrices,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_url_filters": op7_url_filters,
        "op8_bpe": op8_bpe,
        "op9_media_columns": op9_media_columns,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_class_language_model": op12_class_language_model,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": REPAIR_SQL, "op13_source_divergence": DIVERGENCE_SQL}
