"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import op3_byte_bpe
from .dialogue import op12_conversation_repair
from .filteraudit import op11_filter_audit
from .fst import op10_token_counts
from .jaccard import op1_jaccard_join
from .language import op4_language_id
from .licenses import op13_license_scan
from .nndescent import op7_nn_descent
from .packing import op2_best_fit
from .quality import op8_quality
from .sharding import op5_shard_tree
from .sql import conversation_repair, filter_audit, jaccard_join, near_duplicates, url_filter
from .tiff import op6_media_tiff
from .urlfilter import op9_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_best_fit": op2_best_fit,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_language_id": op4_language_id,
        "op5_shard_tree": op5_shard_tree,
        "op6_media_tiff": op6_media_tiff,
        "op7_nn_descent": op7_nn_descent,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_token_counts": op10_token_counts,
        "op11_filter_audit": op11_filter_audit,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": jaccard_join(), "op7_nn_descent": near_duplicates(), "op9_url_filter": url_filter(), "op11_filter_audit": filter_audit(), "op12_conversation_repair": conversation_repair()}
