"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.bpe import op2_bpe
from tessera.llm.html_extract import op8_html_extract
from tessera.llm.language_id import op6_language_id, pages_language
from tessera.llm.media import op7_media
from tessera.llm.near_dedup import op1_near_dedup
from tessera.llm.packing import op4_packing
from tessera.llm.quality_rules import OP10_SQL, op10_quality_rules
from tessera.llm.sharding import op5_sharding
from tessera.llm.separator_scan import op9_token_counts
from tessera.llm.token_files import op3_token_files


def queries():
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_bpe": op2_bpe,
        "op3_token_files": op3_token_files,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_media": op7_media,
        "op8_html_extract": op8_html_extract,
        "op9_token_counts": op9_token_counts,
        "op10_quality_rules": op10_quality_rules,
        "pages_language": pages_language,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    sql = {"op10_quality_rules": OP10_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
