"""The scalar functions for SQL text, as temporary SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.schemas import HIGH, MEDIUM

_STRIP = r"regexp_replace({0}, r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '')"

FUNCTIONS = {
    "tessera_strip(s STRING) RETURNS STRING": _STRIP.format("s"),
    "tessera_unquote(s STRING) RETURNS STRING": """CASE WHEN length(s) >= 2 AND startswith(s, '"') AND endswith(s, '"') THEN substring(s, 2, length(s) - 2) ELSE s END""",
    "clean_name(s STRING) RETURNS STRING": r"nullif(tessera_strip(regexp_replace(tessera_unquote(tessera_strip(s)), r'_CE[\p{Nd}_]+(?=\n?\z)', '')), '')",
    "extract_id(s STRING) RETURNS STRING": r"coalesce(nullif(regexp_extract(s, r'HMDB:(HMDB\p{Nd}+)', 1), ''), nullif(regexp_extract(s, r'(?U)\b(HMDB\p{Nd}{5,7})\b', 1), ''))",
    "confidence_tier(x DOUBLE) RETURNS STRING": f"CASE WHEN x IS NULL THEN 'unknown' WHEN isnan(x) THEN 'low' WHEN x >= {HIGH} THEN 'high' WHEN x >= {MEDIUM} THEN 'medium' ELSE 'low' END",
    "ids_for(m MAP<STRING, ARRAY<STRING>>, v STRING) RETURNS ARRAY<STRING>": "coalesce(try_element_at(m, v), cast(array() AS ARRAY<STRING>))",
}


def register_functions(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
