"""From JSON responses to result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import best_score, flat_assignments, grouped_codes, strip
from tessera.schemas import CORRUPT, ENVELOPE, RAW_OR_CORRUPT, RESULT_COLUMNS

UNKNOWN = "<unknown>"
EMPTY_RESULT = "Empty result from API"
BAD_LINE = "Failed to parse NDJSON line: "
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
_STRING_OR_NULL = r"^(STRING|VOID)$"


def _project(df: DataFrame, raw: Column, *, query_name: Column, hint: Column, raw_response: Column | None = None, also_error: Column | None = None) -> DataFrame:
    """The one projection from an entry to a result. A true error blanks all else; an empty error is none."""
    failed = F.coalesce(also_error, F.nullif(raw["error"], F.lit(""))) if also_error is not None else F.nullif(raw["error"], F.lit(""))
    ready = df.withColumns({"__failed": failed, "__raw": raw, "__query": query_name, "__hint": hint, "__json": raw_response if raw_response is not None else F.lit(None).cast("string")})
    empty = F.expr("cast(array() AS array<struct<vocab: string, code: string, meta: string>>)")
    ready = ready.withColumn("__flat", F.when(F.col("__failed").isNull(), F.coalesce(flat_assignments(F.col("__raw.assigned_ids")), empty)).otherwise(empty))
    fine = F.col("__failed").isNull()
    curie = F.get("__raw.curies", F.lit(0))
    some = fine & F.coalesce(F.size("__raw.curies") > 0, F.lit(False))
    made = {
        "query_name": F.col("__query"),
        "resolved": some,
        "primary_curie": F.when(some, curie),
        "chosen_kg_id": F.when(fine, F.col("__raw.chosen_kg_id")),
        "confidence_score": best_score(F.col("__flat")),
        "identifiers": grouped_codes(F.col("__flat")),
        "hmdb_hint": F.col("__hint"),
        "error": F.col("__failed"),
        "raw_response": F.col("__json"),
    }
    kept = [c for c in df.columns if c not in RESULT_COLUMNS]
    return ready.select(*kept, *[made[c].alias(c) for c in RESULT_COLUMNS])


def from_batch_entry(df: DataFrame, raw_col: str = "raw", *, query_name: Column | str = "name", hint: Column | None = None) -> DataFrame:
    """Parsed entries to results; raw_response stays null."""
    name = F.col(query_name) if isinstance(query_name, str) else query_name
    return _project(df, F.col(raw_col), query_name=name, hint=hint if hint is not None else F.lit(None).cast("string"))


def from_envelope(df: DataFrame, json_col: str = "response", *, query_name: Column | str = "name", hint: Column | None = None) -> DataFrame:
    """Single responses {"result", "metadata"} to results.

    An error without a result key is reported as text ("None" for a null); a
    null result is an error of its own that keeps the response.
    """
    name = F.col(query_name) if isinstance(query_name, str) else query_name
    keys = F.json_object_keys(json_col)
    surface = F.array_contains(keys, "error") & ~F.array_contains(keys, "result")
    parsed = df.withColumn("__env", F.from_json(json_col, ENVELOPE, _OPTIONS))
    message = F.coalesce(F.get_json_object(json_col, "$.error"), F.lit("None"))
    broken = keys.isNull() | F.col(f"__env.{CORRUPT}").isNotNull()
    missing = F.when(surface, message).when(broken, "Malformed response").when(F.col("__env.result").isNull(), EMPTY_RESULT)
    out = _project(
        parsed, F.col("__env.result"), query_name=name, hint=hint if hint is not None else F.lit(None).cast("string"), raw_response=F.when(~surface & ~broken, F.col(json_col)), also_error=missing
    )
    return out.drop("__env")


def strict_entry(json: Column) -> Column:
    """Whether a JSON text has the types an entry must have; from_json alone is more lenient."""
    tree = F.try_parse_json(json)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(tree, path, "variant"))

    def fits(path: str, pattern: str) -> Column:
        return F.coalesce(kind(path).rlike(pattern), F.lit(True))

    curies = fits("$.curies", r"^ARRAY<(STRING|VOID)>$") & ~F.coalesce(F.exists(F.try_variant_get(tree, "$.curies", "array<variant>"), F.is_variant_null), F.lit(False))
    plain = [fits(f"$.{c}", _STRING_OR_NULL) for c in ("name", "chosen_kg_id", "error")]
    maps = [fits(f"$.{c}", r"^OBJECT<") for c in ("kg_ids", "assigned_ids")]
    out = tree.isNotNull() & F.schema_of_variant(tree).startswith("OBJECT<") & curies
    for check in (*plain, *maps):
        out &= check
    return out


def from_ndjson(lines: DataFrame, value_col: str = "value", *, strict: bool = False, summaries: bool = True) -> DataFrame:
    """Result rows of NDJSON lines; blank lines are skipped, a bad line is an error row of its own.

    Works on batch and streaming frames. summaries=False drops lines that hold a
    summary instead of an entry; by default they count as unresolved entries.
    """
    line = strip(F.col(value_col))
    kept = lines.withColumn("__line", line).where(F.col("__line") != "")
    if not summaries:
        keys = F.json_object_keys("__line")
        entry = F.arrays_overlap(keys, F.array(F.lit("name"), F.lit("curies"), F.lit("error")))
        kept = kept.where(~F.coalesce(F.arrays_overlap(keys, F.array(F.lit("summary"), F.lit("stats"))) & ~entry, F.lit(False)))
    parsed = kept.withColumn("__parsed", F.from_json("__line", RAW_OR_CORRUPT, _OPTIONS))
    bad = F.col("__parsed").isNull() | F.col(f"__parsed.{CORRUPT}").isNotNull()
    if strict:
        bad |= ~strict_entry(F.col("__line"))
    message = F.when(bad, F.concat(F.lit(BAD_LINE), F.col("__line")))
    name = F.when(bad, UNKNOWN).otherwise(F.coalesce(F.col("__parsed.name"), F.lit("")))
    out = _project(parsed, F.col("__parsed"), query_name=name, hint=F.lit(None).cast("string"), also_error=message)
    return out.drop(value_col, "__line", "__parsed")
