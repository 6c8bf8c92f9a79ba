"""Row types and constants shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()

#: One mapping entry as a service returns it. The innermost value stays JSON text, whatever it is.
RAW = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("curies", T.ArrayType(S)),
        T.StructField("chosen_kg_id", S),
        T.StructField("kg_ids", T.MapType(S, T.ArrayType(S))),
        T.StructField("assigned_ids", T.MapType(S, T.MapType(S, T.MapType(S, S)))),
        T.StructField("error", S),
    ]
)
CORRUPT = "_corrupt"
RAW_OR_CORRUPT = T.StructType([*RAW.fields, T.StructField(CORRUPT, S)])
METADATA = T.StructType([T.StructField("request_id", S), T.StructField("processing_time_ms", D)])
ENVELOPE = T.StructType([T.StructField("result", RAW), T.StructField("metadata", METADATA), T.StructField(CORRUPT, S)])
BATCH = T.StructType([T.StructField("results", T.ArrayType(RAW)), T.StructField("metadata", METADATA), T.StructField("summary", T.MapType(S, L)), T.StructField(CORRUPT, S)])

REQUEST = T.StructType([T.StructField("ord", L, False), T.StructField("name", S), T.StructField("identifiers", T.MapType(S, S))])
RESULT_COLUMNS = ["query_name", "resolved", "primary_curie", "chosen_kg_id", "confidence_score", "identifiers", "hmdb_hint", "error", "raw_response"]

ENTITY_TYPES = T.StructType([T.StructField("entity_types", T.ArrayType(S)), T.StructField("aliases", T.MapType(S, S))])
ANNOTATORS = T.StructType([T.StructField("annotators", T.ArrayType(T.StructType([T.StructField(c, S) for c in ("slug", "name", "description")])))])
VOCABULARIES = T.StructType(
    [T.StructField("vocabularies", T.ArrayType(T.StructType([T.StructField("prefix", S), T.StructField("iri", S), T.StructField("aliases", T.ArrayType(S))])))]
)

DEFAULT_ENTITY_TYPE = "biolink:SmallMolecule"
DEFAULT_ANNOTATION_MODE = "missing"
DEFAULT_TIMEOUT = 30.0
#: Entities of one request, at most.
MAX_CHUNK = 1000
#: Scores from which the tier is high, or medium.
HIGH, MEDIUM = 2.0, 1.0
#: Match levels in order of trust; others count nothing.
LEVEL_PRIORITY = {"MS2": 3, "MS1": 2, "CURATION": 1}
HINT_VOCABULARY = "HMDB"
