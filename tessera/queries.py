"""Queries of the harmonization operators over the test tables, and the same in DuckDB SQL.

The tables hold no entity data, so inputs are derived from their columns, in the
same way on both sides. Outputs are scalar.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import operators as O
from tessera.errors import RateLimitError
from tessera.operators.catalog import invert_aliases
from tessera.plans.scratch import scratch_path, write_once
from tessera.schemas import RAW


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- names and queue -------------------------------------------------------


def _features(spark, sf_dir: str) -> DataFrame:
    """part as a feature table: quoted vendor names with a suffix, a hint in every second row, four match levels."""
    p = _table(spark, sf_dir, "part")
    digits = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit(' "'), "p_name", F.lit("_CE"), F.col("p_size").cast("string"), F.lit('" ')).alias("matched_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x;HMDB:HMDB"), digits)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("y HMDB"), digits, F.lit(" z"))).otherwise(F.concat(F.lit("HMDB"), digits, F.lit("_9"))).alias("ms1_compound_name"),
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("feature_id"),
        F.when(F.col("p_size") % 4 == 0, "MS2").when(F.col("p_size") % 4 == 1, "MS1").when(F.col("p_size") % 4 == 2, "CURATION").alias("match_level"),
    )


_FEATURES_SQL = """
f AS (
  SELECT p_partkey AS ord, p_name AS name,
         CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'HMDB' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS hint,
         'F' || p_partkey AS feature_id,
         CASE p_size % 4 WHEN 0 THEN 'MS2' WHEN 1 THEN 'MS1' WHEN 2 THEN 'CURATION' END AS level,
         CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS priority
  FROM part),
q AS (
  SELECT name, arg_min(hint, ord) FILTER (WHERE hint IS NOT NULL) AS hmdb_hint,
         string_agg(feature_id, ',' ORDER BY ord) AS feature_ids,
         max(priority) AS best, min(ord) AS first_ord
  FROM f GROUP BY name)
"""
_LEVEL_SQL = "CASE best WHEN 3 THEN 'MS2' WHEN 2 THEN 'MS1' WHEN 1 THEN 'CURATION' END"


def clean_name(spark, sf_dir):
    return _features(spark, sf_dir).select("ord", X.clean_name("matched_name").alias("name"))


def extract_id(spark, sf_dir):
    return _features(spark, sf_dir).select("ord", X.extract_id("ms1_compound_name").alias("hint"))


def sql_functions(spark, sf_dir):
    X.register_functions(spark)
    _features(spark, sf_dir).createOrReplaceTempView("tessera_features")
    return spark.sql("SELECT ord, clean_name(matched_name) AS name, extract_id(ms1_compound_name) AS hint, confidence_tier(ord / 50.0D) AS tier FROM tessera_features")


def _queue_columns(queue: DataFrame) -> DataFrame:
    return queue.select("name", "hmdb_hint", F.array_join("feature_ids", ",").alias("feature_ids"), "match_level", F.col("ord").alias("first_ord"))


def mapping_queue(spark, sf_dir):
    return _queue_columns(O.build_queue(_features(spark, sf_dir)))


def queue_limit(spark, sf_dir):
    return _queue_columns(O.build_queue(_features(spark, sf_dir), limit=10))


def api_record(spark, sf_dir):
    requests = O.as_requests(O.build_queue(_features(spark, sf_dir)))
    return requests.select("ord", "name", F.to_json("identifiers").alias("identifiers"))


def join_back(spark, sf_dir):
    queue = O.build_queue(_features(spark, sf_dir))
    results = queue.select("ord", F.col("name").alias("query_name"))
    return O.join_back(results, queue).select("ord", "feature_id", "query_name", "match_level")


# --- results ---------------------------------------------------------------


def _entries(spark, sf_dir: str) -> DataFrame:
    """JSON entries from part: curies unless p_partkey % 5 = 0, an error in every 7th, two annotators with scores."""
    p = _table(spark, sf_dir, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")

    def text(c):
        return F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)

    score = (F.col("p_size") / 16.0).cast("string")
    curies = F.when(k % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["C:'), key, F.lit('","D:'), key, F.lit('"]')))
    error = F.when(k % 7 == 0, F.lit('"not found"')).when(k % 7 == 1, F.lit('""')).otherwise(F.lit("null"))
    first = F.concat(F.lit('"a1":{"CHEBI":{"'), key, F.lit('":{"score":'), score, F.lit('}},"PUBCHEM":{}}'))
    second = F.concat(F.lit('"a2":{"CHEBI":{"9'), key, F.lit('":{}},"HMDB":{"H'), key, F.lit('":{"score":"0.5"}}}'))
    body = F.concat(F.lit('{"name":'), text(F.col("p_name")), F.lit(',"curies":'), curies, F.lit(',"chosen_kg_id":"K'), key, F.lit('","error":'), error, F.lit(',"extra":1,"assigned_ids":{'), first, F.lit(","), second, F.lit("}}"))
    return p.select(k.alias("ord"), F.col("p_name").alias("name"), body.alias("entry"))


def _results(spark, sf_dir: str) -> DataFrame:
    parsed = _entries(spark, sf_dir).withColumn("raw", F.from_json("entry", RAW))
    return O.from_batch_entry(parsed).drop("entry", "raw", "name")


_RESULTS_SQL = """
r AS (
  SELECT p_partkey AS ord, p_name AS query_name, p_partkey % 7 = 0 AS failed,
         p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS resolved,
         CAST(p_partkey AS VARCHAR) AS k, greatest(p_size / 16.0, 0.5) AS score
  FROM part)
"""
_TIER_SQL = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} >= 2 THEN 'high' WHEN {0} >= 1 THEN 'medium' ELSE 'low' END"


def build_results(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select(
        "ord", "query_name", "resolved", "primary_curie", "chosen_kg_id", "confidence_score",
        F.array_join(F.map_keys("identifiers"), ",").alias("vocabularies"),
        X.join_ids(X.ids_for("identifiers", "CHEBI")).alias("chebi"),
        "error",
    )


def flatten(spark, sf_dir):
    return O.flatten(_results(spark, sf_dir), keep=["ord"])


def ids_for(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("ord", X.join_ids(X.ids_for("identifiers", "HMDB")).alias("hmdb"), F.size(X.ids_for("identifiers", "CHEBI")).cast("long").alias("n_chebi"), F.size(X.ids_for("identifiers", "none")).cast("long").alias("n_none"))


def envelope_rules(spark, sf_dir):
    """Single responses: a result, an error alone, a null error, a null result."""
    e = _entries(spark, sf_dir)
    k = F.col("ord") % 4
    response = (
        F.when(k == 0, F.concat(F.lit('{"result":'), "entry", F.lit(',"metadata":{"request_id":"x"}}')))
        .when(k == 1, F.concat(F.lit('{"error":"refused '), F.col("ord").cast("string"), F.lit('"}')))
        .when(k == 2, F.lit('{"error":null}'))
        .otherwise(F.lit('{"result":null,"metadata":{}}'))
    )
    out = O.from_envelope(e.withColumn("response", response))
    return out.select("ord", "query_name", "resolved", "error", F.col("raw_response").isNotNull().alias("has_raw"))


def ndjson_malformed(spark, sf_dir):
    """documents as NDJSON: every 7th line blank, every 10th cut off."""
    d = _table(spark, sf_dir, "documents")
    good = F.concat(F.lit('{"name":"n'), F.col("doc_id").cast("string"), F.lit('","curies":["'), F.col("lang"), F.lit('"]}'))
    line = F.when(F.col("doc_id") % 7 == 0, F.lit(" \t ")).when(F.col("doc_id") % 10 == 0, good.substr(F.lit(1), F.length(good) - 4)).otherwise(good)
    out = O.from_ndjson(d.select("doc_id", line.alias("value")))
    return out.select("doc_id", "query_name", "resolved", "primary_curie", F.coalesce(F.col("error").startswith("Failed to parse NDJSON line: "), F.lit(False)).alias("bad"))


def best_score(spark, sf_dir):
    """Scores as numbers, texts, booleans and nonsense."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    meta = F.when(k == 0, F.lit('{"score":true}')).when(k == 1, F.lit('{"score":"1.5"}')).when(k == 2, F.lit('{"score":"high"}')).otherwise(F.lit("7"))
    flat = F.array(*[F.struct(F.lit("V").alias("vocab"), F.lit("c").alias("code"), m.alias("meta")) for m in (meta, F.when(F.col("event_id") % 5 == 0, F.lit('{"score":1.25}')))])
    return e.select("event_id", X.best_score(flat).alias("score"))


def parse_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- tiers and summaries ---------------------------------------------------


def _scored(spark, sf_dir: str) -> DataFrame:
    """events as results: a score but for every 11th, three vocabularies of different reach."""
    e = _table(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value")) / 50.0)
    vocabularies = F.filter(F.array(*[F.when(F.col("event_id") % n == 0, F.lit(v)) for v, n in (("CHEBI", 2), ("HMDB", 3), ("refmet_id", 10))]), lambda v: v.isNotNull())
    return e.select(
        "event_id",
        "event_type",
        score.alias("confidence_score"),
        (F.col("event_id") % 3 != 0).alias("resolved"),
        F.when(F.col("event_id") % 6 == 0, "timeout").when(F.col("event_id") % 6 == 3, "").alias("error"),
        F.map_from_arrays(vocabularies, F.transform(vocabularies, lambda v: F.array(v))).alias("identifiers"),
    )


def tier(spark, sf_dir):
    return O.with_tier(_scored(spark, sf_dir)).select("event_id", "confidence_tier")


def tier_filter(spark, sf_dir):
    return O.with_tier(_scored(spark, sf_dir)).where(F.col("confidence_tier").isin("medium", "low")).select("event_id", "confidence_tier")


def tier_counts(spark, sf_dir):
    return O.tier_counts(_scored(spark, sf_dir)).select("confidence_tier", "n", F.round("percent", 6).alias("percent"))


def summary(spark, sf_dir):
    return O.summarize(_scored(spark, sf_dir))


def vocab_coverage(spark, sf_dir):
    return O.vocabulary_coverage(_scored(spark, sf_dir))


def coverage_top(spark, sf_dir):
    return O.vocabulary_coverage(_scored(spark, sf_dir)).orderBy(F.desc("n"), "vocab").limit(2)


_SCORED_SQL = """
s AS (
  SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN floor(value) / 50.0 END AS score,
         event_id % 3 <> 0 AS resolved, event_id % 6 = 0 AS failed
  FROM events)
"""
_COVERAGE_SQL = " UNION ALL ".join(f"SELECT '{v}' AS vocab, count(*) AS n FROM events WHERE event_id % {n} = 0 HAVING count(*) > 0" for v, n in (("CHEBI", 2), ("HMDB", 3), ("refmet_id", 10)))


# --- catalogs --------------------------------------------------------------


def invert(spark, sf_dir):
    """region and nation as types and aliases."""
    types = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("type"))
    pairs = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("type"))
    return invert_aliases(types, pairs).select("pos", "type", F.array_join("aliases", ",").alias("aliases"))


def catalog_json(spark, sf_dir):
    """The same catalog through its JSON form."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    types = _table(spark, sf_dir, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("entity_types"))
    aliases = n.agg(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name"))).alias("aliases"))
    payload = types.join(F.broadcast(aliases)).select(F.to_json(F.struct("entity_types", "aliases")).alias("payload"))
    return O.entity_types(payload).select("type", F.array_join("aliases", ",").alias("aliases"))


def catalog_resolve(spark, sf_dir):
    """orders as requests by customer key, customers of two segments as the recorded catalog."""
    c = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    recorded = c.select(F.col("c_custkey").alias("name"), F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("curies"), F.lit(None).cast("string").alias("chosen_kg_id"), F.lit(None).cast("map<string,array<string>>").alias("kg_ids"), F.lit(None).cast("map<string,map<string,map<string,string>>>").alias("assigned_ids"), F.lit(None).cast("string").alias("error")).alias("raw"))
    requests = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("name"))
    out = O.from_batch_entry(O.resolve_offline(requests, recorded))
    return out.select("o_orderkey", F.col("query_name").alias("custkey"), F.coalesce("resolved", F.lit(False)).alias("resolved"), "primary_curie")


# --- chunks ----------------------------------------------------------------


def _asked(spark, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("HMDB"), F.col("event_type"))).alias("identifiers"))
    return O.number_chunks(O.requests(e))


def chunk_counts(spark, sf_dir):
    return O.request_bodies(_asked(spark, sf_dir)).select("chunk_id", "n")


def _echo(body: str, fail: int | None = None) -> str:
    """A stand-in for the service: names every entity back."""
    names = [e["name"] for e in json.loads(body)["entities"]]
    if fail is not None and names[0] == f"e{fail * 1000}":
        raise RuntimeError("HTTP 500")
    return json.dumps({"results": [{"name": n, "curies": ["C:" + n]} for n in names]})


def _responses(spark, sf_dir: str, fail: int | None) -> tuple[DataFrame, DataFrame]:
    from tessera.plans import send_chunks

    asked = write_once(_asked(spark, sf_dir), "asked")
    return asked, send_chunks(O.request_bodies(asked), functools.partial(_echo, fail=fail), parallel=8)


def positional_correlate(spark, sf_dir):
    out = O.correlate(*_responses(spark, sf_dir, None))
    return out.select("ord", "query_name", "resolved", "primary_curie", "hmdb_hint", "order_mismatch", "error")


def chunk_failure(spark, sf_dir):
    out = O.correlate(*_responses(spark, sf_dir, 0))
    return out.select("ord", "query_name", "resolved", "error")


def stream_ndjson(spark, sf_dir):
    """documents as NDJSON files, streamed to the end."""
    from tessera.streaming import run_stream, stream_results

    d = _table(spark, sf_dir, "documents")
    root = scratch_path(spark, "stream")
    line = F.when(F.col("doc_id") % 10 == 0, F.lit('{"name":')).otherwise(F.to_json(F.struct(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.array("lang").alias("curies"))))
    d.select(line.alias("value")).write.text(f"{root}/in")
    run = run_stream(stream_results(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint")
    return run.results.select("query_name", "resolved", "primary_curie", F.col("error").isNotNull().alias("bad"))


# --- whole requests, files and runs -----------------------------------------


def _suppliers(spark, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("HMDB"), F.col("s_suppkey").cast("string"))).alias("identifiers"))


def request_bodies(spark, sf_dir):
    """Whole bodies of chunks of four requests, with options."""
    asked = O.requests(_suppliers(spark, sf_dir), entity_type="t", annotation_mode="all", annotators=["a", "b"])
    return O.request_bodies(O.number_chunks(asked, size=4)).select("chunk_id", "n", "body")


def request_defaults(spark, sf_dir):
    """Requests without options; a null name is empty."""
    names = _suppliers(spark, sf_dir).withColumn("name", F.when(F.col("ord") % 3 != 0, F.col("name")))
    return O.requests(names).select("ord", F.to_json("request").alias("request"))


def _dataset_file(spark, sf_dir: str) -> str:
    """part as TSV files of several splits, names quoted where they must be, every third without an identifier."""
    path = scratch_path(spark, "dataset-file") + ".tsv"
    p = _table(spark, sf_dir, "part").select(F.concat("p_name", F.lit('\t"'), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("H"), F.col("p_partkey").cast("string"))).otherwise("").alias("hmdb_id"), F.col("p_brand").alias("unused"), "p_partkey")
    p.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.options(sep="\t", header=True, quote='"', escape='"', emptyValue="").csv(path)
    return path


def _dataset_records(spark, sf_dir: str) -> DataFrame:
    from tessera.sources import dataset_records, read_dataset

    return dataset_records(read_dataset(spark, _dataset_file(spark, sf_dir), sep="\t"), name_column="name", provided_id_columns=["hmdb_id"])


def dataset_requests(spark, sf_dir):
    """A dataset file of several splits: ordinals are gapless and in file order."""
    return _dataset_records(spark, sf_dir).select("ord", "name", F.element_at("identifiers", "hmdb_id").alias("hmdb_id"), F.size("identifiers").alias("n_ids"))


def dataset_map(spark, sf_dir):
    """The same file through a whole run of chunks."""
    from tessera.plans import map_entities

    return map_entities(_dataset_records(spark, sf_dir), _echo).select("ord", "query_name", "resolved", "primary_curie", "error")


def dataset_stream(spark, sf_dir):
    """A dataset answer that breaks off after all nations but ten: results so far and the error."""
    from tessera.plans import map_dataset_file

    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]

    def lines():
        for name in names[:-10]:
            yield json.dumps({"name": name, "curies": [f"C:{name}"]})
            yield " "
        raise OSError("cut off")

    run = map_dataset_file("nations.tsv", lines(), spark=spark)
    return run.results.join(F.broadcast(run.status().withColumnsRenamed({"error": "run_error", "complete": "run_complete"}))).select("ord", "query_name", "resolved", "primary_curie", "run_error", "run_complete")


def feature_frame(spark, sf_dir):
    """A pandas feature table with missing values of several kinds."""
    import numpy as np

    from tessera.sources import feature_table

    frame = _features(spark, sf_dir).orderBy("ord").drop("ord").toPandas()
    frame.loc[frame.index % 5 == 0, "match_level"] = np.nan
    return feature_table(spark, frame).select("ord", "feature_id", "match_level", X.clean_name("matched_name").alias("name"))


def empty_names(spark, sf_dir):
    """Features whose names are blank, quotes alone or a suffix alone have no row in the queue."""
    f = _features(spark, sf_dir)
    k = F.col("ord") % 7
    blank = F.when(k == 0, F.lit("")).when(k == 1, F.lit(' "" ')).when(k == 2, F.lit("_CE45")).when(k == 3, F.lit(None)).otherwise(F.col("matched_name"))
    return _queue_columns(O.build_queue(f.withColumn("matched_name", blank)))


def hints_of_results(spark, sf_dir):
    """Both choices of the second vocabulary, none and both, and the fourth vocabulary."""
    p = _table(spark, sf_dir, "part")
    k, key = F.col("p_partkey"), F.array(F.col("p_partkey").cast("string"))
    pairs = F.filter(F.array(F.struct(F.when(k % 2 == 0, F.lit("PUBCHEM.COMPOUND")).alias("v"), key.alias("c")), F.struct(F.when(k % 3 == 0, F.lit("PUBCHEM")).alias("v"), F.array_append(key, F.lit("z")).alias("c")), F.struct(F.when(k % 5 == 0, F.lit("refmet_id")).alias("v"), key.alias("c"))), lambda x: x["v"].isNotNull())
    results = p.select(k.alias("ord"), F.col("p_name").alias("query_name"), F.lit("h").alias("hmdb_hint"), F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("primary_curie"), F.lit(None).cast("string").alias("chosen_kg_id"), F.lit(None).cast("double").alias("confidence_score"), F.map_from_entries(pairs).alias("identifiers"), F.lit(None).cast("string").alias("error"))
    return O.flatten(results, keep=["ord"]).select("ord", "pubchem_ids", "refmet_ids", "hmdb_ids")


def order_mismatch(spark, sf_dir):
    """Responses in reverse order: entries stay with the request of their place and are marked."""
    from tessera.plans import map_entities

    return map_entities(_suppliers(spark, sf_dir), _reversed).select("ord", "query_name", "primary_curie", "order_mismatch")


def rate_limited(spark, sf_dir):
    """Every second chunk is refused with a pause: its records are errors, the others are not."""
    from tessera.plans import send_chunks

    asked = write_once(O.number_chunks(O.requests(_suppliers(spark, sf_dir)), size=3), "asked")
    out = O.correlate(asked, send_chunks(O.request_bodies(asked), _limited))
    return out.select("ord", "query_name", "resolved", "error")


def sink_tsv(spark, sf_dir):
    """Flat rows written as TSV and read back."""
    from tessera.sources import read_dataset, write_tsv

    path = scratch_path(spark, "tsv")
    write_tsv(_results(spark, sf_dir), path)
    back = read_dataset(spark, path, sep="\t")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("query_name", "resolved", "primary_curie", "confidence_tier", "hmdb_ids", "chebi_ids", "error")], F.col("confidence_score").cast("double").alias("score"))


def sink_json_lines(spark, sf_dir):
    """Results written as JSON lines and read back."""
    from tessera.sources import write_json_lines

    path = scratch_path(spark, "json-lines")
    write_json_lines(_results(spark, sf_dir), path)
    back = spark.read.schema("ord long, query_name string, resolved boolean, primary_curie string, identifiers map<string,array<string>>, error string, raw_response string").json(path)
    return back.select("ord", "query_name", "resolved", "primary_curie", X.join_ids(X.ids_for("identifiers", "CHEBI")).alias("chebi"), "error", "raw_response")


def sink_pandas(spark, sf_dir):
    """Results fetched as pandas frames, one after the other: the rows' places are the ordinals' order."""
    from tessera.sources import results_to_frames

    path, names = scratch_path(spark, "pandas"), "place long, query_name string, resolved boolean, chebi_ids string"
    spark.createDataFrame([], names).write.parquet(path)
    for frame in results_to_frames(_results(spark, sf_dir).repartition(5)):
        rows = [(i, n, bool(r), c) for i, n, r, c in zip(frame.index.tolist(), frame["query_name"], frame["resolved"], frame["chebi_ids"])]
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(names).parquet(path)


def annotators_json(spark, sf_dir):
    """regions as annotators, through their JSON form."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("r_name").alias("slug"), F.lower("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "even").alias("description"))))
    return O.annotators(_table(spark, sf_dir, "region").agg(F.to_json(F.struct(rows.alias("annotators"))).alias("payload")))


def vocabularies_json(spark, sf_dir):
    """nations as vocabularies, some without aliases."""
    n = _table(spark, sf_dir, "nation")
    rows = F.collect_list(F.struct(F.col("n_name").alias("prefix"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string"))).alias("iri"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lower("n_name"))).alias("aliases")))
    return O.vocabularies(n.agg(F.to_json(F.struct(rows.alias("vocabularies"))).alias("payload"))).select("prefix", "iri", F.array_join("aliases", ",").alias("aliases"))


def unknown_aliases(spark, sf_dir):
    """Aliases of types that the catalog doesn't have are dropped."""
    types = _table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("type"))
    pairs = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("type"))
    return invert_aliases(types, pairs).select("pos", "type", F.array_join("aliases", ",").alias("aliases"))


def status_errors(spark, sf_dir):
    """The kind of error, and what it quotes, of each status from 200 to 599."""
    from tessera.sources.http import error_for

    rows = [(s, error_for(s, {"Retry-After": "2.5"}, "y" * 500)) for s in range(200, 600)]
    return spark.createDataFrame([(s, type(e).__name__ if e else None, str(e).count("y" * 10) * 10 if e else 0, e.retry_after if s == 429 else None) for s, e in rows], "status long, kind string, quoted long, retry_after double")


def record_checks(spark, sf_dir):
    """Records in memory: missing and null names, numbers as names, no identifiers."""
    from tessera.sources import from_records

    names = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    records = ({"name": [n, None, len(n), n][i % 4], "identifiers": {"HMDB": n} if i % 2 else None} if i % 5 else {} for i, n in enumerate(names))
    return from_records(spark, records).select("ord", "name", F.try_element_at("identifiers", F.lit("HMDB")).alias("hmdb"))


class _Single:
    """A stand-in for the single endpoint."""

    def single(self, request: dict) -> str:
        return json.dumps({"result": {"name": request["name"], "curies": ["C:" + request["name"]]}, "metadata": {"request_id": "r"}})


def single_entities(spark, sf_dir):
    """regions one by one through the single endpoint, every second with an identifier."""
    from tessera.plans import map_entity

    names = [r["r_name"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    got = [map_entity(n, _Single(), spark=spark, identifiers={"HMDB": n.lower()} if i % 2 else None) for i, n in enumerate(names)]
    return spark.createDataFrame([(r["query_name"], r["resolved"], r["primary_curie"], r["hmdb_hint"], r["raw_response"] is not None) for r in got], "query_name string, resolved boolean, primary_curie string, hmdb_hint string, has_raw boolean")


def name_ids(spark, sf_dir):
    """The identifiers of one vocabulary by name, of those that have any."""
    r = _results(spark, sf_dir).select("query_name", F.explode(X.ids_for("identifiers", "CHEBI")).alias("id"))
    return r.groupBy("query_name").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def callback_rows(spark, sf_dir):
    """What a callback and a progress function see of a dataset run, in order."""
    from tessera.plans import map_dataset_file

    names, seen, steps = [r["n_name"] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()], [], []
    lines = (json.dumps({"name": n, "curies": [n]}) for n in names)
    map_dataset_file("n.tsv", lines, spark=spark, on_result=lambda r: seen.append((len(seen), r["query_name"])), progress=lambda done, total: steps.append((done, total)), total_hint=len(names))
    return spark.createDataFrame([(*a, *b) for a, b in zip(seen, steps, strict=True)], "place long, query_name string, done long, total long")


def stopped_run(spark, sf_dir):
    """A run that is stopped after its first chunk: what was sent stays, the rest are errors."""
    from tessera.plans import StopHandle, map_entities

    stop = StopHandle(spark)
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"))
    return map_entities(e, _echo, parallel=1, stop=stop, progress=lambda done, total: stop.stop()).select("ord", "resolved", "error")


def run_errors(spark, sf_dir):
    """What calls that can't be done raise or warn of."""
    import warnings

    from tessera import plans
    from tessera.sources import Settings

    def broken(n):
        yield from [json.dumps({"name": "a"})] * n
        raise OSError("cut off")

    calls = {
        "comma": lambda: plans.mapping.dataset_query(name_column="n", provided_id_columns=["a,b"]),
        "comma in annotators": lambda: plans.mapping.dataset_query(name_column="n", provided_id_columns=[], annotators=["a,b"]),
        "before the first line": lambda: plans.map_dataset_file("x", broken(0), spark=spark),
        "raise_for_error": lambda: plans.map_dataset_file("x", broken(2), spark=spark).raise_for_error(),
        "callback": lambda: plans.map_dataset_file("x", broken(2), spark=spark, on_result=lambda r: {}["x"]),
        "no address": lambda: Settings("nowhere", "key"),
        "identifier": lambda: plans.map_entities([{"name": "a", "identifiers": {"HMDB": 3}}], _echo, spark=spark),
        "limit": lambda: O.build_queue(_features(spark, sf_dir), limit=-1),
        "delay": lambda: plans.map_entities([], _echo, spark=spark, rate_limit_delay=0.001),
    }
    rows = []
    for name, call in calls.items():
        with warnings.catch_warnings():
            warnings.simplefilter("error", DeprecationWarning)
            try:
                call()
                rows.append((name, None))
            except Exception as e:
                rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "call string, raised string")


def dataset_params(spark, sf_dir):
    """Parameters of the dataset endpoint, for each region another choice of options."""
    from tessera.plans.mapping import dataset_query

    rows = []
    for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        k, name = r["r_regionkey"], r["r_name"]
        query = dataset_query(name_column=name, provided_id_columns=["a", "b"][: k % 3], annotators=["x", "y"] if k % 2 else None, vocab=name if k > 2 else None)
        rows.append((k, "&".join(f"{a}={b}" for a, b in sorted(query.items()))))
    return spark.createDataFrame(rows, "region int, query string")


def _reversed(body: str) -> str:
    got = json.loads(_echo(body))
    got["results"].reverse()
    return json.dumps(got)


def _limited(body: str) -> str:
    first = json.loads(body)["entities"][0]["name"]
    if int(first.rpartition("#")[2]) // 3 % 2:
        raise RateLimitError("slow down", retry_after=0.001)
    return _echo(body)


def flagship(spark, sf_dir):
    """Feature table to queue, resolved offline against recorded entries, flat, joined back to the features."""
    queue = O.build_queue(_features(spark, sf_dir))
    recorded = _entries(spark, sf_dir).groupBy("name").agg(F.min_by("entry", "ord").alias("entry")).select("name", F.from_json("entry", RAW).alias("raw"))
    resolved = O.from_batch_entry(O.resolve_offline(queue.select("ord", "name", "hmdb_hint"), recorded), hint=F.col("hmdb_hint"))
    return O.join_back(O.flatten(resolved, keep=["ord"]), queue).select("feature_id", "query_name", "match_level", "hmdb_hint", "resolved", "primary_curie", "confidence_tier", "chebi_ids", "error")


def queries():
    own = (
        clean_name, extract_id, sql_functions, mapping_queue, queue_limit, api_record, join_back, build_results, flatten, ids_for, envelope_rules, ndjson_malformed,
        best_score, parse_props, tier, tier_filter, tier_counts, summary, vocab_coverage, coverage_top, catalog_json, catalog_resolve, chunk_counts, positional_correlate, chunk_failure, stream_ndjson, flagship,
        request_bodies, request_defaults, dataset_requests, dataset_map, dataset_stream, feature_frame, empty_names, hints_of_results, order_mismatch, rate_limited, sink_tsv, sink_json_lines, sink_pandas,
        annotators_json, vocabularies_json, unknown_aliases, status_errors, record_checks, single_entities, name_ids, callback_rows, stopped_run, run_errors, dataset_params,
    )
    return {f.__name__: f for f in own} | {"invert_aliases": invert}


#: The name of a part in the dataset file: a tab and a quote in it.
_DATASET_NAME = "(p_name || chr(9) || '\"' || p_partkey)"


def oracle_sql():
    invert_sql = "SELECT CAST(r_regionkey AS INT) AS pos, r_name AS type, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS aliases FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"
    tiers = f"SELECT event_id, {_TIER_SQL.format('score')} AS confidence_tier FROM s"
    hint = "CASE WHEN p_partkey % 3 < 2 THEN 'HMDB' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END"
    return {
        "clean_name": "SELECT p_partkey AS ord, p_name AS name FROM part",
        "extract_id": f"SELECT p_partkey AS ord, {hint} AS hint FROM part",
        "sql_functions": f"SELECT p_partkey AS ord, p_name AS name, {hint} AS hint, {_TIER_SQL.format('(p_partkey / 50.0)')} AS tier FROM part",
        "mapping_queue": f"WITH {_FEATURES_SQL} SELECT name, hmdb_hint, feature_ids, {_LEVEL_SQL} AS match_level, first_ord FROM q",
        "queue_limit": f"WITH {_FEATURES_SQL} SELECT name, hmdb_hint, feature_ids, {_LEVEL_SQL} AS match_level, first_ord FROM q ORDER BY first_ord LIMIT 10",
        "api_record": f"""WITH {_FEATURES_SQL} SELECT first_ord AS ord, name, CASE WHEN hmdb_hint IS NOT NULL THEN '{{"HMDB":"' || hmdb_hint || '"}}' END AS identifiers FROM q""",
        "join_back": f"WITH {_FEATURES_SQL} SELECT first_ord AS ord, feature_id, q.name AS query_name, {_LEVEL_SQL} AS match_level FROM f JOIN q ON f.name = q.name",
        "build_results": f"""WITH {_RESULTS_SQL} SELECT ord, query_name, resolved, CASE WHEN resolved THEN 'C:' || k END AS primary_curie,
            CASE WHEN NOT failed THEN 'K' || k END AS chosen_kg_id, CASE WHEN NOT failed THEN score END AS confidence_score,
            CASE WHEN failed THEN '' ELSE 'CHEBI,HMDB' END AS vocabularies, CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi,
            CASE WHEN failed THEN 'not found' END AS error FROM r""",
        "flatten": f"""WITH {_RESULTS_SQL} SELECT ord, query_name, '' AS hmdb_hint, resolved, CASE WHEN resolved THEN 'C:' || k ELSE '' END AS primary_curie,
            CASE WHEN failed THEN '' ELSE 'K' || k END AS chosen_kg_id, CASE WHEN NOT failed THEN score END AS confidence_score,
            CASE WHEN failed THEN 'unknown' WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence_tier,
            CASE WHEN failed THEN '' ELSE 'H' || k END AS hmdb_ids, '' AS pubchem_ids, CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi_ids,
            '' AS refmet_ids, CASE WHEN failed THEN 'not found' ELSE '' END AS error FROM r""",
        "ids_for": f"WITH {_RESULTS_SQL} SELECT ord, CASE WHEN failed THEN '' ELSE 'H' || k END AS hmdb, CAST(CASE WHEN failed THEN 0 ELSE 2 END AS BIGINT) AS n_chebi, CAST(0 AS BIGINT) AS n_none FROM r",
        "envelope_rules": f"""WITH {_RESULTS_SQL} SELECT ord, query_name, ord % 4 = 0 AND resolved AS resolved,
            CASE WHEN ord % 4 = 0 AND failed THEN 'not found' WHEN ord % 4 = 1 THEN 'refused ' || k WHEN ord % 4 = 2 THEN 'None' WHEN ord % 4 = 3 THEN 'Empty result from API' END AS error,
            ord % 4 IN (0, 3) AS has_raw FROM r""",
        "ndjson_malformed": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '<unknown>' ELSE 'n' || doc_id END AS query_name, doc_id % 10 <> 0 AS resolved,
            CASE WHEN doc_id % 10 <> 0 THEN lang END AS primary_curie, doc_id % 10 = 0 AS bad FROM documents WHERE doc_id % 7 <> 0""",
        "best_score": """SELECT event_id, greatest(CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE END, CASE WHEN event_id % 5 = 0 THEN 1.25::DOUBLE END) AS score FROM events""",
        "parse_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "tier": f"WITH {_SCORED_SQL} {tiers}",
        "tier_filter": f"WITH {_SCORED_SQL} SELECT * FROM ({tiers}) WHERE confidence_tier IN ('medium', 'low')",
        "tier_counts": f"WITH {_SCORED_SQL} SELECT confidence_tier, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM ({tiers}) GROUP BY 1",
        "summary": f"""WITH {_SCORED_SQL} SELECT count(*) AS total_queried, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS unresolved,
            count(*) FILTER (WHERE failed AND NOT resolved) AS errors, count(*) FILTER (WHERE resolved)::DOUBLE / count(*) AS resolution_rate FROM s""",
        "vocab_coverage": _COVERAGE_SQL,
        "coverage_top": f"SELECT vocab, n FROM ({_COVERAGE_SQL}) ORDER BY n DESC, vocab LIMIT 2",
        "invert_aliases": invert_sql,
        "catalog_json": f"SELECT type, aliases FROM ({invert_sql})",
        "catalog_resolve": """SELECT o_orderkey, o_custkey AS custkey, c_custkey IS NOT NULL AS resolved, c_mktsegment AS primary_curie
            FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) ON o_custkey = c_custkey""",
        "chunk_counts": "SELECT event_id // 1000 AS chunk_id, count(*) AS n FROM events GROUP BY 1",
        "positional_correlate": """SELECT event_id AS ord, 'e' || event_id AS query_name, true AS resolved, 'C:e' || event_id AS primary_curie,
            CASE WHEN event_id % 2 = 0 THEN event_type END AS hmdb_hint, false AS order_mismatch, CAST(NULL AS VARCHAR) AS error FROM events""",
        "chunk_failure": "SELECT event_id AS ord, 'e' || event_id AS query_name, event_id >= 1000 AS resolved, CASE WHEN event_id < 1000 THEN 'HTTP 500' END AS error FROM events",
        "stream_ndjson": """SELECT CASE WHEN doc_id % 10 = 0 THEN '<unknown>' ELSE 'n' || doc_id END AS query_name, doc_id % 10 <> 0 AS resolved,
            CASE WHEN doc_id % 10 <> 0 THEN lang END AS primary_curie, doc_id % 10 = 0 AS bad FROM documents""",
        "request_bodies": """SELECT s_suppkey // 4 AS chunk_id, count(*) AS n, '{"entities":[' || string_agg('{"name":"' || s_name || '","entity_type":"t","identifiers":' || CASE WHEN s_suppkey % 2 = 0 THEN '{"HMDB":"' || s_suppkey || '"}' ELSE '{}' END
            || ',"options":{"annotation_mode":"all","annotators":["a","b"]}}', ',' ORDER BY s_suppkey) || ']}' AS body FROM supplier GROUP BY 1""",
        "request_defaults": """SELECT s_suppkey AS ord, '{"name":"' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END || '","entity_type":"biolink:SmallMolecule","identifiers":' || CASE WHEN s_suppkey % 2 = 0 THEN '{"HMDB":"' || s_suppkey || '"}' ELSE '{}' END
            || ',"options":{"annotation_mode":"missing"}}' AS request FROM supplier""",
        "dataset_requests": f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, {_DATASET_NAME} AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'H' || p_partkey END AS hmdb_id, CAST(p_partkey % 3 <> 0 AS INT) AS n_ids FROM part",
        "dataset_map": f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, {_DATASET_NAME} AS query_name, true AS resolved, 'C:' || {_DATASET_NAME} AS primary_curie, CAST(NULL AS VARCHAR) AS error FROM part",
        "dataset_stream": "SELECT rank AS ord, n_name AS query_name, true AS resolved, 'C:' || n_name AS primary_curie, 'cut off' AS run_error, false AS run_complete FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS rank, count(*) OVER () AS n FROM nation) WHERE rank < n - 10",
        "feature_frame": f"WITH {_FEATURES_SQL} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, feature_id, CASE WHEN (row_number() OVER (ORDER BY ord) - 1) % 5 <> 0 THEN level END AS match_level, name FROM f",
        "empty_names": f"WITH {_FEATURES_SQL.replace('FROM f GROUP', 'FROM f WHERE ord % 7 > 3 GROUP')} SELECT name, hmdb_hint, feature_ids, {_LEVEL_SQL} AS match_level, first_ord FROM q",
        "hints_of_results": """SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN '' || p_partkey WHEN p_partkey % 3 = 0 THEN p_partkey || ';z' ELSE '' END AS pubchem_ids,
            CASE WHEN p_partkey % 5 = 0 THEN '' || p_partkey ELSE '' END AS refmet_ids, '' AS hmdb_ids FROM part""",
        "order_mismatch": """SELECT a.s_suppkey AS ord, a.s_name AS query_name, 'C:' || b.s_name AS primary_curie, a.s_name <> b.s_name AS order_mismatch
            FROM (SELECT *, count(*) OVER (PARTITION BY s_suppkey // 1000) AS n FROM supplier) a JOIN supplier b ON b.s_suppkey = (a.s_suppkey // 1000) * 1000 + n - 1 - a.s_suppkey % 1000""",
        "rate_limited": "SELECT s_suppkey AS ord, s_name AS query_name, s_suppkey // 3 % 2 = 0 AS resolved, CASE WHEN s_suppkey // 3 % 2 = 1 THEN 'slow down' END AS error FROM supplier",
        "sink_tsv": f"""WITH {_RESULTS_SQL} SELECT query_name, CASE WHEN resolved THEN 'True' ELSE 'False' END AS resolved, CASE WHEN resolved THEN 'C:' || k ELSE '' END AS primary_curie,
            CASE WHEN failed THEN 'unknown' WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence_tier, CASE WHEN failed THEN '' ELSE 'H' || k END AS hmdb_ids,
            CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi_ids, CASE WHEN failed THEN 'not found' ELSE '' END AS error, CASE WHEN NOT failed THEN score END AS score FROM r""",
        "sink_json_lines": f"""WITH {_RESULTS_SQL} SELECT ord, query_name, resolved, CASE WHEN resolved THEN 'C:' || k END AS primary_curie, CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi,
            CASE WHEN failed THEN 'not found' END AS error, CAST(NULL AS VARCHAR) AS raw_response FROM r""",
        "sink_pandas": f"WITH {_RESULTS_SQL} SELECT row_number() OVER (ORDER BY ord) - 1 AS place, query_name, resolved, CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi_ids FROM r",
        "annotators_json": "SELECT r_name AS slug, lower(r_name) AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'even' END AS description FROM region",
        "vocabularies_json": "SELECT n_name AS prefix, CASE WHEN n_nationkey % 3 = 0 THEN 'http://x/' || n_nationkey END AS iri, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '' END AS aliases FROM nation",
        "unknown_aliases": f"SELECT * FROM ({invert_sql}) WHERE pos < 3",
        "status_errors": """SELECT s AS status, CASE WHEN s IN (401, 403) THEN 'AuthError' WHEN s = 429 THEN 'RateLimitError' WHEN s >= 500 THEN 'ServerError' WHEN s >= 400 THEN 'HttpStatusError' END AS kind,
            CAST(CASE WHEN s >= 500 THEN 200 ELSE 0 END AS BIGINT) AS quoted, CASE WHEN s = 429 THEN 2.5::DOUBLE END AS retry_after FROM range(200, 600) t(s)""",
        "record_checks": """SELECT i AS ord, CASE WHEN i % 5 = 0 THEN '' WHEN i % 4 = 1 THEN NULL WHEN i % 4 = 2 THEN '' || length(n_name) ELSE n_name END AS name, CASE WHEN i % 2 = 1 AND i % 5 <> 0 THEN n_name END AS hmdb
            FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)""",
        "single_entities": "SELECT r_name AS query_name, true AS resolved, 'C:' || r_name AS primary_curie, CASE WHEN r_regionkey % 2 = 1 THEN lower(r_name) END AS hmdb_hint, true AS has_raw FROM region",
        "name_ids": f"WITH {_RESULTS_SQL} SELECT query_name, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT query_name, k AS id FROM r WHERE NOT failed UNION SELECT query_name, '9' || k FROM r WHERE NOT failed) GROUP BY query_name",
        "callback_rows": "SELECT i AS place, n_name AS query_name, i + 1 AS done, n AS total FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)",
        "stopped_run": "SELECT event_id AS ord, event_id < 1000 AS resolved, CASE WHEN event_id >= 1000 THEN 'Not sent: the run was stopped' END AS error FROM events",
        "run_errors": """SELECT * FROM (VALUES ('comma', 'ValueError'), ('comma in annotators', 'ValueError'), ('before the first line', 'OSError'), ('raise_for_error', 'MappingError'), ('callback', 'KeyError'),
            ('no address', 'ConfigError'), ('identifier', 'ValueError'), ('limit', 'ValueError'), ('delay', 'DeprecationWarning')) t(call, raised)""",
        "dataset_params": """SELECT r_regionkey AS region, 'annotation_mode=missing&' || CASE WHEN r_regionkey % 2 = 1 THEN 'annotators=x,y&' ELSE '' END || 'entity_type=biolink:SmallMolecule&name_column=' || r_name || '&provided_id_columns='
            || CASE r_regionkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' ELSE '' END || CASE WHEN r_regionkey > 2 THEN '&vocab=' || r_name ELSE '' END AS query FROM region""",
        "flagship": f"""WITH {_FEATURES_SQL}, {_RESULTS_SQL}, fr AS (SELECT query_name, arg_min(resolved, ord) AS resolved, arg_min(failed, ord) AS failed, arg_min(k, ord) AS k, arg_min(score, ord) AS score FROM r GROUP BY query_name)
            SELECT feature_id, q.name AS query_name, {_LEVEL_SQL} AS match_level, coalesce(hmdb_hint, '') AS hmdb_hint, resolved, CASE WHEN resolved THEN 'C:' || k ELSE '' END AS primary_curie,
            CASE WHEN failed THEN 'unknown' WHEN score >= 2 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS confidence_tier,
            CASE WHEN failed THEN '' ELSE k || ';9' || k END AS chebi_ids, CASE WHEN failed THEN 'not found' ELSE '' END AS error
            FROM f JOIN q ON f.name = q.name JOIN fr ON fr.query_name = q.name""",
    }
