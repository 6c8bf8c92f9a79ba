import json

from pyspark.sql import functions as F

from tessera import functions as X
from tessera import operators as O
from tessera.schemas import RAW

GOOD = {
    "name": "glucose",
    "curies": ["CHEBI:1", "CHEBI:2"],
    "chosen_kg_id": "CHEBI:1",
    "kg_ids": {"CHEBI:1": ["CHEBI:1"]},
    "assigned_ids": {"a": {"CHEBI": {"1": {"score": 1.2}, "2": {}}, "EMPTY": {}}, "b": {"CHEBI": {"1": {"score": "2.5"}}, "PUBCHEM": {"9": 3}}},
    "error": None,
    "more": [1],
}


def entries(spark, *objects):
    frame = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "ord long, j string")
    return O.from_batch_entry(frame.withColumn("raw", F.from_json("j", RAW)), query_name=F.lit("q")).orderBy("ord").collect()


def test_entry(spark):
    good, unresolved, failed, empty_error = entries(
        spark, GOOD, GOOD | {"curies": []}, GOOD | {"error": "no"}, GOOD | {"error": ""}
    )
    assert (good["resolved"], good["primary_curie"], good["chosen_kg_id"], good["confidence_score"]) == (True, "CHEBI:1", "CHEBI:1", 2.5)
    assert good["identifiers"] == {"CHEBI": ["1", "2", "1"], "PUBCHEM": ["9"]} and good["raw_response"] is None
    assert not unresolved["resolved"] and unresolved["primary_curie"] is None and unresolved["confidence_score"] == 2.5
    assert (failed["error"], failed["resolved"], failed["chosen_kg_id"], failed["identifiers"], failed["confidence_score"]) == ("no", False, None, {}, None)
    assert empty_error["resolved"] and empty_error["error"] is None


def test_sparse_entry(spark):
    (row,) = entries(spark, {})
    assert not row["resolved"] and row["identifiers"] == {} and row["confidence_score"] is None and row["error"] is None


def test_best_score_fold(spark):
    def best(*scores):
        flat = F.array(*[F.struct(F.lit("v").alias("vocab"), F.lit("c").alias("code"), F.lit(json.dumps({"score": s})).alias("meta")) for s in scores])
        return spark.range(1).select(X.best_score(flat)).first()[0]

    assert best(1, 3, 2) == 3 and best(True, 0.5) == 1.0 and best("x") is None and best("1e1", 3) == 10 and best(None, 2) == 2


def test_envelopes(spark):
    cases = [{"result": GOOD, "metadata": {"request_id": "r"}}, {"error": "boom"}, {"error": None}, {"result": None}, {"result": GOOD, "error": "ignored"}]
    frame = spark.createDataFrame([(i, "q", json.dumps(c)) for i, c in enumerate(cases)] + [(9, "q", "{")], "ord long, name string, response string")
    rows = O.from_envelope(frame, hint=F.lit("H")).orderBy("ord").collect()
    assert [r["error"] for r in rows] == [None, "boom", "None", "Empty result from API", None, "Malformed response"]
    assert [r["resolved"] for r in rows] == [True, False, False, False, True, False]
    assert [r["raw_response"] is not None for r in rows] == [True, False, False, True, True, False]
    assert {r["hmdb_hint"] for r in rows} == {"H"}


def test_ndjson(spark):
    lines = [json.dumps(GOOD), "", "  \t", '{"name": "cut', json.dumps({"name": "x"}), json.dumps({"summary": {"n": 1}})]
    frame = spark.createDataFrame(list(enumerate(lines)), "ord long, value string")
    rows = O.from_ndjson(frame).orderBy("ord").collect()
    assert [(r["query_name"], r["resolved"]) for r in rows] == [("glucose", True), ("<unknown>", False), ("x", False), ("", False)]
    assert rows[1]["error"].startswith("Failed to parse NDJSON line: ")
    assert O.from_ndjson(frame, summaries=False).count() == 3


def test_strict_types(spark):
    bad = [{"curies": None}, {"curies": [None]}, {"curies": [1]}, {"name": 5}, {"assigned_ids": []}, {"error": 1}, [1]]
    good = [GOOD, {}, {"curies": []}, {"name": None}]
    frame = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(bad + good)], "ord long, value string")
    rows = O.from_ndjson(frame, strict=True).orderBy("ord").collect()
    assert [r["error"] is not None for r in rows] == [True] * len(bad) + [False] * len(good)


def test_flat_rows(spark):
    frame = spark.createDataFrame(
        [(0, "a", True, "C:1", None, 1.5, {"PUBCHEM": ["7", "8"], "CHEBI": ["1"]}, None, None, None), (1, "b", False, None, None, None, {"PUBCHEM.COMPOUND": ["1"], "PUBCHEM": ["2"]}, "H", "bad", None)],
        "ord long, query_name string, resolved boolean, primary_curie string, chosen_kg_id string, confidence_score double, identifiers map<string,array<string>>, hmdb_hint string, error string, raw_response string",
    )
    one, two = O.flatten(frame).orderBy("query_name").collect()
    assert tuple(one) == ("a", "", True, "C:1", "", 1.5, "medium", "", "7;8", "1", "", "")
    assert tuple(two) == ("b", "H", False, "", "", None, "unknown", "", "1", "", "", "bad")
    row = O.summarize(frame).first().asDict()
    assert row == {"total_queried": 2, "resolved": 1, "unresolved": 1, "errors": 1, "resolution_rate": 0.5}
    assert O.summarize(frame.where("false")).first()["resolution_rate"] == 0.0
    assert {r["vocab"]: r["n"] for r in O.vocabulary_coverage(frame).collect()} == {"PUBCHEM": 2, "CHEBI": 1, "PUBCHEM.COMPOUND": 1}
    assert {r["confidence_tier"]: r["percent"] for r in O.tier_counts(frame).collect()} == {"medium": 50.0, "unknown": 50.0}


def test_catalogs(spark):
    def payload(o):
        return spark.createDataFrame([(json.dumps(o),)], "payload string")

    types = O.entity_types(payload({"entity_types": ["B", "A", "A"], "aliases": {"z": "A", "b": "A", "q": "gone"}})).orderBy("pos").collect()
    assert [(r["type"], r["aliases"]) for r in types] == [("B", []), ("A", ["b", "z"]), ("A", ["b", "z"])]
    assert O.entity_types(payload({})).count() == 0
    assert [tuple(r) for r in O.annotators(payload({"annotators": [{"slug": "s", "name": "n", "count": 3}]})).collect()] == [("s", "n", None)]
    assert [tuple(r) for r in O.vocabularies(payload({"vocabularies": [{"prefix": "P"}, {"prefix": "Q", "aliases": ["q"]}]})).collect()] == [("P", None, []), ("Q", None, ["q"])]
