import corpus_pipeline as P

from tessera.llm.common import materialize
from tessera.llm.near_dedup import find_duplicates
from tests.llm.test_near_dedup import brute as brute_duplicates
from tests.llm.test_rules import brute as brute_rules


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    stage = dict(P.STAGES)
    known = materialize(stage["language"](spark, docs, small), "t")
    assert known.columns == columns and known.count() == docs.count()
    passed = materialize(stage["quality"](spark, known, small), "t")
    want = {r["doc_id"] for r in known.collect() if not brute_rules(r["text"])[-1]}
    assert passed.columns == columns and {r["doc_id"] for r in passed.collect()} == want
    single = materialize(stage["near_dedup"](spark, passed, small), "t")
    want = {i for i, (_, c) in brute_duplicates([(r["doc_id"], r["text"]) for r in passed.collect()]).items() if c == i}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want
    packed = stage["packing"](spark, single, small)
    assert {r["doc_id"] for r in packed.collect()} == want


def test_odd_rows_go_through(spark, odd, none):
    for docs in (odd, none):
        for _, stage in P.STAGES:
            docs = materialize(stage(spark, docs, ""), "t")
        assert docs.columns[:2] == ["doc_id", "piece"]
    assert find_duplicates(none).count() == 0
