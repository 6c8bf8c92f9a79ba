import random

import pandas as pd
import pytest

from tessera import operators as O
from tessera.sources import feature_table, with_ord

ROWS = [
    (0, "F1", '"glucose_CE10"', None, "MS1"),
    (1, "F2", "glucose", "HMDB:HMDB0000122", "MS2"),
    (2, "F3", None, "HMDB:HMDB0000001", "MS2"),
    (3, "F4", "alanine", "x HMDB0000161 y", None),
    (4, "F5", "glucose", "HMDB:HMDB0000999", "CURATION"),
    (5, None, "alanine", None, "other"),
    (6, "", "glucose", None, "MS2"),
]
DDL = "ord long, feature_id string, matched_name string, ms1_compound_name string, match_level string"


def queue_rows(df, **options):
    return [tuple(r) for r in O.build_queue(df, **options).select("name", "hmdb_hint", "feature_ids", "match_level", "ord").orderBy("ord").collect()]


def test_queue(spark):
    assert queue_rows(spark.createDataFrame(ROWS, DDL)) == [
        ("glucose", "HMDB0000122", ["F1", "F2", "F5"], "MS2", 0),
        ("alanine", "HMDB0000161", ["F4"], None, 3),
    ]


def test_limit_and_compat(spark):
    df = spark.createDataFrame(ROWS, DDL)
    assert len(queue_rows(df, limit=1)) == 1 and queue_rows(df, limit=0) == []
    assert queue_rows(df, compat=True)[1][2] == ["F4", "None"]
    with pytest.raises(ValueError):
        O.build_queue(df, limit=-1)


def test_missing_columns_and_empty(spark):
    df = spark.createDataFrame([(0, "a")], "ord long, matched_name string")
    assert queue_rows(df) == [("a", None, [], None, 0)]
    assert queue_rows(df.drop("matched_name")) == []
    assert queue_rows(spark.createDataFrame([], DDL)) == []


def test_level_priority_against_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(i, f"F{i}", f"n{rng.randint(0, 60)}", None, rng.choice([None, "MS1", "MS2", "CURATION", "?"])) for i in range(1500)]
    order = {"MS2": 3, "MS1": 2, "CURATION": 1}
    want = {}
    for _, _, name, _, level in rows:
        if name not in want or order.get(level, 0) > order.get(want[name], 0):
            want[name] = level
    got = {r[0]: r[3] for r in queue_rows(spark.createDataFrame(rows, DDL).repartition(7))}
    assert got == want


def test_pandas_features_requests_and_join_back(spark):
    table = pd.DataFrame({"feature_id": ["1", "2", "3"], "matched_name": ["a", "a_CE5", float("nan")], "ms1_compound_name": [None, "HMDB:HMDB1", None], "match_level": [float("nan"), "MS1", None]})
    queue = O.build_queue(feature_table(spark, table))
    asked = O.as_requests(queue).collect()
    assert [(r["name"], r["identifiers"]) for r in asked] == [("a", {"HMDB": "HMDB1"})]
    back = O.join_back(queue.select("ord", "name"), queue).orderBy("feature_id").collect()
    assert [(r["feature_id"], r["name"], r["match_level"]) for r in back] == [("1", "a", "MS1"), ("2", "a", "MS1")]


def test_ordinals_are_gapless(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k int").repartition(5)
    rows = with_ord(df, "k").orderBy("ord").collect()
    assert [(r["ord"], r["k"]) for r in rows] == [(i, i) for i in range(101)]
