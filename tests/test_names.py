import random
import re

import pytest

from tessera import functions as X

NAMES = [
    ('"N-Ethyl, mixed_CE7"', "N-Ethyl, mixed"),
    ("acid_CE102030", "acid"),
    ("acid_CE1_2_3", "acid"),
    ("X_CE", "X_CE"),
    ("X_ce45", "X_ce45"),
    ("X_CE_", "X"),
    ("_CE45", None),
    ("", None),
    ('" "', None),
    ('""', None),
    ('"', '"'),
    ('""X""', '"X"'),
    ('"X"_CE45', '"X"'),
    ('"X_CE45 "', "X_CE45"),
    ("\t X \n", "X"),
    ("\x1cX\x1f", "X"),
    ("X_CE٤٥", "X"),
    ("X_CE4\nY", "X_CE4\nY"),
    (None, None),
]
IDS = [
    ("HMDB:HMDB3 x", "HMDB3"),
    ("a HMDB00177 b", "HMDB00177"),
    ("HMDB0000177", "HMDB0000177"),
    ("HMDB1234", None),
    ("HMDB12345678", None),
    ("xHMDB00177", None),
    ("HMDB00177_x", None),
    ("éHMDB00177", None),
    ("HMDB99999 HMDB:HMDB1", "HMDB1"),
    ("", None),
    (None, None),
]


def column(spark, values, make):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r["x"] for r in frame.select("i", make("s").alias("x")).orderBy("i").collect()]


def test_clean_name(spark):
    assert column(spark, [a for a, _ in NAMES], X.clean_name) == [b for _, b in NAMES]


def test_extract_id(spark):
    assert column(spark, [a for a, _ in IDS], X.extract_id) == [b for _, b in IDS]


def spec(s):
    """The rules once more, in plain Python."""
    s = s.strip()
    if not s:
        return None
    if len(s) >= 2 and s[0] == s[-1] == '"':
        s = s[1:-1]
    return re.sub(r"_CE[\d_]+$", "", s).strip() or None


def test_clean_name_on_random_texts(spark):
    rng = random.Random(5)
    parts = ['"', " ", "_CE", "4", "_", "X", "\n", " ", "\x1d", "HMDB", "٤"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(4000)]
    assert column(spark, texts, X.clean_name) == [spec(t) for t in texts]


def test_extract_id_on_random_texts(spark):
    rng = random.Random(6)
    parts = ["HMDB", "HMDB:", "HMDB12345", "12345", "0", " ", " ", "_", "x", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(4000)]

    def want(t):
        m = re.search(r"HMDB:(HMDB\d+)", t) or re.search(r"\b(HMDB\d{5,7})\b", t)
        return m and m[1]

    got = column(spark, texts, X.extract_id)
    assert got == [want(t) for t in texts] and sum(x is not None for x in got) > 100


def test_sql_functions_agree(spark):
    X.register_functions(spark)
    spark.createDataFrame(list(enumerate(a for a, _ in NAMES)), "i int, s string").createOrReplaceTempView("names")
    assert [r[0] for r in spark.sql("SELECT clean_name(s) FROM names ORDER BY i").collect()] == [b for _, b in NAMES]
    row = spark.sql("SELECT extract_id('HMDB:HMDB3'), confidence_tier(double('NaN')), confidence_tier(NULL), ids_for(map('A', array('1')), 'A'), ids_for(map('A', array('1')), 'B')").first()
    assert list(row) == ["HMDB3", "low", "unknown", ["1"], []]


@pytest.mark.parametrize(("score", "tier"), [(2.5, "high"), (2.0, "high"), (1.5, "medium"), (1.0, "medium"), (0.9, "low"), (None, "unknown"), (float("nan"), "low")])
def test_tier(spark, score, tier):
    assert spark.createDataFrame([(score,)], "x double").select(X.confidence_tier("x")).first()[0] == tier
