import re
import zlib

import duckdb
import pytest

from tessera.llm import quality_rules as Q
from tessera.llm import sharding as S
from tessera.llm.queries import oracle_sql, queries
from tests.llm.conftest import ODD


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def test_op10_equals_its_oracle(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(oracle_sql()["op10_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries()["op10_quality_rules"](spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_metrics_of_odd_rows(spark, odd, none):
    more = ["a b c a b c a b c", "x y z\nx y z\n \nx y z", "\x0b\x0c\r", "a a a a", " lead # $ and <trail> ", "a\xa0b c"]
    extra = spark.createDataFrame([(100 + i, t, "en", "s0", 7, "c") for i, t in enumerate(more)], odd.schema)
    for r in Q.assess(odd.unionByName(extra)).collect():
        text = None if r["doc_id"] is not None and r["doc_id"] < 100 and ODD[r["doc_id"]] is None else r["text"]
        assert tuple(r[c] for c in Q.METRICS) == brute(text), r["doc_id"]
    assert Q.assess(none).count() == 0 and Q.filter_documents(odd).columns == odd.columns


def test_bad_hosts_take_their_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(200)] + [(200 + i, good if i % 10 == 0 else "short", "bad") for i in range(200)] + [(400, "short", "new"), (401, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in Q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(200, 400)) and kept[1] and not kept[0] and kept[401]


@pytest.mark.parametrize(("hosts", "low", "high"), [([(100, 10), (100, 10), (100, 10)], 0.09, 0.11), ([(1000, 0), (1000, 900)], 0.2, 0.6), ([], 0.5, 0.5)])
def test_prior_mean(hosts, low, high):
    alpha, beta = Q.beta_prior(sum(n for n, _ in hosts), sum(f for _, f in hosts), len(hosts), sum(f * f / n for n, f in hosts))
    assert low <= alpha / (alpha + beta) <= high and alpha > 0 or not hosts


def test_salted_lookup_equals_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import common

    big = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"))
    small = common.materialize(spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")), "test")
    want = sorted(map(str, common.join_lookup(big, small, "k", F.col("id")).select("id", "k", "v").collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, common.join_lookup(big, small, "k", F.col("id")).select("id", "k", "v").collect())) == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1023])
def test_permutation(n):
    assert sorted(S.permute(i, n, 5) for i in range(n)) == list(range(n))


def test_op5(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries()["op5_sharding"](spark, small).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for i, r in enumerate(rows):
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        assert r["slot"] * 8 + r["shard"] == S.permute(i, len(rows), 20240817)
    counts = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k])) for k in range(8))


def test_sharding_of_odd_rows(spark, odd, none):
    rows = S.assign_shards(odd, shards=3).collect()
    assert len(rows) == odd.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}[0] == (1, 0)
    assert S.assign_shards(none).count() == 0
