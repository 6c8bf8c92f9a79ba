import random
import re
from collections import defaultdict

import numpy as np

from tessera.llm import near_dedup as N
from tessera.llm.components import components, extend
from tessera.llm.queries import queries
from tests.llm.conftest import prose


def brute(docs):
    """Sets and component ids by comparing all pairs of different sets."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))) if words else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = defaultdict(list)
    for i, s in sets.items():
        if s:
            groups[s].append(i)
    for ids in groups.values():
        for i in ids:
            a, b = find(ids[0]), find(i)
            root[max(a, b)] = min(a, b)
    distinct = list(groups)
    for x, s in enumerate(distinct):
        for t in distinct[:x]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(groups[s][0]), find(groups[t][0])
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def run(spark, docs, **schema):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.find_duplicates(frame).collect()}


def test_against_all_pairs(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op1_near_dedup"](spark, small).collect()
    want = brute(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_planted_copies_around_the_threshold(spark):
    rng, docs = random.Random(1), []
    for g in range(60):
        words = prose(rng.randint(30, 300), 100 + g).split()
        docs.append((len(docs), " ".join(words)))
        for _ in range(rng.randint(0, 6)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                own[rng.randrange(len(own))] = "w" + str(rng.random())
            docs.append((len(docs), " ".join(own).upper() if rng.random() < 0.2 else " ".join(own)))
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_large_groups_and_a_shared_passage(spark):
    rng, docs = random.Random(2), []
    base, passage = prose(120, 5).split(), prose(60, 6)
    docs += [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 400):
        own = list(base)
        own[rng.randrange(120)] = f"e{i}"
        docs.append((i, " ".join(own)))
    docs += [(i, prose(40, 1000 + i) + " " + passage) for i in range(400, 600)]
    assert run(spark, docs) == brute(docs)


def test_links_in_a_crowd_that_shares_a_passage(spark):
    rng, passage, docs, pairs = random.Random(9), prose(150, 8), [], []
    for g in range(350):
        own = prose(30, 5000 + g).split()
        docs.append((len(docs), f"{passage} " + " ".join(own)))
        if g % 4 == 0:
            docs.append((len(docs), f"{passage} " + " ".join([*own[:6], *prose(24, 9000 + g).split()])))
            pairs.append((len(docs) - 2, len(docs) - 1))
    sets = {i: N.shingles(t) for i, t in docs}
    pairs = [p for p in pairs if N.linked(sets[p[0]], sets[p[1]])]
    found = run(spark, rng.sample(docs, len(docs)))
    assert len(pairs) > 80 and [p for p in pairs if found[p[0]][1] != found[p[1]][1]] == []


def test_links_of_an_open_region_are_all_found(spark, monkeypatch):
    """Rows of two regions, in many cells: the links join what links of all pairs would join, and few more rows are made."""
    monkeypatch.setattr(N, "CELL", 150)
    rng, base = random.Random(4), prose(60, 77).split()
    texts = {}
    for i in range(700):
        own = [*base, *prose(40, i if i % 5 else i % 50).split()]
        texts[i] = " ".join(own)
    sets = {i: N.shingles(t) for i, t in texts.items()}
    sketches = {i: np.packbits((N.signature(s) & 1).astype(np.uint8)).tobytes() for i, s in sets.items()}
    rows = [(7, i, len(sets[i]), -1 if i < 200 else i, bytearray(sketches[i])) for i in texts] + [(8, i, len(sets[i]), i, bytearray(sketches[i])) for i in range(4)]
    labelled = spark.createDataFrame(rows, "region long, id long, n long, c long, sketch binary")
    assert [r["region"] for r in N.open_regions(labelled).collect()] == [7]
    found = [tuple(r) for r in N.crowded_links(labelled, spark.createDataFrame(list(texts.items()), "id long, text string")).collect()]
    assert all(a < b and N.linked(sets[a], sets[b]) for a, b in found)

    def parts(links):
        root = {i: min(i, 0) if i >= 200 else 0 for i in texts} | {i: i for i in texts if i >= 200}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in texts}

    every = [(a, b) for a in texts for b in range(a) if N.linked(sets[a], sets[b])]
    assert parts(found) == parts(every) and len(found) < len(every)


def test_a_crowd_of_many_pairs_equals_all_pairs(spark):
    """900 documents that share a passage of 300 words, in pairs: what 0.75 links is found, and nothing else."""
    passage, docs = prose(300, 8), []
    for g in range(450):
        own = prose(80, 5000 + g).split()
        docs.append((2 * g, f"{passage} {' '.join(own)}"))
        docs.append((2 * g + 1, f"{passage} {' '.join([*own[:55], *prose(25, 90_000 + g).split()])}"))
    assert run(spark, random.Random(3).sample(docs, len(docs))) == brute(docs)


def test_rows_of_one_id_belong_together(spark):
    a, b, c = prose(50, 1), prose(50, 2), prose(50, 3)
    rows = [(2, a), (5, a), (5, b), (5, b), (7, b), (8, c), (9, c), (9, None), (4, None), (4, "")]
    found = N.find_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in found) == sorted(
        [(2, 2, True, 46), (5, 2, False, 46), (5, 2, False, 46), (5, 2, False, 46), (7, 2, False, 46), (8, 8, True, 46), (9, 8, False, 46), (9, 8, False, 0), (4, 4, True, 0), (4, 4, True, 0)]
    )
    kept = N.filter_documents(spark.createDataFrame([*rows, (8, b)], "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 4]


def test_odd_rows(spark, odd, none):
    rows = N.find_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert [by_id[i]["n_shingles"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(by_id[i]["component_id"] == i for i in (0, 1, 2, 3, 4, 5))
    assert by_id[8]["component_id"] == 7 and not by_id[8]["kept"] and sum(r["doc_id"] == 7 for r in rows) == 3
    assert N.find_duplicates(none).count() == 0
    kept = N.filter_documents(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(None) == 1 and N.filter_documents(none).count() == 0


def test_regions_meet_across_partition_borders():
    rows = [{"pid": 0, "kind": 3, "region": 5, "hub": 1}, {"pid": 0, "kind": 4, "region": 9, "hub": 2}, {"pid": 3, "kind": 3, "region": 9, "hub": 7}, {"pid": 3, "kind": 4, "region": 9, "hub": 6}]
    assert set(N.stitch(rows)) == {(7, 2), (6, 2)}
    assert N.stitch([dict(r, region=r["pid"]) for r in rows]) == []
    ends = [{"pid": 0, "end": 1, "region": 9, "a": 2, "b": 10, "c": 2, "members": 1, "sketch": b"a"}, {"pid": 1, "end": 0, "region": 9, "a": 7, "b": 10, "c": 7, "members": 1, "sketch": b"a"}, {"pid": 1, "end": 0, "region": 9, "a": 8, "b": 10, "c": 8, "members": 1, "sketch": b"a"}]
    assert N.meet_borders(ends) == [(2, 7), (2, 8)]


def test_rows_made_grow_with_the_rows():
    def pairs(rows):
        near = N.Neighbours()
        return [p for r in rows for p in near.add(r)] + list(near.end())

    made = pairs((i, 50, i, 1, 0) for i in range(3000))
    assert 0 < len(made) <= 3000 * N.NEAR
    assert pairs((i, 50, 0, 100, 0) for i in range(100)) == []
    group = [(i, 50, 0, 300, (1 << (i % 9)) - 1) for i in range(300)]
    one = (1000, 50, 1000, 1, (1 << 128) - 1)
    assert pairs([*group[:150], one, *group[150:]]) == []
    asked = pairs([*group[:150], (*one[:4], 0), *group[150:]])
    assert len(asked) == N.BEST and {a % 9 for a, _ in asked} == {0}
    hubs = N.Hubs()
    assert list(hubs.add(np.array([5, 3, 9]))) == [(5, 3), (3, 3), (9, 3)] and list(hubs.add(np.array([1, 4]))) == [(3, 1), (1, 1), (4, 1)]


def test_signature_estimates_similarity():
    a, b = prose(400, 1).split(), prose(400, 1).split()
    b[::40] = [f"q{i}" for i in range(10)]
    sa, sb = N.shingles(" ".join(a)), N.shingles(" ".join(b))
    true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
    assert abs((N.signature(sa) == N.signature(sb)).mean() - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_extended_equal_those_of_all_links(spark):
    rng = random.Random(7)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    frames = [spark.createDataFrame(x, "a long, b long") for x in (links[:60], links[60:], [])]
    labels = components(frames[0])
    for more in (frames[1], frames[2]):
        labels = extend(labels, more)
    want = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {r["v"]: r["c"] for r in labels.collect()} == want
    assert extend(components(frames[2]), frames[2]).count() == 0
