import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storelens.llm import simhash as S
from storelens.llm.components import components


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components_match_union_find(spark, ws):
    rng = random.Random(3)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), ws).collect()}
    want = groups(n, links)
    touched = {x for l in links if l[0] != l[1] for x in l}
    assert got == {i: want[i] for i in touched}
    assert components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


def test_hamming_code_is_perfect():
    assert Counter(S.HOME.tolist()).most_common(1)[0][1] == 8 and len(set(S.HOME.tolist())) == 16
    assert all(bin(v ^ int(h)).count("1") <= 1 for v, h in enumerate(S.HOME))


@pytest.mark.parametrize("coded", [0, 1, 2, 3])
def test_linked_fingerprints_meet_at_a_home(coded):
    rng = random.Random(coded)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        row, key, home = S.anchors(np.array([x, y], np.uint64), coded)
        at = [set(key[row == k].tolist()) for k in (0, 1)]
        assert any(k in at[1] for k in key[(row == 0) & home].tolist())
        assert any(k in at[0] for k in key[(row == 1) & home].tolist())


@pytest.mark.parametrize(("coded", "block"), [(3, 10), (2, 1000), (0, 4)])
def test_near_edges_join_what_all_links_join(spark, ws, monkeypatch, coded, block):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(250):
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            v ^= 1 << b
        values.append(v)
    values = sorted(set(values) | {0, 1, (1 << 64) - 1})
    fps = np.array(values, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(S, "choose_code", lambda n: coded)
    edges = S.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block, workspace=ws).collect()
    place = {f: k for k, f in enumerate(fps)}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    got = [(place[r["a"]], place[r["b"]]) for r in edges]
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in got)
    assert groups(len(values), got) == groups(len(values), pairs)


def _texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(120)) for _ in range(25)]
    near = [t + " tail" for t in base[:10]] + [t.replace("alpha", "ALPHA", 1) for t in base[10:15]]
    return [*base, *near, None, "", " \n", "one", "ONE", "one two three", "É é", base[0], base[0], "x " * 70_000]


def test_groups_match_brute_force(documents, ws):
    texts = _texts()
    fps = [brute_fingerprint(t) for t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_groups(documents(texts), workspace=ws).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


def test_one_of_each_group_stays(spark, documents, ws):
    docs = documents(_texts()).withColumn("fp", F.lit("own")).withColumn("_row", F.lit(1))
    docs = docs.union(docs.where("doc_id in (3, 20)"))
    want = sorted({r["component_id"] for r in S.near_groups(docs, workspace=ws).collect()})
    kept = S.keep_one(docs, workspace=ws)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == want
    assert {r["doc_id"]: r["text"] for r in rows} == {i: _texts()[i] for i in want}
    assert S.keep_one(docs.limit(0), workspace=ws).count() == 0
    assert S.near_groups(docs.limit(0), workspace=ws).count() == 0
    # Without ids one of the equal rows stays still.
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "other words entirely")], "doc_id long, text string")
    assert Counter(r["text"] for r in S.keep_one(nameless, workspace=ws).collect()) == {"a b c": 1, "other words entirely": 1}
