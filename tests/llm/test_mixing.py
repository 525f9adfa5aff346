import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storelens.llm import mixing as M


def fill(sizes, weights=M.WEIGHTS, budget=1.5, passes=2.0):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    limit = {s: passes * sizes[s] for s in names}
    capped, left = set(), budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > limit[s]]
        if not over:
            return {s: limit[s] if s in capped else w[s] * level for s in names}
        for s in over:
            capped.add(s)
            left -= limit[s]


def test_targets_match_resharing(spark):
    for sizes in ({"a": 100, "b": 50, "c": 1000}, {"a": 10, "Z": 10, None: 10, "é": 5000, "😀": 3}, {"x": 0, "y": 5}, {"only": 7}):
        rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
        got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert got == pytest.approx(fill(sizes))


def _docs(documents):
    texts = [" ".join(f"t{i}_{j}" for j in range(1 + i * 37 % 90)) for i in range(300)]
    sources = [None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}" for i in range(300)]
    texts[7], texts[8], texts[9] = None, "", " \n"
    return documents(texts, source=sources), texts, sources


def test_plan(documents):
    docs, texts, sources = _docs(documents)
    docs = docs.union(docs.where("doc_id = 12"))
    rows = M.plan(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    total = Counter()
    for i in [*range(300), 12]:
        total[sources[i]] += size[i]
    want = fill(total)
    taken = Counter()
    assert len(rows) == 301
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert rows and sorted(map(str, rows)) == sorted(map(str, M.plan(docs.repartition(5)).collect()))


def test_positions_invert_the_schedule(documents):
    """At any moment a source has supplied the integral of its schedule."""
    docs, _, _ = _docs(documents)
    supplied, target = defaultdict(list), {}
    for r in M.plan(docs).collect():
        target[r["source"]] = r["target"]
        supplied[r["source"]] += [(c["position"], c["words"]) for c in r["copies"]]
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(sorted(x for x in target if x is not None))} | {None: M.WEIGHTS[(len(target) - 1) % 3]}
    for s, copies in supplied.items():
        schedule = M.SCHEDULES[weight[s]]
        whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False))
        assert all(0 <= p <= 1 for p, _ in copies)
        for moment in (0.2, 0.5, 0.8):
            area = 0.0
            for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
                x = min(max(moment - t0, 0), t1 - t0)
                area += a * x + (b - a) / (t1 - t0) * x * x / 2
            assert abs(sum(n for p, n in copies if p <= moment) - target[s] * area / whole) <= 100


def test_curriculum(documents):
    docs, texts, _ = _docs(documents)
    docs = docs.withColumn("target", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("_row", F.lit(2))
    planned = {r["doc_id"]: [c["words"] for c in r["copies"]] for r in M.plan(docs).collect()}
    out = M.curriculum(docs)
    assert out.columns == docs.columns
    found = defaultdict(list)
    for r in out.collect():
        n = len(r["text"].split())
        found[r["doc_id"]].append(n)
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in planned.items() if v}


def test_empty_and_wordless(documents):
    docs, _, _ = _docs(documents)
    assert M.plan(docs.limit(0)).count() == 0 and M.curriculum(docs.limit(0)).count() == 0
    rows = M.plan(documents([None, "", " "])).collect()
    assert [(r["size"], r["taken"], r["copies"], r["position"]) for r in rows] == [(0, 0, [], None)] * 3
