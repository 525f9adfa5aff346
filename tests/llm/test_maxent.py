import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import maxent as M
from storelens.llm.common import table


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\n"]


def base(texts, ids):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids]
    c = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for t, h in zip(texts, held, strict=True):
        w = tokens(t)
        out.append((h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


TEXTS = [None, "", " \t ", "Hello HELLO hello\x0bWorld", "É é unseen", *[f"the cat {i % 7} sat on the mat {i % 5} and word{i}" for i in range(80)], "the " * 30_000]


@pytest.mark.parametrize("head", [1 << 18, 16])
def test_counts_and_base_match_brute_force(documents, ws, monkeypatch, head):
    """Also where most words lie outside the broadcast head."""
    monkeypatch.setattr(M, "HEAD", head)
    texts = [*TEXTS, TEXTS[10], TEXTS[10]]
    docs = documents(texts).withColumn("n", F.lit("x")).withColumn("held", F.lit(1)).withColumn("score", F.lit(2))
    got = {r["doc_id"]: r for r in M.score(docs, workspace=ws).collect()}
    want = base(texts, range(len(texts)))
    assert len(got) == len(texts)
    for i, (held, n, known, total, score) in enumerate(want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert -math.inf < r["score"] < 0


def test_head_size_does_not_change_scores(documents, ws, monkeypatch):
    docs = documents(TEXTS)
    whole = {r["doc_id"]: r["score"] for r in M.score(docs, workspace=ws).collect()}
    monkeypatch.setattr(M, "HEAD", 600)
    monkeypatch.setattr(M, "OWN_CODE", 8)
    one = {r["doc_id"]: r["score"] for r in M.score(docs, workspace=ws).collect()}
    monkeypatch.setattr(M, "HEAD", 40)
    two = {r["doc_id"]: r["score"] for r in M.score(docs, workspace=ws).collect()}
    assert one == pytest.approx(two, rel=1e-9) and set(one) == set(whole)


def _small_model(weights):
    rng = np.random.default_rng(0)
    code_types = rng.integers(0, 4, M.CODES).astype(float)
    code_n = code_types * rng.integers(1, 9, M.CODES)
    return M.Model(int(code_n.sum()), int(code_types.sum()), np.empty(0, np.int64), np.empty(0, np.int64), True, {}, code_n, code_types, weights)


def test_probabilities_of_all_codes_add_up_to_one():
    rng = np.random.default_rng(1)
    model = _small_model(rng.normal(0, 0.7, (M.ROWS, M.MEMBERS)).astype(np.float32))
    for history in ([], [5], [5, 1000]):
        total = 0.0
        for code in range(M.CODES):
            codes = np.array([*history, code])
            total += 10 ** M.log_probabilities(model, codes, np.array([0]))[-1]
        assert total == pytest.approx(1, abs=1e-4)


def test_gradient_matches_a_sum_over_tokens():
    rng = np.random.default_rng(2)
    model = _small_model(rng.normal(0, 0.3, (M.ROWS, M.MEMBERS)).astype(np.float32))
    codes, starts = rng.integers(0, 40, 500), np.array([0, 100, 101, 350])
    total = M.Gradient(model)
    total.add(codes[:350], starts[:3])
    total.add(codes[350:], np.array([0]))
    total.flush()
    seen, expected = np.zeros_like(total.expected), np.zeros_like(total.expected)
    one, two = M._contexts(codes, starts)
    first, second = model.prior
    for a, b, c in zip(one, two, codes, strict=True):
        for node, prior, outcome in ((0, first, c // M.MEMBERS), (1 + c // M.MEMBERS, second[c // M.MEMBERS], c % M.MEMBERS)):
            rows = M._rows(np.array([a]), np.array([b]), node)
            p = M._softmax(model.weights, rows, prior)[0]
            for r in rows[:, 0]:
                seen[r, outcome] += 1
                expected[r] += p
    assert np.array_equal(total.seen.reshape(seen.shape), seen)
    assert np.allclose(total.expected, expected, atol=1e-4)


def test_a_portion_is_stored_and_learnt_from_in_small_rows(spark, documents, ws, monkeypatch):
    """Else a task holds millions of triples at once, several times over."""
    monkeypatch.setattr(M, "ROW", 100)
    docs = documents([f"w{i % 31} w{i % 37} w{i % 41} w{i}" for i in range(600)]).withColumn("held", F.lit(False))
    own = {}
    found = [(np.frombuffer(r["triple"], np.int32), np.frombuffer(r["times"], np.int32)) for r in M.gather(docs.coalesce(1), own).collect()]
    assert len(found) > 5 and max(len(t) for t, _ in found) <= 100
    assert all(len(t) == len(n) for t, n in found) and sum(n.sum() for _, n in found) == 5 * 600
    # One update over small rows is the update over whole portions, and the session's setting is as before.
    model, before = _small_model(np.zeros((M.ROWS, M.MEMBERS), np.float32)), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cut = M.update(ws.keep(M.gather(docs, own)), model)
    monkeypatch.setattr(M, "ROW", 1 << 20)
    assert np.abs(cut).max() > 0.01 and np.allclose(cut, M.update(ws.keep(M.gather(docs, own)), model), atol=1e-2)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_an_update_raises_the_likelihood_of_held_out_text(spark, ws):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    r = M.score(docs, workspace=ws).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.15


def test_empty_table_and_nothing_to_learn_from(spark, documents, ws):
    assert M.score(documents(["x"]).limit(0), workspace=ws).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = M.score(spark.createDataFrame([(held, "a b"), (None, "c")], "doc_id long, text string"), workspace=ws).collect()
    assert [(r["held_out"], r["train_tokens"], r["n_known"]) for r in rows] == [(True, 0, 0)] * 2
    # One possible outcome, the unknown word, is certain.
    assert all(r["base_score"] == pytest.approx(0) for r in rows)
