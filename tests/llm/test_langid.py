import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import langid as L
from storelens.llm.common import table


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = L.Network.new(3, 4, rng)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    mask = np.ones((7, 5))
    mask[4:, 2] = 0
    truth = np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(data, mask, truth)
    for name, p in net.params.items():
        flat = p.reshape(-1)
        picks = rng.choice(flat.size, min(12, flat.size), replace=False)
        if name.startswith("x"):
            picks = [int(data[t, r]) * p.shape[1] + c for t, r, c in [(0, 0, 1), (3, 4, 7), (6, 1, 11)]]
        for i in picks:
            was = flat[i]
            flat[i] = was + 1e-4
            up = net.gradients(data, mask, truth)[0]
            flat[i] = was - 1e-4
            down = net.gradients(data, mask, truth)[0]
            flat[i] = was
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_segments_hold_all_bytes():
    for n in (0, 1, L.SEGMENT, L.SEGMENT + 1, 5 * L.SEGMENT - 3):
        data, lengths = L.segments("x" * n)
        assert lengths.sum() == n and (data > 0).sum() == n
    assert L.segments("é")[1].tolist() == [2]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_edge_cases(documents):
    english, german = "the thing with this and that ", "der die das und nicht eine "
    texts = [english * 20, german * 20] * 12 + [None, "", "123 !?", "²½ _", "é", english, english, german * 4000]
    langs = ["en", "de"] * 12 + [None] * 8
    docs = documents(texts, lang=langs).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs).collect()}
    assert len(got) == len(texts)
    assert all(got[i] == ("und", 0.0) for i in (24, 25, 26, 27))
    assert got[28][0] in ("en", "de") and got[29] == got[30] and got[29][0] == "en" and got[31][0] == "de"
    assert all(got[i][0] == langs[i] for i in range(24))


def test_nothing_to_learn_and_empty_table(documents):
    got = L.identify(documents(["some text", None], lang=[None, None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert L.identify(documents(["x"]).limit(0)).count() == 0


def test_more_languages_than_are_learned(documents):
    texts = [w * 6 for w in ("aaa bbb ", "ccc ddd ", "eee fff ", "ggg hhh ")] * 8
    langs = ["p", "q", "r", "s"] * 8
    docs = documents(texts + ["aaa bbb aaa"], lang=langs + ["z"])
    model = L.train(docs.where("lang IS NOT NULL"), most=3)
    assert model[0] == ["p", "q", "r"]  # of equally frequent ones the first
    got = L.predict(docs.withColumn("held_out", F.lit(False)), model).collect()
    assert {r["lang_pred"] for r in got} <= {"p", "q", "r"} and len(got) == 33
    many = documents([f"text {i}" for i in range(60)], lang=[f"l{i:02d}" for i in range(60)])
    few = L.train(many, most=7)
    assert len(few[0]) == 7 and len(L.predict(many.withColumn("held_out", F.lit(True)), few).collect()) == 60


def test_training_sees_the_same_segments_cut_early_or_late(documents):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc dé"), rng.integers(1, 900))) + "a" for _ in range(20)]
    labels = [i % 2 for i in range(20)]
    whole = L.fit(texts, labels, 2, steps=3)
    cut = [L.picked_segments(t) for t in texts]
    again = L.fit_segments(np.concatenate([d for d, _ in cut]), np.concatenate([n for _, n in cut]), np.repeat(labels, [len(n) for _, n in cut]), 2, steps=3)
    assert all((whole.params[k] == again.params[k]).all() for k in whole.params)


def test_predictions_equal_a_plain_walk_over_bytes(documents):
    """One byte at a time, one document at a time, in double precision."""
    english, german = "the thing with this and that ", "der die das und nicht eine "
    texts = [english * 9, german * 9] * 6 + ["é the", english * 40 + german, "x"]
    docs = documents(texts, lang=["en", "de"] * 6 + [None] * 3).withColumn("held_out", F.lit(False))
    model = L.train(docs.where("lang IS NOT NULL"))
    p = {k: v.astype(np.float64) for k, v in model[1].params.items()}
    n = model[1].hidden
    soft = lambda v: v / (1 + np.abs(v))

    def states(raw, d):
        h, out = np.zeros(n), []
        for byte in raw if d == "f" else raw[::-1]:
            a, r = p[f"x{d}"][byte], h @ p[f"u{d}"] + p[f"c{d}"]
            z, reset = (0.5 + 0.5 * soft(a[k * n : (k + 1) * n] + r[k * n : (k + 1) * n]) for k in (0, 1))
            h = z * h + (1 - z) * soft(a[2 * n :] + reset * r[2 * n :])
            out.append(h)
        return out if d == "f" else out[::-1]

    for r in L.predict(docs, model).collect():
        raw = texts[r["doc_id"]].encode()
        total = np.zeros(2)
        for at in range(0, len(raw), L.SEGMENT):
            part = raw[at : at + L.SEGMENT]
            for f, b in zip(states(part, "f"), states(part, "b"), strict=True):
                y = np.concatenate([f, b]) @ p["o"] + p["oc"]
                y = np.exp(y - y.max())
                total += y / y.sum()
        share = total / len(raw)
        assert r["lang_pred"] == model[0][int(share.argmax())] and r["score"] == pytest.approx(share.max(), abs=2e-4)
