import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storelens.llm import kneser_ney as K
from storelens.llm.common import table


class Brute:
    """Interpolated modified Kneser-Ney over strings of bytes."""

    def __init__(self, texts, order=K.ORDER):
        self.order = order
        self.c = {order: Counter(g for t in texts for g in self.events(t))}
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.cut = {}
        for k, c in self.c.items():
            n = [sum(x == i for x in c.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.cut[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1 * i), 0.95 * i) if n[i] else 0.5 * i for i in (1, 2, 3)]

    def events(self, text):
        words = text.split()
        s = b"\n\n\n " + b" ".join(words) + b" "
        return [s[i - self.order + 1 : i + 1] for i in range(4, len(s))] if words else []

    def p(self, g):
        lower = self.p(g[1:]) if len(g) > 1 else 1 / K.SYMBOLS
        after = [(x, n) for x, n in self.c[len(g)].items() if x[:-1] == g[:-1]]
        if not after:
            return lower
        cut = lambda n: self.cut[len(g)][min(n, 3) - 1]
        total = sum(n for _, n in after)
        own = self.c[len(g)].get(g)
        return ((own - cut(own) if own else 0) + sum(cut(n) for _, n in after) * lower) / total


def test_model_matches_brute_force(spark, documents, ws):
    good = ["banana band bandana ban", "an can canal", "été à la plage plage plage", "a a a a b"]
    docs = documents([*good, "unseen ünseen zz", "bandanas", None]).withColumn("trusted", F.col("doc_id") < 4)
    counts = ws.keep(K.count_grams(docs))
    grams, contexts = K.smooth(counts.where("trusted > 0").select("key", F.col("trusted").alias("n")), ws)
    got = {r["key"]: r["logp"] for r in K.probabilities(counts, grams, contexts).collect()}
    model = Brute([t.encode() for t in good])
    key = lambda g: int.from_bytes(b"\x01" + g, "big")
    want = {key(g): math.log(model.p(g)) for t in [*good, "unseen ünseen zz", "bandanas"] for g in model.events(t.encode())}
    assert got == pytest.approx(want)
    # The bytes after a context, with all that were not seen, add up to one.
    for context in (b"\x20b", b"an", b"\x20"):
        assert sum(model.p(context + bytes([x])) for x in range(256)) == pytest.approx(1, abs=1 / K.SYMBOLS)


def test_perplexity_and_thresholds_match_brute_force(spark, documents, ws):
    """Whole texts, and quantiles over all trusted documents that don't teach."""
    texts = [f"the {a} sat on a {b} mat" for a in ("cat", "dog", "ox") for b in ("red", "old", "big")] + ["x ox mat  tam", "a", ""]
    langs = ["en"] * 6 + ["fr"] * 3 + ["fr", None, "en"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    docs = documents(texts, lang=langs)
    for limit in (99, 3):
        got = {r["doc_id"]: r for r in K.judge(docs, labels, trusted=limit, workspace=ws).collect()}
        good = docs.join(labels, "doc_id", "left_semi").select("doc_id", "lang")
        taught = {r["doc_id"] for r in K.sample(good, limit).collect()}
        assert 0 < len(taught) <= limit
        model = Brute([texts[i].encode() for i in taught])
        ppl = {}
        for i, t in enumerate(texts):
            events = model.events(t.encode())
            ppl[i] = math.exp(-sum(math.log(model.p(g)) for g in events) / len(events)) if events else None
            assert got[i]["perplexity"] == pytest.approx(ppl[i])
        own = {l: [ppl[i] for i in range(9) if langs[i] == l and i not in taught] for l in ("en", "fr")}
        for i, l in enumerate(langs):
            most = max(own.get(l) or [*own["en"], *own["fr"]])
            assert got[i]["threshold"] == pytest.approx(K.MARGIN * most)
            assert got[i]["kept"] == (ppl[i] is not None and ppl[i] <= got[i]["threshold"])


def test_rare_languages_teach_whole(spark):
    rows = [(i, "en") for i in range(3000)] + [(5000 + i, f"l{i % 4}") for i in range(24)] + [(9000 + i, None) for i in range(6)]
    good = spark.createDataFrame(rows, "doc_id long, lang string")
    every, picked = ({r["doc_id"] for r in K.sample(good, limit).collect()} for limit in (5000, 100))
    assert every == {r["doc_id"] for r in good.where(F.xxhash64("doc_id") < 0).collect()}
    rare = {i for i in every if i >= 5000}
    assert rare and picked < every and rare <= picked and 40 < len(picked) <= 100


def test_units_join_to_the_text():
    for text in (b"a b  cd\tefghij k", b"", b" \n", b"ab", "été à".encode()):
        key, unit = K.grams_of(K.units_of(text))
        assert [int(k).to_bytes(6, "big")[1:] for k in key] == Brute([]).events(text)
        assert len(set(unit.tolist())) == len(text.split())


def test_shuffled_words_are_less_likely(spark, ws):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    mixed = docs.select("doc_id", "lang", F.array_join(F.sort_array(F.split("text", " ")), " ").alias("text"))
    both = docs.select("doc_id", "lang", "text").unionByName(mixed.withColumn("doc_id", F.col("doc_id") + 10_000_000))
    r = K.judge(both, labels, workspace=ws).groupBy((F.col("doc_id") >= 10_000_000).alias("mixed")).agg(F.percentile_approx("perplexity", 0.5).alias("p")).collect()
    p = {x["mixed"]: x["p"] for x in r}
    assert p[True] > p[False] * 1.05


def test_short_head_gives_the_same_result(spark, ws, monkeypatch):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    whole = {r["doc_id"]: r["perplexity"] for r in K.judge(docs, labels, workspace=ws).collect()}
    monkeypatch.setattr(K, "HEAD", 300)
    part = {r["doc_id"]: r["perplexity"] for r in K.judge(docs, labels, workspace=ws).collect()}
    assert whole == pytest.approx(part)


def test_keeps_good_text_and_drops_noise(spark, ws):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = K.judge(docs, labels, workspace=ws).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.2


def test_edge_cases(spark, documents, ws):
    text = "some plain words that are here for the model to learn from "
    texts = [text] * 6 + [None, "", " ", text, text, text * 3000, "#!%& ]]>> \x01\x02\x03 qqqq" * 9]
    langs = ["en"] * 8 + [None] * 3 + ["xx", "xx"]
    docs = documents(texts, lang=langs).withColumn("events", F.lit("x")).withColumn("trusted", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(5, 1, 1), (0, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in K.judge(docs, labels, workspace=ws).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["perplexity"] is None and not got[i]["kept"] for i in (6, 7, 8))
    assert all(got[i]["kept"] for i in (*range(6), 9, 10, 11)) and not got[12]["kept"]
    assert got[9]["perplexity"] == got[10]["perplexity"]
    # Each repetition after the second adds the same.
    taught = K.sample(spark.createDataFrame([(i, "en") for i in range(5)], "doc_id long, lang string"), 99).count()
    model = Brute([text.encode()] * taught)
    one, two, three = (sum(math.log(model.p(g)) for g in model.events(text.encode() * k)) for k in (1, 2, 3))
    assert got[9]["log_prob"] == pytest.approx(one) and got[11]["log_prob"] == pytest.approx(two + 2998 * (three - two))
    none = K.judge(docs, labels.limit(0), workspace=ws).collect()
    assert all(r["threshold"] is None and r["kept"] == (r["perplexity"] is not None) for r in none)
    assert K.judge(docs.limit(0), labels, workspace=ws).count() == 0


def test_the_whole_half_teaches(spark, documents, ws):
    """More documents than any former bound of 20,000 that may teach."""
    n = 45_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 97).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = docs.where(F.xxhash64("doc_id") < 0)
    assert half.count() > 20_000
    got = {r["text"]: r["log_prob"] for r in K.judge(docs, labels, workspace=ws).join(docs, "doc_id").select("text", "log_prob").distinct().collect()}
    model = Brute([r["text"].encode() for r in half.collect()])
    for text in ("w0", "w42", "w96"):
        assert got[text] == pytest.approx(sum(math.log(model.p(g)) for g in model.events(text.encode())), rel=1e-9)


def test_blocks_and_batches_give_the_same_grams(monkeypatch):
    texts = ["a b  cd\tefghij k", None, "", " \n", "  été\x85 à", "x" * 50, "a  ", "\x0b"]
    want = [(k, i) for i, t in enumerate(texts) for k in K.grams_of(K.units_of((t or "").encode()))[0].tolist()]
    assert [(k, i) for key, text in K.grams_in(texts) for k, i in zip(key.tolist(), text.tolist(), strict=True)] == want
    monkeypatch.setattr(K, "BLOCK", 7)
    for i, t in enumerate(texts):
        assert [k for key, _ in K.grams_in([t]) for k in key.tolist()] == [k for k, j in want if j == i]
    assert list(K.grams_in([])) == [] or all(not len(k) for k, _ in K.grams_in([]))
