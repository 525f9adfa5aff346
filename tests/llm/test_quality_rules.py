import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storelens.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by brute force."""
    text = text or ""
    w = re.findall(WORD, text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z x y z x y", "a b a b a b a",
    "one\ntwo\none\n\n \none ", "# * $ <&> | %", "été été été été 中文   x", "a b c d\x0be\x0cf a b c", "  lead and trail  ",
    "\n".join(["same line here"] * 5), " ".join(map(str, range(3000))) + " 1 2 3", "😀 😀 😀 😀",
]


def test_statistics_match_brute_force(documents):
    got = Q.text_statistics(documents(TEXTS)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        found = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
        assert found == counts(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def _labelled(spark, documents):
    clean = [" ".join(f"w{(i * 7 + j * 13) % 997}" for j in range(80)) for i in range(60)]
    noisy = [" ".join(f"w{(i * 5 + j * 11) % 991}$$$" for j in range(80)) for i in range(30)]
    docs = documents(clean + noisy)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 90)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learned_list_rejects_the_bad_and_keeps_the_good(spark, documents, ws):
    docs, labels = _labelled(spark, documents)
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels, workspace=ws).collect()}
    assert got == {i: i < 60 for i in range(90)}
    rules = Q.learn_rules(Q.text_statistics(docs), labels, workspace=ws)
    assert rules and all(r.conditions and r.covered_good == 0 for r in rules)


def test_rules_apply_in_order(documents):
    one = Q.Rule((Q.Condition("mean_word", True, 1, 3.0),), 1, 0)
    two = Q.Rule((Q.Condition("symbols_per_word", True, 1, 0.5), Q.Condition("mean_word", False, 1, 9.0)), 1, 0)
    stats = Q.text_statistics(documents(["aaaa bbbb", "a $", "a b", None]))
    assert [r["v"] for r in stats.withColumn("v", Q.verdict([one, two])).orderBy("doc_id").collect()] == [1, 2, None, None]


@pytest.mark.parametrize("case", ["none", "one class", "null labels", "unknown ids"])
def test_without_both_classes_only_the_base_checks_reject(spark, documents, ws, case):
    rows = {"none": [], "one class": [(0, 1)], "null labels": [(0, None), (1, None)], "unknown ids": [(77, 0), (78, 1)]}[case]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    docs = documents([" ".join(map(str, range(60))), "short"])
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels, workspace=ws).collect()}
    assert got == {0: True, 1: False}


def test_empty_table_and_clashing_columns(spark, documents, ws):
    docs, labels = _labelled(spark, documents)
    assert Q.judge(docs.limit(0), labels, workspace=ws).count() == 0
    more = docs.withColumn("n_words", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("rule", F.lit(2.0))
    kept = Q.keep_good(more.union(more.where("doc_id = 3")), labels, workspace=ws)
    assert kept.columns == more.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*range(60), 3])
