import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import packing as P
from storelens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = ["a", "B", "é", "the", " ", "  ", "\n", "\n\n", ".", ",", "!", "'s", "12", "\t", "|", "<|endoftext|>", "#", "don't", "_", "中", "\x85", "　", "ﬁ", "²", "\r\n", "w.", "Ж", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + ["word. next, last!", "", " x", "x ", "a\nb"]
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert P.encode_texts(texts, tokenizer_path()) == want
    assert P.encode_texts(texts, tokenizer_path()) == want
    small = P._workers[tokenizer_path()]
    small.size = 10
    try:
        for at in range(0, len(texts), 50):
            assert P.encode_texts(texts[at : at + 50], tokenizer_path()) == want[at : at + 50]
    finally:
        small.size = P.CACHE


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(2)
    for window in (8, 100, 2048):
        lengths = sorted((rng.randint(1, window) for _ in range(400)), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
            if fits:
                least = min(fits)[0]
                want.append(least)
                rooms[min(fits)[1]] -= n
            else:
                want.append(window)
                rooms.append(window - n)
        number, offset = P.best_fit_decreasing(np.array(lengths), window)
        assert [window - o for o in offset.tolist()] == want
        assert len(set(number.tolist())) == len(rooms)


TEXTS = [None, "", "one", " ".join(f"word{i}" for i in range(9000)), "tab\tand  double", *[f"text number {i} " * (i % 40) for i in range(200)], "same", "same"]


@pytest.mark.parametrize("window", [2048, 64])
def test_round_trip(documents, ws, tokenizer, window):
    docs = documents(TEXTS).withColumn("start", F.lit("x")).withColumn("ids", F.lit(0))
    pieces = P.pack(docs, tokenizer_path(), window=window, group=60, with_ids=True, workspace=ws).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= window and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        whole = [x for s, ids, _ in sorted(by_doc[i]) for x in ids]
        assert whole == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert {n for _, _, n in by_doc[i]} == {len(whole)}
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    rows = P.sequences(P.pack(docs, tokenizer_path(), window=window, with_ids=True, workspace=ws)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows) and sum(r["length"] for r in rows) == sum(r["length"] for r in pieces)


def test_empty_table_repeated_rows_and_null_ids(spark, documents, ws):
    assert P.pack(documents(["x"]).limit(0), tokenizer_path(), workspace=ws).count() == 0
    rows = spark.createDataFrame([(None, "same text"), (None, "same text"), (2**60 + 1, "same text")], "doc_id long, text string")
    got = P.pack(rows, tokenizer_path(), workspace=ws).collect()
    assert sorted(str(r["doc_id"]) for r in got) == [str(2**60 + 1), "None", "None"] and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


def test_little_padding(spark, ws):
    from storelens.llm.common import table

    got = P.pack(table(spark, "/root/testdata/sf0.001", "documents"), tokenizer_path(), workspace=ws).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(2048 - r["n"] for r in got) < 0.03 * 2048 * len(got) + 2048
