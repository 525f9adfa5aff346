import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import sharding as s

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 4097])
@pytest.mark.parametrize("seed", [0, 12])
def test_permutation_and_inverse(n, seed):
    p = s.Permutation(n, seed)
    rows = np.arange(n)
    at = p.forward(rows)
    assert sorted(at.tolist()) == rows.tolist() and (p.backward(at) == rows).all()


def test_seeds_give_other_orders_and_large_numbers_come_back():
    n = 10_000
    a, b = s.Permutation(n, 1).forward(np.arange(n)), s.Permutation(n, 2).forward(np.arange(n))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.05
    large = s.Permutation(2**62 + 12345)
    rows = np.array([0, 1, 2**40, 2**62 + 12344])
    assert (large.backward(large.forward(rows)) == rows).all() and large.forward(rows).max() < large.n


def places(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["shard"], r["slot"]) for r in df.collect())


def test_shards_are_even_gapless_and_computable(spark, documents, ws):
    df = documents([f"text {i}" for i in range(1003)])
    rows = s.shard(df, shards=16, workspace=ws).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} == {62, 63}
    back = s.Permutation(1003).backward(np.array([r["slot"] * 16 + r["shard"] for r in rows]))
    assert back.tolist() == [r["doc_id"] for r in rows]


def test_layout_changes_nothing(spark, documents, ws):
    ids = [None] * 300 + [7] * 200 + list(range(500))
    texts = ["same"] * 300 + [f"t{i % 3}" for i in range(200)] + [None, ""] * 250
    df = documents(texts, doc_id=ids)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = places(s.shard(df, workspace=ws))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        again = places(s.shard(df.orderBy(F.rand(3)).repartition(5), workspace=ws))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again and len(first) == 1000


def test_equal_rows_spread_over_partitions(spark, documents, ws):
    df = documents(["x"] * 4000, doc_id=[1] * 4000).repartition(8)
    rows, n = s.numbered(df, "doc_id", ws)
    assert n == 4000 and sorted(r[0] for r in rows.select("_number").collect()) == list(range(4000))
    stored = spark.read.parquet(f"{ws.path}/1").groupBy(F.shiftright("_at", s.ROW_BITS)).count().collect()
    assert max(r["count"] for r in stored) < 2500


def test_other_columns_and_clashing_names(spark, documents, ws):
    df = documents(["a", "b", "c"]).withColumns({"shard": F.lit("old"), "_key": F.lit(1), "_all": F.lit(2), "_number": F.lit(3), "m": F.create_map(F.lit(1), F.lit(2))})
    out = s.shard(df, shards=2, workspace=ws)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_key", "_all", "_number", "m", "law", "shard", "slot"]
    rows = out.collect()
    assert {(r["_key"], r["_all"], r["_number"], r["law"]) for r in rows} == {(1, 2, 3, "rows")}
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (1, 0)]


def test_empty_and_single(spark, documents, ws):
    assert s.shard(documents([]), workspace=ws).collect() == []
    assert [(r["shard"], r["slot"]) for r in s.shard(documents([None]), workspace=ws).collect()] == [(0, 0)]


def test_written_shards_hold_rows_in_slot_order(spark, documents, ws, tmp_path):
    df = documents([f"t{i}" for i in range(200)])
    s.write_shards(s.shard(df, shards=4, workspace=ws), str(tmp_path / "out"), parts=6)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 200 and sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == [f"shard={i}" for i in range(4)]
    for file in (tmp_path / "out").rglob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_query_columns(spark):
    from storelens.llm.queries import QUERIES

    rows = QUERIES["op12_shard_documents"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
