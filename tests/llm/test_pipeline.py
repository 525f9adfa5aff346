"""The pipeline against a plain version of its stages on a small table."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_mixing import fill
from test_quality_rules import counts
from test_simhash import brute_fingerprint, groups

from storelens.llm import quality_rules as Q
from storelens.llm import secrets as S
from storelens.llm.common import Workspace, table
from storelens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    with Workspace(spark) as ws:
        docs, out = table(spark, SF, "documents"), []
        for _, stage in corpus_pipeline.STAGES:
            docs = ws.keep(stage(spark, docs, SF))
            out.append(docs)
        yield [table(spark, SF, "documents"), *out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "secret_scan", "mix_sources", "pack_documents"]
    assert all(s.columns == stages[0].columns and s.schema["doc_id"] == stages[0].schema["doc_id"] for s in stages[1:-1])


def test_quality_rules(spark, stages):
    rules = Q.learn_rules(Q.text_statistics(stages[0]), table(spark, SF, "labels"))
    want = []
    for r in stages[0].collect():
        n, chars, symbols, _, repeats = counts(r["text"])
        text = r["text"] or ""
        lines = [x for x in text.split("\n") if x.strip()]
        value = {
            "mean_word": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "repeat_share": repeats / max(n, 1), "dup_line_share": counts(text)[3] / max(len(lines), 1),
            "upper_share": sum(c.isupper() for c in text) / max(chars, 1), "exclaim_per_word": text.count("!") / max(n, 1), "digit_share": len(re.findall("[0-9]", text)) / max(chars, 1),
        }
        failed = n < 50 or 100 * repeats > 50 * n
        rejected = any(all((value[c.feature] >= c.threshold) == c.above for c in rule.conditions) for rule in rules)
        if not failed and not rejected:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(want)


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({rows[k]["doc_id"] for k in root})


def test_no_secret_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert set(before) == set(after)
    patterns = [re.compile(r.pattern.replace("(?i)", ""), re.I if "(?i)" in r.pattern else 0) for r in S.RULES]
    for k, text in after.items():
        found = [m for r, p in zip(S.RULES, patterns, strict=True) for m in p.finditer(before[k]) if len(m.group(r.group)) >= r.least]
        assert bool(found) == (text != before[k])
        assert not any(m.group() in text for m in found)


def test_sources_reach_their_targets(stages):
    size, source, total = {}, {}, Counter()
    for r in stages[3].collect():
        size[r["doc_id"]], source[r["doc_id"]] = len(r["text"].split()), r["source"]
        total[r["source"]] += size[r["doc_id"]]
    want, taken, each = fill(total), Counter(), defaultdict(int)
    for r in stages[4].collect():
        taken[r["source"]] += len(r["text"].split())
        each[r["doc_id"]] += len(r["text"].split())
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert all(n <= 2 * size[k] for k, n in each.items())


def test_all_tokens_are_packed(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in stages[4].collect())
    rows = stages[5].collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in want.items())


def test_run_gives_the_stages_result(spark, stages):
    with Workspace(spark) as ws:
        assert sorted(map(str, corpus_pipeline.run(spark, SF, ws).collect())) == sorted(map(str, stages[-1].collect()))


def stored_folder(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def stage_rows(spark, folder, ws):
    docs, out = table(spark, folder, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = ws.keep(stage(spark, docs, folder))
        out.append(docs)
    return out


def test_an_empty_table_runs_through(spark, documents, ws, tmp_path):
    folder = stored_folder(spark, tmp_path, documents([]))
    assert [s.count() for s in stage_rows(spark, folder, ws)] == [0] * 5
    assert corpus_pipeline.run(spark, folder, ws).count() == 0


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark, ws, tmp_path):
    good = table(spark, SF, "documents").limit(40)
    columns = good.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", None, None, 0), (5001, None, "en", "src0", None), (5002, " \n ", "en", "src0", 3)], good.schema)
    long = good.orderBy("doc_id").limit(1).withColumns({"doc_id": F.lit(5003).cast("long"), "text": F.concat_ws(" ", F.expr("transform(sequence(1, 30000), i -> concat('word', i * 7919 % 29989))"))})
    nameless = good.orderBy("doc_id").limit(3).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    every = good.unionByName(odd).unionByName(long).unionByName(nameless).unionByName(good.limit(5))
    extra = {"_size": F.lit("s"), "_number": F.lit("n"), "position": F.lit(7), "copies": F.lit(8), "_row": F.lit("r"), "blob": F.lit(1), "fp": F.lit(2), "size": F.lit(3)}
    folder = stored_folder(spark, tmp_path, every.withColumns(extra))
    out = stage_rows(spark, folder, ws)
    for s in out[:-1]:
        assert s.columns == [*columns, *extra] and s.count() > 0
        assert {(r["_size"], r["_number"], r["position"], r["copies"], r["_row"], r["blob"], r["fp"], r["size"]) for r in s.collect()} == {("s", "n", 7, 8, "r", 1, 2, 3)}
    ids = {r["doc_id"] for r in out[0].collect()}
    assert not ids & {None, 5000, 5001, 5002}
    assert out[1].count() == len({r["doc_id"] for r in out[1].collect()})
    want = {r["doc_id"] for r in out[3].collect()}
    assert {r["doc_id"] for r in out[4].collect()} == want


def test_stages_leave_no_tables_behind(spark, ws):
    corpus_pipeline.run(spark, SF, ws)
    open_now = [w.path for w in corpus_pipeline._open]
    assert len(open_now) == 1  # the last stage's
    folders = [p.name for p in Path(ws.path.removeprefix("file:")).parent.glob("llm-*")]
    assert Path(open_now[0]).name in folders
    assert sum(name == Path(ws.path).name for name in folders) == 1
    assert [p.name for p in Path(ws.path.removeprefix("file:")).iterdir()] in (["4", "5"], ["5", "4"], ["5"])
