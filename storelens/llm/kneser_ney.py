"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model predicts every byte of a text, white space between words being one blank, from the four bytes before it,
within a word or across words, with interpolated modified Kneser-Ney smoothing: three discounts per order from counts of
counts, and counts of different left neighbours below the highest order. A document's perplexity is that of all its
bytes. Documents above their language's threshold go; it is a quantile of the perplexity of all trusted documents of that
language that the model did not learn from: text it has seen always looks better than other text as good.

Counts are tables keyed by n-gram, sharded by Spark. Each task reduces its texts to counts of different
n-grams first. All n-grams of the corpus get their probability from joins with the count tables; the most frequent ones, at most ``HEAD``, are then broadcast, and a
document's other n-grams are looked up by one more join.

Trusted documents are the labelled ones with quality 1 that aren't toxic. One half of them, by hash, teaches, the other half
sets thresholds, so each has one of the two uses; both halves are taken whole. Only a caller that sets ``trusted`` bounds the
half that teaches: all of a language that has at most a quota, about a quota of the others, and the largest power of two as
quota that keeps to ``trusted`` documents in all, so rare languages stay whole. All other trusted documents then set thresholds.
Counts and scores cover all documents and whole texts.

Defined results: a text without words has no perplexity (null) and isn't kept. A language without trusted
documents that set its threshold, null included, uses the threshold over all. Without any such every threshold is null and
all texts with words stay; with such, but none that teach, all are equally likely and stay. Equal rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

ORDER = 5
BLANK, START = b"\x20", b"\x0a" * (ORDER - 2)  # no word holds white space
_IS_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
SYMBOLS = 257
HEAD = 1 << 19
QUANTILE = 0.99
#: A document may lie this far above its quantile, which is itself an estimate.
MARGIN = 1.05
#: Different n-grams that a task collects before it adds them up.
CACHE = 1_000_000
CHARS = 1_000_000
BLOCK = 1 << 20


def units_of(text: bytes) -> list[bytes]:
    """The words of a text."""
    return text.split()


def grams_of(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram of every predicted byte of one text, its words' bytes and the blank after each, and the word it belongs to.

    A key holds the bytes under a leading one bit, so n-grams of all orders differ.
    """
    key = next(grams_in([BLANK.join(units).decode("utf-8", "surrogatepass")]))[0]
    blank = (key & 255) == BLANK[0]
    return key, np.cumsum(blank) - blank


def grams_in(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, number of its text) of every predicted byte of all texts, in their order.

    All texts at once, or blocks of the one text there is: where a text is taken apart depends on itself alone.
    """
    head = START + BLANK
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    stream = np.frombuffer(b"".join([head + t + BLANK for t in raw]), np.uint8).copy()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + len(head) + 1
    starts = np.cumsum(lengths) - lengths
    space = _IS_SPACE[stream]
    # Of white space the first character stays, as a blank, and every text's head.
    stays = ~space
    stays[1:] |= space[1:] & ~space[:-1]
    heads = (starts[:, None] + np.arange(len(head))).ravel()
    stays[heads] = True
    stream[space] = BLANK[0]
    stream[heads] = np.tile(np.frombuffer(head, np.uint8), len(raw))
    kept = np.add.reduceat(stays, starts, dtype=np.int64) if len(raw) else lengths
    stream = stream[stays]
    event = np.ones(len(stream), bool)
    event[((np.cumsum(kept) - kept)[:, None] + np.arange(len(head))).ravel()] = False
    text = np.repeat(np.arange(len(raw)), kept - len(head))
    size = BLOCK if len(raw) == 1 else max(1, len(stream))
    for at in range(len(head), max(len(stream), len(head) + 1), size):
        part = stream[at - len(head) : at + size].astype(np.int64)
        key = part[len(head) :] | np.int64(1) << 8 * ORDER
        for back in range(1, ORDER):
            key |= part[len(head) - back : len(part) - back] << 8 * back
        key = key[event[at : at + size]]
        yield key, text[:len(key)] if len(raw) != 1 else np.zeros(len(key), np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lo, chars = 0, 0
    for i, t in enumerate(batch["text"].to_pylist()):
        n = len(t or "")
        if i > lo and chars + n > CHARS:
            yield batch.slice(lo, i - lo)
            lo, chars = i, 0
        chars += n
    if batch.num_rows:
        yield batch.slice(lo)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def count_grams(docs: DataFrame) -> DataFrame:
    """key, n, trusted: how often each n-gram occurs in (text, trusted) rows, and in the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A code is a key and, as its last bit, whether the text is trusted.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        loose, most = 0, CACHE

        def flush() -> Iterator[pa.RecordBatch]:
            code, n = _added(held)
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] >> 1 != code[:-1] >> 1]))
            every, good = (np.add.reduceat(x, first) if len(first) else n for x in (n, n * (code & 1)))
            yield pa.record_batch([pa.array(code[first] >> 1), pa.array(every), pa.array(good)], names=["key", "n", "trusted"])

        for whole in batches:
            for batch in _slices(whole):
                trusted = batch["trusted"].to_numpy(zero_copy_only=False).astype(np.int64)
                for key, text in grams_in(batch["text"].to_pylist()):
                    held.append(np.unique(key << 1 | trusted[text], return_counts=True))
                    loose += len(held[-1][0])
                    if loose > most:
                        held = [_added(held)]
                        loose = len(held[0][0])
                        if loose > 4 * CACHE:
                            yield from flush()
                            held, loose = [], 0
                        most = loose + max(CACHE, loose)
        if held:
            yield from flush()

    parts = docs.select("text", "trusted").mapInArrow(run, "key long, n long, trusted long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


class Values:
    """Values by key, found by open addressing in arrays; keys are different and not zero."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits)
        at = self._place(keys)
        while len(keys):
            free = self.key[at] == 0
            self.key[at[free]] = keys[free]
            put = self.key[at] == keys
            self.value[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], self._next(at[~put])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.key) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where there is none, and whether there is one."""
        at = self._place(keys)
        here = self.key[at]
        found = here == keys
        value = np.where(found, self.value[at], 0.0)
        open_ = np.flatnonzero(~found & (here != 0))
        while len(open_):
            at[open_] = self._next(at[open_])
            here = self.key[at[open_]]
            hit = here == keys[open_]
            found[open_[hit]], value[open_[hit]] = True, self.value[at[open_[hit]]]
            open_ = open_[~hit & (here != 0)]
        return value, found


def _order(key: str = "key") -> Column:
    return ((F.length(F.bin(key)) - 1) / 8).cast("int")


def _tail(key: str, n: int | str) -> Column:
    """The last ``n`` bytes of a key, as a key of order ``n``."""
    return F.expr(f"({key} & (shiftleft(1L, 8 * {n}) - 1)) | shiftleft(1L, 8 * {n})")


def smooth(counts: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(key, part): discounted counts of all orders; (context, total, rest): what a context saw, and its mass left over.

    ``counts``: key and n of trusted text.
    """
    level = counts.select("key", F.col("n").alias("c"))
    grams = []
    for order in range(ORDER, 0, -1):
        level = ws.keep(level)
        freq = {r["c"]: r["n"] for r in level.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n2, n3, n4 = (freq.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        fit = lambda k, a, b, y=y: min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) if a else 0.5 * k
        d1, d2, d3 = fit(1, n1, n2), fit(2, n2, n3), fit(3, n3, n4)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        grams.append(level.select("key", "c", cut.cast("double").alias("cut")))
        if order > 1:
            # Left neighbours are counted by the different longer n-grams.
            level = level.select(_tail("key", order - 1).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    every = ws.keep(every)
    contexts = every.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum("cut").alias("rest"))
    return every.select("key", (F.col("c") - F.col("cut")).alias("part")), ws.keep(contexts)


def probabilities(keys: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """key, logp (natural): interpolated from the lowest order up, by joins with the count tables."""
    orders = F.explode(F.sequence(F.lit(1), _order()))
    q = keys.select("key", orders.alias("order"))
    q = q.withColumn("gram", _tail("key", "order"))
    q = q.withColumn("context", F.shiftright("gram", 8))
    q = q.join(grams.withColumnRenamed("key", "gram"), "gram", "left").join(contexts, "context", "left")
    steps = F.sort_array(F.collect_list(F.struct("order", F.coalesce("part", F.lit(0.0)).alias("part"), "total", "rest")))
    mixed = F.aggregate("steps", F.lit(1.0 / SYMBOLS), lambda p, x: F.when(x["total"].isNull(), p).otherwise((x["part"] + x["rest"] * p) / x["total"]))
    return q.groupBy("key").agg(steps.alias("steps")).select("key", F.log(mixed).alias("logp"))


_SUMS = "doc_id long, lang string, events long, logp double, tail array<struct<key:long,n:long>>"


def _tails(lacking: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.ListArray:
    """For each of ``size`` texts its different keys and how often it has them."""
    text, key = (np.concatenate(x) for x in zip(*lacking, strict=True)) if lacking else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=size))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(key[first]), pa.array(n, pa.int64())], names=["key", "n"]))


def _sum_texts(docs: DataFrame, head_key: np.ndarray, head_logp: np.ndarray, complete: bool) -> DataFrame:
    """Events and log-probability of each text over the broadcast n-grams, and its other n-grams with their number."""
    shared = docs.sparkSession.sparkContext.broadcast((head_key, head_logp))
    tail_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Values(*shared.value)
        for whole in batches:
            for batch in _slices(whole):
                size = batch.num_rows
                events, sums, lacking = np.zeros(size, np.int64), np.zeros(size), []
                for key, text in grams_in(batch["text"].to_pylist()):
                    value, found = head.get(key)
                    events += np.bincount(text, minlength=size)
                    sums += np.bincount(text, value, size)
                    if not complete:
                        lacking.append((text[~found], key[~found]))
                yield pa.record_batch(
                    [batch["doc_id"], batch["lang"], pa.array(events), pa.array(sums), _tails(lacking, size).cast(tail_type)],
                    names=["doc_id", "lang", "events", "logp", "tail"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, _SUMS)


def sample(good: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id of the rows (doc_id, lang) that teach: one half, by hash; with a ``limit`` about a quota a language of it, or all it has."""
    good = good.where(F.xxhash64("doc_id") < 0)
    if limit is None:
        return good.select("doc_id")
    size = good.groupBy(F.struct("lang").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    quotas = [1 << k for k in range(max(1, limit).bit_length())]
    taken = size.agg(*[F.sum(F.least("n", F.lit(q))).alias(f"q{q}") for q in quotas], F.sum("n").alias("all")).first()
    if (taken["all"] or 0) <= limit:
        return good.select("doc_id")
    quota = max([q for q in quotas if taken[f"q{q}"] <= limit], default=1)
    # With more languages than ``limit``, which a quota of one would exceed, the last step decides.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = good.join(size, F.struct("lang").eqNullSafe(F.col("own"))).where(share * F.col("n") < quota)
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    trusted: int | None = None,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    workspace: Workspace | None = None,
) -> DataFrame:
    """doc_id, lang, events (bytes predicted), log_prob, perplexity, threshold, kept of (doc_id, text, lang) rows.

    ``trusted`` bounds the documents that teach, for a model of fixed cost; without it the whole half does.
    """
    spark = docs.sparkSession
    ws = Workspace.of(spark, workspace)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.where("quality = 1 AND toxic = 0").select("doc_id")
    good = ws.keep(docs.select("doc_id", "lang").join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("lang").alias("lang")))
    learning = ws.keep(sample(good, trusted))
    marked = docs.select("doc_id", "text").join(learning.withColumn("_good", F.lit(True)), "doc_id", "left")
    marked = marked.select("text", F.coalesce("_good", F.lit(False)).alias("trusted"))
    counts = ws.keep(count_grams(marked))
    grams, contexts = smooth(counts.where("trusted > 0").select("key", F.col("trusted").alias("n")), ws)
    known = ws.keep(probabilities(counts, grams, contexts).join(counts.select("key", "n"), "key"))
    total = known.count()
    if total <= HEAD:
        head = known
    else:
        level = F.floor(8 * F.log2("n"))
        lowest, held = None, 0
        for r in known.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            if held + r["count"] > HEAD:
                break
            lowest, held = r["level"], held + r["count"]
        head = known.where(level >= lowest) if lowest is not None else known.limit(0)
    head = head.select("key", "logp").toArrow().sort_by("key")
    key, logp = head["key"].to_numpy(), head["logp"].to_numpy()

    # Written, so that a row keeps its number.
    scored = ws.keep(_sum_texts(docs, key, logp, total <= HEAD).withColumn("row", F.monotonically_increasing_id()))
    if total > HEAD:
        tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.key", "t.n")
        more = tail.join(known.select("key", F.col("logp").alias("lp")), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("lp")).alias("more"))
        scored = scored.join(more, "row", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0)))
    perplexity = F.when(F.col("events") > 0, F.exp(-F.col("logp") / F.col("events")))
    scored = scored.select("doc_id", "lang", "events", F.col("logp").alias("log_prob"), perplexity.alias("perplexity"))
    cut = (margin * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold")
    judges = good.select("doc_id").join(learning, "doc_id", "left_anti")
    learned = ws.keep(scored.join(judges, "doc_id", "left_semi").select(F.struct("lang").alias("own"), "perplexity"))
    by_language = learned.groupBy("own").agg(cut)
    overall = learned.agg(cut.alias("overall"))
    # One row per language, and one row over all.
    out = scored.join(by_language, F.struct("lang").eqNullSafe(F.col("own")), "left").crossJoin(F.broadcast(overall))
    limit = F.when(F.col("lang").isNull(), F.col("overall")).otherwise(F.coalesce("threshold", "overall"))
    return out.select(
        "doc_id", "lang", "events", "log_prob", "perplexity", limit.alias("threshold"),
        F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)).alias("kept"),
    )
