"""Language-model scoring with a hashed maximum-entropy model.

A word's probability has three factors. Words belong to 1024 codes: the most frequent ones have a
code of their own, all others share one by the hash of their ending. A code is a class and a member of
the class. P(class | history) and P(member | class, history) are softmaxes over 32 outcomes: a prior from the
counts, plus the weights of the active features. P(word | code) comes from the counts.
Features of a history: the code before (n-gram), the code two before (skip), and both together, hashed into
a table of fixed size. So the model has a fixed number of weights, however long the corpus is.

Training is by distributed gradient updates. The training text is taken apart once and stored as counts of
different contexts with the code that followed; in each update, every task sums observed and expected feature counts
of its contexts under the current weights, the sums are added up by blocks of weights, and each weight moves along
the difference, scaled by its expected count and damped by a logarithm. All training text takes part in
every update.

Exact word counts, for the word factor and the unigram base, are a table that grows with the corpus. Its
head, at most ``HEAD`` words, is broadcast. The other words of a document are looked up by a join, and no key there
holds more than a small share of all words.

Defined results: a null text is empty and has its end token only. Equal rows count one by one. A null
doc_id counts as the empty text in the hold-out rule. Words are told apart by 64-bit hash. A word without
training count is one unknown word of its code.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, Workspace

CLASSES = MEMBERS = 32
CODES = CLASSES * MEMBERS
#: Words with a code of their own; they fill the first half of the classes.
OWN_CODE = CODES // 2
#: Rows of the weight table: two ranges indexed by (code, node), the rest hashed.
NODES = 1 + CLASSES
ROWS = 1 << 17
HASHED = ROWS - 2 * CODES * NODES
HEAD = 1 << 18
ADD = 0.1
UPDATES = 2
#: Share of a full step of each update, and pseudo-counts that hold a row to the current model.
STEP, DAMP = 0.5, 60.0
BLOCKS = 64
#: Tokens taken apart at once, words a Python worker keeps, tokens whose triples are counted together, contexts per numpy step.
BATCH, CACHE, PORTION, STRIP = 100_000, 300_000, 2_000_000, 8_192
#: Triples of a stored row, and rows that an update learns from at once: so much of a portion is in memory.
ROW, ROWS_AT_ONCE = 1 << 15, 8
#: Training tokens per task of an update.
TASK_TOKENS = 6_000_000
END = b"\n"  # no word holds white space


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


@functools.lru_cache(maxsize=1 << 16)
def _code_of_ending(ending: bytes) -> int:
    import xxhash

    h = xxhash.xxh32_intdigest(ending, 7)
    half = CLASSES // 2
    return (half + h % half) * MEMBERS + h // half % MEMBERS


def shared_code(word: bytes) -> int:
    """Code of a word without one of its own, by its last three bytes."""
    return _code_of_ending(word[-3:])


class Words:
    """Numbers of the words a worker has met, with their hashes and codes."""

    def __init__(self, own: dict[int, int] | None = None):
        self.own = own or {}
        self.clear()

    def clear(self) -> None:
        self.number = Numbering()
        self.hashes, self.codes = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each with its end token, and where each text begins."""
        import xxhash

        if len(self.number) > CACHE:
            self.clear()
        tokens, starts, known = [], [], len(self.number)
        for t in texts:
            starts.append(len(tokens))
            # lower() of bytes changes A-Z only; split() of bytes knows just the six blanks.
            tokens += (t or b"").lower().split()
            tokens.append(END)
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        if new:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64).view(np.int64)
            own = self.own.get
            codes = [shared_code(w) if (c := own(h)) is None else c for h, w in zip(hashes.tolist(), new, strict=True)]
            self.hashes, self.codes = np.concatenate([self.hashes, hashes]), np.concatenate([self.codes, np.array(codes, np.int64)])
        return ids, np.array(starts, np.int64)


def text_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Slices of a batch with at most some BATCH tokens each, or one text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_pylist()
    lo, chars = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and chars + n > 6 * BATCH:
            yield lo, i
            lo, chars = i, 0
        chars += n
    if sizes:
        yield lo, len(sizes)


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def count_words(docs: DataFrame) -> DataFrame:
    """hash, code (as if shared), n: training counts of all words of (text, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            there = np.flatnonzero(total)
            return pa.record_batch([pa.array(words.hashes[there]), pa.array(words.codes[there].astype(np.int32)), pa.array(total[there])], names=["hash", "code", "n"])

        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch["held"]))
            for lo, hi in text_batches(batch):
                if len(words.number) > CACHE:
                    yield flush()
                    words.clear()
                    total = np.zeros(0, np.int64)
                ids, _ = words.take(_bytes(batch["text"][lo:hi]))
                more = np.bincount(ids, minlength=len(words.number))
                more[: len(total)] += total
                total = more
        yield flush()

    parts = docs.select("text", "held").mapInArrow(run, "hash long, code int, n long")
    return parts.groupBy("hash").agg(F.max("code").alias("code"), F.sum("n").alias("n"))


@dataclass
class Model:
    """All that a task needs; its size does not depend on the corpus."""

    tokens: int
    types: int
    head_hash: np.ndarray
    head_n: np.ndarray
    complete: bool
    own: dict[int, int]
    code_n: np.ndarray
    code_types: np.ndarray
    weights: np.ndarray

    @functools.cached_property
    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Log prior of the classes, and of the members of each class."""
        mass = (self.code_n + ADD * (self.code_types + 1)).reshape(CLASSES, MEMBERS)
        one = np.log(mass.sum(1) / mass.sum())
        two = np.log(mass / mass.sum(1, keepdims=True))
        return one.astype(np.float32), two.astype(np.float32)


def _contexts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code before each token and the one before that. A text begins after two end tokens."""
    end = np.int64(CODES)
    one = np.concatenate([[end], codes[:-1]])
    one[starts] = end
    two = np.concatenate([[end], one[:-1]])
    two[starts] = end
    return one, two


def _rows(one: np.ndarray, two: np.ndarray, node: np.ndarray | int) -> np.ndarray:
    """Weight rows (context, feature) of a node: 0 for the classes, 1 + class for its members."""
    both = one * 1_000_003 + two
    mixed = (both * np.int64(0x9E3779B97F4A7C1) + node * np.int64(0x61C8864680B583)) & np.int64(0x7FFFFFFFFFFFFFFF)
    mixed = (mixed ^ mixed >> 29) * np.int64(0x3F58476D1CE4E5B9 >> 4) & np.int64(0x7FFFFFFFFFFFFFFF)
    return np.stack([one % CODES * NODES + node, CODES * NODES + two % CODES * NODES + node, 2 * CODES * NODES + (mixed >> 20) % HASHED])


_ONES = np.ones(MEMBERS, np.float32)


def _softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += prior
    # Weights move by bounded steps from a log prior, so no exponent overflows.
    np.exp(z, out=z)
    z /= (z @ _ONES)[:, None]
    return z


def log_probabilities(model: Model, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of P(class) P(member) of each token."""
    one, two = _contexts(codes, starts)
    first, second = model.prior
    out = np.empty(len(codes))
    place = np.empty((CODES + 1) ** 2, np.int32)
    for at in range(0, len(codes), BATCH):
        part = slice(at, at + BATCH)
        a, b, cls, member = one[part], two[part], codes[part] // MEMBERS, codes[part] % MEMBERS
        # Classes depend on the two codes before alone: once for each different pair, which its last token stands for.
        pair, each = a * (CODES + 1) + b, np.arange(len(a), dtype=np.int32)
        place[pair] = each
        last = np.flatnonzero(place[pair] == each)
        place[pair[last]] = np.arange(len(last), dtype=np.int32)
        classes = np.empty((len(last), CLASSES), np.float32)
        for lo in range(0, len(last), STRIP):
            own = last[lo : lo + STRIP]
            classes[lo : lo + STRIP] = _softmax(model.weights, _rows(a[own], b[own], 0), first)
        p = classes[place[pair], cls].astype(np.float64)
        for lo in range(0, len(a), STRIP):
            s = slice(lo, lo + STRIP)
            members = _softmax(model.weights, _rows(a[s], b[s], 1 + cls[s]), second[cls[s]])
            p[s] *= members[each[: len(members)], member[s]]
        out[part] = np.log10(p)
    return out


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``into[rows] += values`` for rows of one feature, whose range fits 16 bits."""
    order = np.argsort((rows - rows.min()).astype(np.uint16), kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if 4 * len(first) < len(rows):
        into[ordered[first]] += np.add.reduceat(values.take(order, axis=0), first, axis=0)
        return
    # Most rows occur once or twice: add all first values, then all second ones, and the few long runs one by one.
    times = np.diff(np.append(first, len(rows)))
    total, depth = values.take(order[first], axis=0), 1
    left = np.flatnonzero(times > 1)
    while 64 * len(left) > len(rows):
        total[left] += values.take(order[first[left] + depth], axis=0)
        depth += 1
        left = left[times[left] > depth]
    for i in left.tolist():
        total[i] += values.take(order[first[i] + depth : first[i] + times[i]], axis=0).sum(axis=0)
    into[ordered[first]] += total


class Triples:
    """Texts as counts of different (two codes before, code) triples, in portions.

    Features depend on nothing else, so a context that repeats is worked out once.
    """

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray, starts: np.ndarray) -> None:
        one, two = _contexts(codes, starts)
        # Below 2^31.
        self.held.append(((one * (CODES + 1) + two) * CODES + codes).astype(np.int32))
        self.size += len(codes)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The triples in order, and how often each one occurred."""
        triple, times = np.unique(np.concatenate([*self.held, np.empty(0, np.int32)]), return_counts=True)
        self.held, self.size = [], 0
        return triple, times


class Gradient(Triples):
    """Observed and expected counts of all weights, under ``model``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.seen, self.expected = np.zeros(ROWS * MEMBERS, np.float32), np.zeros((ROWS, MEMBERS), np.float32)

    def flush(self) -> None:
        self.learn(*self.take())

    def learn(self, triple: np.ndarray, times: np.ndarray) -> None:
        if not len(triple):
            return
        triple, times = triple.astype(np.int64), times.astype(np.float32)
        code = triple % CODES
        first, second = self.model.prior
        self._level(triple // CODES, code // MEMBERS, times, lambda pair: (pair, 0), lambda pair: first)
        self._level(
            triple // MEMBERS, code % MEMBERS, times,
            lambda unit: (unit // CLASSES, 1 + unit % CLASSES), lambda unit: second[unit % CLASSES],
        )

    def _level(self, unit: np.ndarray, outcome: np.ndarray, times: np.ndarray, parts: Callable, prior: Callable) -> None:
        """One softmax. ``unit``: its context, in order; ``parts`` gives the pair of codes and the node."""

        def rows_of(u: np.ndarray) -> np.ndarray:
            pair, node = parts(u)
            return _rows(pair // (CODES + 1), pair % (CODES + 1), node)

        start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        context, n = unit[start], np.add.reduceat(times, start)
        # The triples of each context follow it, so its rows are those of its triples.
        spread = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(unit))))
        for at in range(0, len(context), STRIP):
            own = context[at : at + STRIP]
            rows = rows_of(own)
            p = _softmax(self.model.weights, rows, prior(own))
            p *= n[at : at + STRIP, None]
            lo, hi = start[at], start[at + STRIP] if at + STRIP < len(start) else len(unit)
            place = spread[lo:hi] - at
            for r in rows:
                _add_rows(self.expected, r, p)
                np.add.at(self.seen, r[place] * MEMBERS + outcome[lo:hi], times[lo:hi])


def _upper_half(x: np.ndarray) -> bytes:
    """float32 by its upper 16 bits, rounded."""
    return ((x.view(np.uint32) + np.uint32(0x8000)) >> 16).astype(np.uint16).tobytes()


def _from_upper_half(x: bytes) -> np.ndarray:
    return (np.frombuffer(x, np.uint16).astype(np.uint32) << 16).view(np.float32)


def gather(docs: DataFrame, own: dict[int, int]) -> DataFrame:
    """triple, times: the triples of the training text as 32-bit numbers, at most ROW of a portion of text a row."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(shared.value), Triples()

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [x.astype(np.int32) for x in held.take()]
            for lo in range(0, len(columns[0]), ROW):
                yield pa.record_batch([pa.array([x[lo : lo + ROW].tobytes()], pa.binary()) for x in columns], names=["triple", "times"])

        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch["held"]))
            for lo, hi in text_batches(batch):
                ids, starts = words.take(_bytes(batch["text"][lo:hi]))
                held.add(words.codes[ids], starts)
                if held.size >= PORTION:
                    yield from flush()
        if held.size:
            yield from flush()

    return docs.select("text", "held").mapInArrow(run, "triple binary, times binary")


@contextmanager
def _rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans run inside pass rows to Python in batches of at most ``rows``: for rows of some 100 KB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def update(gathered: DataFrame, model: Model, step: float = STEP, damp: float = DAMP) -> np.ndarray:
    """The weights after one gradient update over all training text, as ``gather`` stored it."""
    spark = gathered.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size, names, fields = ROWS // BLOCKS, ["block", "seen", "expected"], "block int, seen binary, expected binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Gradient(shared.value)
        for batch in batches:
            total.learn(*(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch[n]]) for n in ("triple", "times")))
        seen = total.seen.reshape(ROWS, MEMBERS)
        for b in range(BLOCKS):
            part = slice(b * size, (b + 1) * size)
            if total.expected[part].any():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([_upper_half(seen[part])], pa.binary()), pa.array([_upper_half(total.expected[part])], pa.binary())], names=names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What came over the shuffle in 16 bits is added up in 64, one block after another."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, *pair in zip(*(batch[n] for n in names), strict=True):
                block = b.as_py()
                total[block] = total.get(block, 0) + np.stack([_from_upper_half(x.as_buffer()).astype(np.float64) for x in pair])
        for b, pair in total.items():
            yield pa.record_batch([pa.array([b], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in pair]], names=names)

    # A task's gradient has a fixed size, so a task takes much text, and their number follows the text.
    tasks = max(1, -(-model.tokens // TASK_TOKENS))
    parts = min(BLOCKS // 4, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sums = gathered.coalesce(tasks).mapInArrow(run, fields).repartitionById(parts, F.col("block") % parts).mapInArrow(add_up, fields)
    weights = model.weights.copy()
    # The whole table comes back: a fixed number of weights.
    with _rows_a_batch(spark, ROWS_AT_ONCE):
        added = sums.collect()
    for b, *pair in added:
        seen, expected = (np.frombuffer(x).reshape(size, MEMBERS) for x in pair)
        n = expected.sum(axis=1, keepdims=True)
        q = expected / np.maximum(n, 1e-30)
        move = step * np.log((seen + damp * q + 1e-12) / (expected + damp * q + 1e-12))
        weights[b * size : (b + 1) * size] += np.clip(move, -3, 3).astype(np.float32)
    shared.destroy()
    return weights


def train(docs: DataFrame, counts: DataFrame, ws: Workspace, updates: int = UPDATES, step: float = STEP) -> Model:
    """A model of (text, held) rows, and of the stored table of their counts."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The lowest count with at most HEAD words at or above it, in steps of an eighth of an octave.
    level = F.floor(8 * F.log2("n"))
    by_level = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    lowest, words = None, 0
    for r in by_level:
        if words + r["count"] > HEAD:
            break
        lowest, words = r["level"], words + r["count"]
    head = counts.where(level >= lowest).toArrow() if lowest is not None else counts.limit(0).toArrow()
    head = head.sort_by([("n", "descending"), ("hash", "ascending")])
    hashes, n = head["hash"].to_numpy(), head["n"].to_numpy()
    half = CLASSES // 2
    own = {int(h): k % half * MEMBERS + k // half for k, h in enumerate(hashes[:OWN_CODE])}
    by_code = counts.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    code_n, code_types = np.zeros(CODES), np.zeros(CODES)
    for r in by_code:
        code_n[r["code"]], code_types[r["code"]] = r["n"], r["types"]
    for h, c, code in zip(hashes[:OWN_CODE].tolist(), n[:OWN_CODE].tolist(), head["code"].to_pylist()[:OWN_CODE], strict=True):
        code_n[code] -= c
        code_types[code] -= 1
        code_n[own[h]], code_types[own[h]] = c, 1
    order = np.argsort(hashes, kind="stable")
    model = Model(int(total[0]), int(total[1]), hashes[order], n[order], words == total[1], own, code_n, code_types, np.zeros((ROWS, MEMBERS), np.float32))
    if total[0] and updates:
        gathered = ws.keep(gather(docs, own))
        for _ in range(updates):
            model.weights = update(gathered, model, step)
        ws.drop(ws.last)
    return model


_SCORED = "doc_id long, held boolean, n_tokens long, n_known long, base double, score double, tail array<struct<hash:long,n:long>>"


def _score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Sums over the words of the head, and the other words with their number, for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tail_type = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m.own)
        base_all = np.log10(m.tokens + ADD * (m.types + 1))
        code_all = np.log10(m.code_n + ADD * (m.code_types + 1))

        # By word number: log10 of the count, and 1 for a known word, 0 for an unknown one, -1 where a join must tell.
        log_n, state = np.empty(0), np.empty(0, np.int64)

        for batch in batches:
            for lo, hi in text_batches(batch):
                ids, starts = words.take(_bytes(batch["text"][lo:hi]))
                if len(state) > len(words.hashes):
                    log_n, state = np.empty(0), np.empty(0, np.int64)
                h = words.hashes[len(state) :]
                at = np.minimum(np.searchsorted(m.head_hash, h), max(0, len(m.head_hash) - 1))
                found = m.head_hash[at] == h if len(m.head_hash) else np.zeros(len(h), bool)
                n = np.where(found, m.head_n[at], 0) if len(m.head_hash) else np.zeros(len(h))
                log_n = np.concatenate([log_n, np.where(found | m.complete, np.log10(n + ADD), 0.0)])
                state = np.concatenate([state, np.where(found, 1, 0 if m.complete else -1)])
                codes = words.codes[ids]
                model_part = log_probabilities(m, codes, starts) - code_all[codes]
                count_part, own = log_n[ids], state[ids]
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                lengths = np.diff(np.append(starts, len(ids)))
                # The words left over, counted by text.
                left, width = np.flatnonzero(own < 0), len(state)
                doc = np.searchsorted(starts, left, side="right") - 1
                pair, times = np.unique(doc * width + ids[left], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(hi - lo + 1) * width)
                items = pa.StructArray.from_arrays([pa.array(words.hashes[pair % width]), pa.array(times.astype(np.int64))], names=["hash", "n"])
                yield pa.record_batch(
                    [
                        batch["doc_id"][lo:hi], batch["held"][lo:hi],
                        pa.array(lengths), pa.array(add((own > 0).astype(np.int64))),
                        pa.array(add(count_part) - lengths * base_all), pa.array(add(model_part + count_part)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items).cast(tail_type),
                    ],
                    names=["doc_id", "held", "n_tokens", "n_known", "base", "score", "tail"],
                )

    return docs.select(F.col("doc_id").cast("long"), "held", "text").mapInArrow(run, _SCORED)


def score(docs: DataFrame, *, updates: int = UPDATES, step: float = STEP, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (doc_id, text)."""
    ws = Workspace.of(docs.sparkSession, workspace)
    d = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    counts = ws.keep(count_words(d))
    model = train(d, counts, ws, updates, step)
    # Written, so that a row keeps its number.
    scored = ws.keep(_score_texts(d, model).withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.hash", F.col("t.n").alias("times"))
    looked = tail.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("_part"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
    )
    out = scored.drop("tail").join(looked, "row", "left")
    part = F.coalesce("_part", F.lit(0.0))
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + part).alias("base_score"),
        (F.col("score") + part).alias("score"),
    )
