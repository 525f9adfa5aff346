"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of bytes. Two gated recurrent layers, one forward and one backward, read
each segment, and every byte gets language probabilities from both states. A document's probabilities are the
mean over all its bytes. The network is trained in numpy by backpropagation through time.

Training takes at most ``per_language`` documents of each language, those of least hash: a bounded
sample, so the fit is one task of fixed size. Prediction reads whole texts, a batch of segments at a time.

Gates use x / (1 + |x|) in place of tanh, and half of that plus a half as the sigmoid: both are cheap in
numpy. The reset gate acts after the recurrent product.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and whenever no language was
learned. Equal rows are predicted one by one. A null doc_id counts as the empty text in the hold-out rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
HIDDEN = 8
SEGMENT = 96
PER_LANGUAGE = 300
#: The most frequent languages, so many at most, are learned: the output layer and the training sample grow with them.
MAX_LANGUAGES = 500
#: Segments of one document used in training, spread evenly.
SEGMENTS_EACH = 6
STEPS, BATCH, RATE, SEED = 160, 128, 0.02, 17
#: Segments per numpy batch in prediction, for up to sixteen languages; fewer for more.
ROWS = 2048


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Per direction: input table (256, 3H), recurrent (H, 3H), its bias (3H); then the output layer. Gates: update, reset, candidate."""

    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: int, hidden: int, rng: np.random.Generator) -> Network:
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.5, (256, 3 * hidden))
            p[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"c{d}"] = np.zeros(3 * hidden)
        p["o"] = rng.normal(0, 0.3, (2 * hidden, languages))
        p["oc"] = np.zeros(languages)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @property
    def hidden(self) -> int:
        return self.params["uf"].shape[0]

    def _run(self, data: np.ndarray, d: str, keep: list | None = None, mask: np.ndarray | None = None) -> np.ndarray:
        """States (time, row, H) of one direction over bytes (time, row); padding, where ``mask`` is 0, leaves no trace."""
        p, n = self.params, self.hidden
        x, u, c = p[f"x{d}"], p[f"u{d}"], p[f"c{d}"]
        h = np.zeros((data.shape[1], n), np.float32)
        out = np.empty((*data.shape, n), np.float32)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            a = x[data[t]]
            r = h @ u
            r += c
            gates = a[:, : 2 * n] + r[:, : 2 * n]
            g = gates / (1 + np.abs(gates))
            g *= 0.5
            g += 0.5
            z, reset = g[:, :n], g[:, n:]
            pre = a[:, 2 * n :] + reset * r[:, 2 * n :]
            new = pre / (1 + np.abs(pre))
            before = h
            h = new + z * (h - new)
            if mask is not None and d == "b":
                h *= mask[t][:, None]
            out[t] = h
            if keep is not None:
                keep.append((t, before, r[:, 2 * n :], gates, z, reset, pre, new))
        return out

    def _output(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        n = self.hidden
        y = forward @ self.params["o"][:n]
        y += backward @ self.params["o"][n:]
        y += self.params["oc"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def label(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Language probabilities of every byte: (time, row, language)."""
        return self._output(self._run(data, "f"), self._run(data, "b", mask=mask))

    def gradients(self, data: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes of the mask, and its gradients by backpropagation through time."""
        p, n = self.params, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = self._run(data, "f", kept["f"]), self._run(data, "b", kept["b"], mask)
        y = self._output(f, b)
        weight = mask / mask.sum()
        rows = np.arange(data.shape[1])
        loss = -float((np.log(y[:, rows, truth] + 1e-12) * weight).sum())
        dy = y
        dy[:, rows, truth] -= 1
        dy *= weight[..., None]
        flat = dy.reshape(-1, dy.shape[-1])
        grads = {"o": np.concatenate([f.reshape(-1, n).T @ flat, b.reshape(-1, n).T @ flat]), "oc": flat.sum(0)}
        for d, states_weight in (("f", p["o"][:n]), ("b", p["o"][n:])):
            u = p[f"u{d}"]
            into = dy @ states_weight.T
            dx, du, dc = np.zeros_like(p[f"x{d}"]), np.zeros_like(u), np.zeros_like(p[f"c{d}"])
            carry = np.zeros((data.shape[1], n), np.float32)
            for t, before, rec, gates, z, reset, pre, new in reversed(kept[d]):
                dh = (into[t] + carry) * mask[t][:, None]
                dz = dh * (before - new)
                dpre = dh * (1 - z) / (1 + np.abs(pre)) ** 2
                dreset = dpre * rec
                dgates = np.concatenate([dz, dreset], axis=1) * 0.5 / (1 + np.abs(gates)) ** 2
                da = np.concatenate([dgates, dpre], axis=1)
                dr = np.concatenate([dgates, dpre * reset], axis=1)
                np.add.at(dx, data[t], da)
                du += before.T @ dr
                dc += dr.sum(0)
                carry = dh * z + dr @ u.T
            grads |= {f"x{d}": dx, f"u{d}": du, f"c{d}": dc}
        return loss, grads


def segments(text: str, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in rows of ``size``, zero-padded, and the length of each row."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows = -(-len(raw) // size)
    data = np.zeros(rows * size, np.uint8)
    data[: len(raw)] = raw
    lengths = np.full(rows, size)
    if rows:
        lengths[-1] = len(raw) - (rows - 1) * size
    return data.reshape(rows, size), lengths


def fit(texts: list[str], truth: list[int], languages: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    picked = [picked_segments(t) for t in texts]
    data, lengths = np.concatenate([d for d, _ in picked]), np.concatenate([n for _, n in picked])
    labels = np.repeat(np.array(truth, np.int64), [len(n) for _, n in picked])
    return fit_segments(data, lengths, labels, languages, hidden, steps, seed)


def picked_segments(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a text that are used in training, and their lengths."""
    d, n = segments(text)
    pick = np.unique(np.linspace(0, len(d) - 1, min(len(d), SEGMENTS_EACH)).astype(int)) if len(d) else np.zeros(0, int)
    return d[pick], n[pick]


def fit_segments(data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    net = Network.new(languages, hidden, rng)
    by_language = [np.flatnonzero(labels == k) for k in range(languages)]
    by_language = [x for x in by_language if len(x)]
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        # Languages in equal parts, however common they are.
        rows = np.concatenate([rng.choice(x, max(1, BATCH // len(by_language))) for x in by_language])
        seen = data[rows].T
        mask = (np.arange(data.shape[1])[:, None] < lengths[rows][None, :]).astype(np.float32)
        _, grads = net.gradients(seen, mask, labels[rows])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            net.params[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MAX_LANGUAGES) -> tuple[list[str], Network] | None:
    """Languages and the network, learned from (doc_id, text, lang) rows.

    Of more than ``most`` lang values those with the most documents are learned, ties in their order; the
    others are never predicted.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(most).collect())
    if not languages:
        return None
    usable = usable.where(F.col("lang").isin(languages)) if len(languages) == most else usable
    # The limit by rank reaches the scan's tasks, so a common language is cut down before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), F.xxhash64("text")))
    sample = usable.select("lang", "text", rank.alias("rank")).where(F.col("rank") <= per_language)
    number = {x: k for k, x in enumerate(languages)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the segments that are learned from go to the one task that learns."""
        for batch in batches:
            rows = [(lang, rank, text, *picked_segments(text)) for lang, rank, text in zip(*(batch[c].to_pylist() for c in ("lang", "rank", "text")), strict=True)]
            columns = [[number[r[0]] for r in rows], [r[1] for r in rows], [r[3].tobytes() for r in rows], [r[4].tolist() for r in rows]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["language", "rank", "data", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["language"], r["rank"], bytes(r["data"]), r["lengths"]) for b in batches for r in b.to_pylist())
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        lengths = np.array([n for r in rows for n in r[3]], np.int64)
        labels = np.repeat([r[0] for r in rows], [len(r[3]) for r in rows])
        net = fit_segments(data.reshape(len(lengths), -1), lengths, labels, len(languages))
        yield pa.record_batch([pa.array(list(net.params)), pa.array([v.astype("<f4").tobytes() for v in net.params.values()])], names=["name", "data"])

    sample = sample.mapInArrow(cut, "language int, rank int, data binary, lengths array<long>")
    found = {r["name"]: np.frombuffer(bytes(r["data"]), "<f4") for r in sample.repartition(1).mapInArrow(run, "name string, data binary").collect()}
    hidden = len(found["cf"]) // 3
    shapes = {"x": (256, 3 * hidden), "u": (hidden, 3 * hidden), "c": (3 * hidden,)}
    params = {k: v.reshape(shapes[k[0]] if k[0] != "o" else (2 * hidden, len(languages)) if k == "o" else (len(languages),)) for k, v in found.items()}
    return languages, Network(params)


def predict(docs: DataFrame, model: tuple[list[str], Network] | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of (doc_id, text, held_out) rows."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def probabilities(net: Network, texts: list[str]) -> np.ndarray:
        """Mean over the bytes of each text."""
        cut = [segments(t) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(d) for d, _ in cut])
        data, lengths = np.concatenate([d for d, _ in cut]), np.concatenate([n for _, n in cut])
        total = np.zeros((len(texts), len(net.params["oc"])))
        # Rows of like length go together, so short ones cost little padding.
        order = np.argsort(lengths, kind="stable")
        step = max(32, ROWS * 16 // max(16, total.shape[1]))
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            longest = int(lengths[rows[-1]])
            mask = (np.arange(longest)[:, None] < lengths[rows][None, :]).astype(np.float32) if lengths[rows[0]] < longest else None
            y = net.label(np.ascontiguousarray(data[rows, :longest].T), mask)
            if mask is not None:
                y *= mask[..., None]
            np.add.at(total, doc[rows], y.sum(axis=0))
        return total / np.maximum(np.bincount(doc, lengths, len(texts)), 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch["text"].to_pylist()
                there = [k for k, t in enumerate(texts) if model and t is not None and letter.search(t)]
                named, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if there:
                    p = probabilities(model[1], [texts[k] for k in there])
                    for k, best, value in zip(there, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        named[k], score[k] = model[0][best], min(1.0, value)
                yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(named), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    d = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(d.where(~F.col("held_out")), per_language)
    return predict(d, model)
