"""Packing documents into training windows by best-fit decreasing.

A document's token ids, and one end id, are cut into full windows and a rest. Full windows are
sequences of their own. Rests are dealt by hash into groups of a bounded size, and each group
packs its own: longest first, each into the open window with the least room that still
takes it, found by a segment tree indexed by remaining room.

Words repeat, so a task keeps the ids of the pieces it has seen, up to a fixed number. Texts are taken apart only
where a byte-level vocabulary starts a new pre-token in any case: before a blank that a word follows, around line ends,
and before a last punctuation mark. A text with other white space is tokenised as a whole.

Defined results: a null or empty text is one piece with the end id alone. Equal rows are packed one
by one. No document leaves no sequence. Other columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WINDOW = 2048
END_ID = 1
#: Rests a group packs together; bounds a task, and a group leaves about one half-empty window.
GROUP = 4096
#: Pieces of text whose ids a Python worker keeps.
CACHE = 500_000

#: White space other than single blanks and line ends: such texts are tokenised as a whole.
_OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_DOUBLE_SPACE = ("  ", "\n\n", " \n", "\n ")
_RUNS = re.compile(r"[ \n]+|[^ \n]+")
#: Last characters that are a pre-token of their own after letters.
_ENDINGS = frozenset(".,;:!?")
#: Letters below this are the same in all versions of Unicode in use.
_SETTLED = "\u0530"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stay, others follow 255 in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


_BYTE_LETTERS = _byte_letters()


class PieceIds:
    """Ids of pieces of text, as little-endian 32-bit bytes, learned as they come.

    ``after`` holds words that follow a blank, whose ids include the blank; ``bare`` all other pieces.
    """

    def __init__(self, path: str, size: int = CACHE):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.size = Tokenizer.from_file(path), size
        before = self.tokenizer.pre_tokenizer
        self.byte_level = self.tokenizer.normalizer is None and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.after: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str], blank: str) -> Iterator[tuple[str, bytes]]:
        """All at once, a line each: a line end between two words is a token of its own."""
        if not words:
            return
        ids = np.asarray(self.tokenizer.encode("\n".join([blank + w for w in words]), add_special_tokens=False).ids, "<u4")
        ends = [*np.flatnonzero(ids == self.line_end[0]).tolist(), len(ids)]
        if len(ends) != len(words) or len(self.line_end) != 1:
            raise ValueError("the vocabulary needs one token for a line end")
        raw, at = ids.tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            yield w, raw[4 * at : 4 * end]
            at = end + 1

    def _merge(self, words: list[str], blank: str) -> Iterator[tuple[str, bytes]]:
        """Words that are one pre-token each, by the merges alone."""
        tokenize, written = self.tokenizer.model.tokenize, blank.translate(_BYTE_LETTERS)
        for w in words:
            # Letters of ASCII stand for themselves.
            tokens = tokenize(written + w if w.isascii() else written + w.encode().decode("latin-1").translate(_BYTE_LETTERS))
            yield w, _little(array("I", [t.id for t in tokens]))

    def full(self) -> bool:
        return len(self.after) + len(self.bare) > self.size

    def clear(self) -> None:
        self.after.clear()
        self.bare.clear()

    def learn(self, after: set[str], bare: set[str]) -> None:
        for known, wanted, blank in ((self.after, after, " "), (self.bare, bare, "")):
            letters, mixed, ended = set(), [], []
            for w in wanted.difference(known):
                stem = w[:-1] if w[-1:] in _ENDINGS else w
                if not stem.isalpha() or not (stem.isascii() or max(stem) < _SETTLED):
                    mixed.append(w)
                else:
                    if stem not in known:
                        letters.add(stem)
                    if stem is not w:
                        ended.append(w)
            plain = [w for w in mixed if w and not w.isspace()]
            known.update((w, self.whole(w)) for w in mixed if not w or w.isspace())
            if self.byte_level:
                known.update(self._merge(list(letters), blank))
            else:
                plain += letters
            for at in range(0, len(plain), 20_000):
                known.update(self._encode(plain[at : at + 20_000], blank))
            for w in ended:
                if w[-1] not in self.bare:
                    self.bare[w[-1]] = self.whole(w[-1])
                known[w] = known[w[:-1]] + self.bare[w[-1]]


_workers: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """One per Python worker."""
    if path not in _workers:
        _workers[path] = PieceIds(path)
    return _workers[path]


def _split(text: str) -> list[tuple[bool, list[str]]] | None:
    """The text as (do these follow a blank, pieces); null if it must be tokenised as a whole."""
    if "<|" in text:
        return None
    # Searches for fixed strings pass over a text many times faster than a pattern.
    if any(c in text for c in _OTHER_SPACE):
        return None
    if not any(c in text for c in _DOUBLE_SPACE) and text[:1] not in ("", " ", "\n") and text[-1] not in " \n":
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out.append((False, ["\n", first] if k else [first]))
            out.append((True, rest))
        return out
    out, blank = [], False
    for m in _RUNS.finditer(text):
        run = m.group()
        if run[0] not in " \n":
            out.append((blank, [run]))
            blank = False
        elif m.end() == len(text):
            out.append((False, [run]))
        else:
            # The last blank before a word belongs to the word; what is before it is one pre-token.
            blank = run[-1] == " "
            out.append((False, [x for x in (run[:-1], "" if blank else "\n") if x]))
    return out


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Looks every piece up once; what is unknown is learned together, and put in its place."""
    ids = piece_ids(path)
    if ids.full():
        ids.clear()
    out: list[list[bytes]] = []
    gaps: dict[bool, list[tuple[int, int, str]]] = {True: [], False: []}
    for k, t in enumerate(texts):
        parts = _split(t)
        found: list[bytes] = []
        for blank, pieces in parts if parts is not None else ():
            here = list(map((ids.after if blank else ids.bare).get, pieces))
            if None in here:
                at = len(found)
                gaps[blank] += [(k, at + i, pieces[i]) for i, x in enumerate(here) if x is None]
            found += here
        out.append(found if parts is not None else [ids.whole(t)])
    ids.learn({p for _, _, p in gaps[True]}, {p for _, _, p in gaps[False]})
    for blank, known in ((True, ids.after), (False, ids.bare)):
        for k, at, p in gaps[blank]:
            out[k][at] = known[p]
    return [b"".join(x) for x in out]


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids; all but a document's last are full. With ``with_ids`` also the ids."""
    end = np.asarray([end_id], "<u4").tobytes()
    schema = _schema(with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                out = []
                for doc_id, ids in zip(part["doc_id"], encode_texts([t or "" for t in part["text"]], tokenizer_path), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        own = ids[4 * s : 4 * (s + window)]
                        out.append((doc_id, s, len(own) // 4, zlib.crc32(own), n, own)[: len(schema)])
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ddl(schema))


def _schema(with_ids: bool, *more: str) -> pa.Schema:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, *more]
    return pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


class OpenWindows:
    """Open windows by remaining room, under a segment tree that finds the least room of at least n."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.at[room].append(number)
        i = self.leaves + room
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, number) of the tightest window for ``n`` ids, which leaves the tree."""
        i = self.leaves + n
        if not self.tree[i]:
            # Up to the first ancestor with a filled right sibling, then down its left side.
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        number = self.at[room].pop()
        if not self.at[room]:
            while i and not (i < self.leaves and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return room, number


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; lengths must fall."""
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, count = OpenWindows(window), 0
    for k, n in enumerate(lengths.tolist()):
        found = opened.take(n)
        if found is None:
            room, at = window, count
            count += 1
        else:
            room, at = found
        number[k], offset[k] = at, window - room
        if room > n:
            opened.add(room - n, at)
    return number, offset


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    group: int = GROUP,
    with_ids: bool = False,
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Pieces of one sequence lie gaplessly from offset 0. The texts are tokenised once; the pieces are
    stored and only they are grouped.
    """
    ws = Workspace.of(docs.sparkSession, workspace)
    pieces = ws.keep(cut_pieces(docs, tokenizer_path, window=window, end_id=end_id, with_ids=with_ids))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = _schema(with_ids, "sequence_id", "offset")
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        number, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        first = table["_group"][0].as_py() * 2**32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(first + number)).append_column("offset", pa.array(offset)).cast(schema)

    return dealt.groupBy("_group").applyInArrow(run, _ddl(schema))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed windows themselves, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select("sequence_id", "length", joined.alias("ids"))
