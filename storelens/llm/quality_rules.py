"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule is a conjunction of thresholds, grown by information gain
on two thirds of the labelled rows and pruned on the rest. Rows that a rule covers leave
the data before the next rule grows. The list becomes one ordered ``CASE WHEN``.

All work over rows is DataFrame code. Each growing step reads one histogram of
(feature, bin, class, part), whose size depends on the number of features and
thresholds only, so the driver never sees rows.

Defined results: a null text counts as empty; features of an empty text are 0. Labels that
are null, or of documents that aren't there, teach nothing; where a document has several
labels the lowest counts. Without labels of both classes the list is empty and only the
base checks reject.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, Workspace, let, words

# The base checks.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Inputs of the learned list: numerator and denominator, both statistics of one text.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
}


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows are compared by 64-bit hash."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"]))

        def span(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, starts), span)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))

    def windows(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))

    return F.when(F.size(w) >= 4, let(w, lambda x: let(windows(x), of))).otherwise(F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and the counts behind the rules. No shuffle."""
    # An own name for the words keeps them computed once, for two uses.
    d = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    d = d.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(NOT_SPACE))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    dup_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    d = d.select(
        id_column,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - count(SPACE)).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        dup_lines.alias("_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_exclaim"),
        count("[0-9]").alias("n_digits"),
    )
    return d.select("*", F.col("_lines.dup").cast("long").alias("n_dup_lines"), F.col("_lines.n").cast("long").alias("n_lines")).drop("_lines")


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def features() -> dict[str, Column]:
    return {k: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), F.lit(0.0)) for k, (n, d) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold``."""

    feature: str
    above: bool
    bin: int
    threshold: float

    def on_value(self) -> Column:
        f = features()[self.feature]
        return f >= self.threshold if self.above else f < self.threshold

    def on_bin(self) -> Column:
        b = F.col(f"bin_{self.feature}")
        return b >= self.bin if self.above else b < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered_bad: int
    covered_good: int

    def column(self) -> Column:
        return _all(c.on_value() for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _histogram(rows: DataFrame) -> dict[tuple[str, int, int, bool], int]:
    """Rows by (feature, bin, class, growing part)."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES]))
    counted = rows.select("bad", "grow", cells.alias("c")).groupBy("c.feature", "c.bin", "bad", "grow").count()
    return {(r["feature"], r["bin"], r["bad"], r["grow"]): r["count"] for r in counted.collect()}


def _candidates(h: dict, thresholds: dict[str, list[float]], grow: bool):
    """(condition, covered bad, covered good) of every single condition."""
    for f, cuts in thresholds.items():
        at = [[h.get((f, b, bad, grow), 0) for b in range(len(cuts) + 1)] for bad in (1, 0)]
        total = [sum(x) for x in at]
        for k, t in enumerate(cuts, 1):
            below = [sum(x[:k]) for x in at]
            yield Condition(f, True, k, t), total[0] - below[0], total[1] - below[1]
            yield Condition(f, False, k, t), below[0], below[1]


def _gain(bad: int, good: int, bad0: int, good0: int, cost: float) -> float:
    """Bits gained about the covered bad rows; a good row weighs ``cost`` bad ones."""
    if bad == 0 or bad0 == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + cost * good)) - math.log2(bad0 / (bad0 + cost * good0)))


def _cuts(values: Iterable[float]) -> list[float]:
    """Thresholds from quantiles. Where many rows are 0, one lies half way to the least other value: a trace of something is not yet it."""
    found = set(values)
    above = {x for x in found if x > 0}
    return sorted(above | ({min(above) / 2} if above and 0.0 in found else set()))


def learn_rules(
    statistics: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    label_column: str = "quality",
    *,
    cuts: int = 12,
    max_conditions: int = 4,
    max_rules: int = 24,
    cost: float = 100.0,
    min_precision: float = 0.97,
    min_share: float = 0.0005,
    workspace: Workspace | None = None,
) -> list[Rule]:
    """Rules for the class ``label_column = 0``, in order.

    ``cuts``: thresholds per feature and class, at equal steps of rank. ``cost``: how many rejected bad
    documents a rejected good one outweighs. Rows that fail the base checks teach nothing. A rule stays while its
    pruned form covers at least ``min_share`` of the pruning rows' bad ones and has at least
    ``min_precision`` there; the first that doesn't ends the list, as does ``max_rules``.
    """
    ws = Workspace.of(statistics.sparkSession, workspace)
    truth = labels.groupBy(id_column).agg(F.min(label_column).alias("_label")).where(F.col("_label").isin(0, 1))
    values = features()
    known = statistics.where(~base_failed()).join(truth, id_column).select(
        (F.col("_label") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64(id_column), F.lit(3)) != 0).alias("grow"),
        *[v.alias(k) for k, v in values.items()],
    )
    known = ws.keep(known)
    at = [(i + 0.5) / cuts for i in range(cuts)]
    found = known.groupBy("bad").agg(*[F.percentile_approx(k, at, 10_000).alias(k) for k in FEATURES]).collect()
    if len(found) < 2:
        return []
    thresholds = {k: _cuts(x for r in found for x in r[k]) for k in FEATURES}
    bins = [sum(((F.col(k) >= t).cast("int") for t in v), F.lit(0)).alias(f"bin_{k}") for k, v in thresholds.items()]
    binned = ws.keep(known.select("bad", "grow", *bins))

    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        rows = left
        path = []  # what the pruning part holds after each condition
        while len(conditions) < max_conditions:
            h = _histogram(rows)
            first = next(iter(FEATURES))
            here = [sum(n for (f, _, b, g), n in h.items() if f == first and b == bad and g) for bad in (1, 0)]
            if not here[0] or not here[1]:
                break
            options = sorted(((_gain(b, g, *here, cost), -g, c.bin if c.above else -c.bin, str(c), c, b, g) for c, b, g in _candidates(h, thresholds, True)), key=lambda x: x[:4])
            # Of equal conditions the one furthest from the rows that it leaves.
            gain, _, _, _, best, bad, good = options[-1]
            if gain <= 1e-9 or (bad, good) == tuple(here):
                break
            held = next((b, g) for c, b, g in _candidates(h, thresholds, False) if c == best)
            if conditions and held == path[-1] and good == here[1]:
                break
            conditions.append(best)
            path.append(held)
            rows = rows.where(best.on_bin())
            if not good:
                break
        if not conditions:
            break
        all_bad = _pruning_bad(left)
        score = [(b - cost * g) / (b + cost * g) if b + g else -1.0 for b, g in path]
        best_length = max(range(len(path)), key=lambda i: (score[i], -i))
        bad, good = path[best_length]
        if bad < max(1, min_share * all_bad) or bad / (bad + good) < min_precision:
            break
        conditions = conditions[: best_length + 1]
        rules.append(Rule(tuple(conditions), bad, good))
        left = left.where(~_all(c.on_bin() for c in conditions))
    return rules


def _pruning_bad(rows: DataFrame) -> int:
    return rows.where(~F.col("grow") & (F.col("bad") == 1)).count()


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row of statistics, else null: one ordered conditional."""
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(k))
    return out


def judge(docs: DataFrame, labels: DataFrame, *, workspace: Workspace | None = None, **learning) -> DataFrame:
    """Statistics and verdict of every document.

    Returns ``doc_id``, the counts, ``base_failed``, ``rule`` (number of the learned rule that
    rejects it, else null), ``rule_text`` and ``kept``. The texts are read once; the learner works
    on the stored statistics.
    """
    ws = Workspace.of(docs.sparkSession, workspace)
    stats = ws.keep(text_statistics(docs))
    rules = learn_rules(stats, labels, workspace=ws, **learning)
    named = F.lit(None).cast("string")
    for k, r in reversed(list(enumerate(rules, 1))):
        named = F.when(F.col("rule") == k, F.lit(str(r))).otherwise(named)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("rule_text", named).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, workspace: Workspace | None = None, **learning) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Texts are worked out once, stored beside their statistics, and never shuffled."""
    ws = Workspace.of(docs.sparkSession, workspace)
    row = F.struct(*[docs[c].alias(f"_{k}") for k, c in enumerate(docs.columns)])
    packed = docs.select(F.struct(row.alias("row"), docs["doc_id"].alias("doc_id")).alias("_row"), docs["text"].alias("text"))
    stored = ws.keep(text_statistics(packed, "_row"))
    rules = learn_rules(stored.select(F.col("_row.doc_id").alias("doc_id"), *[c for c in stored.columns if c != "_row"]), labels, workspace=ws, **learning)
    judged = stored.where(~base_failed() & verdict(rules).isNull())
    return judged.select(*[F.col(f"_row.row._{k}").alias(c) for k, c in enumerate(docs.columns)])
