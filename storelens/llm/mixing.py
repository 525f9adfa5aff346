"""Mixing sources to target weights along a curriculum.

Every source has a share of a word budget and a schedule: weights at points of the training
run, linear in between. The integral of the schedule, scaled to the source's target, is the
words wanted of it up to each moment. A source's documents form a stream in hash order, one
pass after another; a document's offset in the stream, put through the inverse of that
integral, is its training position. Sorting by position mixes the sources.

Running sums over a source take two levels: about sqrt(n) buckets of about sqrt(n) documents,
so neither level gathers a hot source in one task. The table of sources has a row per source
and is the only thing ranked as a whole.

Defined results: a null text has size 0; null sources form one source, ranked last. Documents of
size 0 take no words and have no copy. Equal rows count one by one. Other columns are carried
along only if named in ``payload``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, Workspace, n_words, pack, unpack

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_PASSES = 2.0
#: By weight: (moment of training, relative weight then). Heavy sources lead, light ones follow.
SCHEDULES = {5.0: ((0.0, 1.5), (1.0, 0.5)), 2.0: ((0.0, 1.0), (1.0, 1.0)), 1.0: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_passes: float = MAX_PASSES) -> DataFrame:
    """source, source_size, n_docs, weight, target: one row per source.

    The budget is filled like water: by rising size per weight, a source whose limit lies
    below its share of what is left takes its limit, all others share the rest by weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row per source in one task.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), rank % len(weights)))
    s = s.withColumn("_limit", max_passes * F.col("source_size"))
    rising = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    s = s.withColumn("_level", (budget * total - before) / left)
    # The level rises while sources reach their limit and falls afterwards.
    level = F.max("_level").over(everything)
    return s.select("source", "source_size", "n_docs", "weight", F.least("_limit", F.col("weight") * level).alias("target"))


def moment(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """When a source has supplied ``share`` of its target: the inverse of its schedule's integral."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))
    out, done = None, 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        width, part = t1 - t0, (t1 - t0) * (w0 + w1) / 2
        y = F.greatest(share * area - done, F.lit(0.0))
        # y = w0 x + (w1 - w0) x^2 / (2 width), solved for x in a form that stays exact for w0 = w1.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * (w1 - w0) / width * y, F.lit(0.0)))
        at = F.least(t0 + F.coalesce(F.try_divide(2 * y, w0 + root), F.lit(0.0)), F.lit(t1))
        done += part
        out = F.when(share * area <= done, at) if out is None else out.when(share * area <= done, at)
    return out.otherwise(F.lit(float(schedule[-1][0])))


def plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_passes: float = MAX_PASSES,
    schedules: dict[float, Sequence[tuple[float, float]]] = SCHEDULES,
    payload: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of each document, one row per document.

    Returns doc_id, source, ``payload``, size, source_size, target, taken (words, repeats counted),
    copies (an array of (pass, words, position), position from 0 to 1) and position (of the first copy,
    null without one). A source's taken words add up to its target, rounded: the last copy is cut.
    """
    extra = [c for c in dict.fromkeys(payload) if c not in ("doc_id", "source", "size")]
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *[F.struct(*extra).alias("_payload")] * bool(extra))
    return _planned(sized, extra, weights, budget, max_passes, schedules)


def _planned(
    sized: DataFrame,
    extra: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_passes: float = MAX_PASSES,
    schedules: dict[float, Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """``plan`` from rows (doc_id, source, size), with ``extra`` columns in a struct ``_payload``."""
    per_source = targets(sized.select("source", "size"), weights, budget, max_passes)
    per_source = per_source.withColumnRenamed("source", "_source")
    d = sized.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / 2.0**32
    d = d.withColumn("_hash", hashed).withColumn("_bucket", F.floor(part * F.ceil(F.sqrt("n_docs"))))
    sums = sized.select("doc_id", "source", "size").join(per_source.select("_source", "n_docs"), F.col("source").eqNullSafe(F.col("_source")))
    sums = sums.withColumn("_bucket", F.floor(part * F.ceil(F.sqrt("n_docs")))).groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    wanted = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")

    def copy(k: Column) -> Column:
        offset = k * F.col("source_size") + F.col("_before")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), wanted - offset))
        share = F.coalesce(F.try_divide(offset + taken / 2, F.col("target")), F.lit(0.0))
        when = F.lit(None).cast("double")
        for weight, schedule in schedules.items():
            when = F.when(F.col("weight") == weight, moment(schedule, share)).otherwise(when)
        return F.struct(k.cast("int").alias("pass"), taken.cast("long").alias("words"), F.coalesce(when, share).alias("position"))

    every = F.transform(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0))), copy)
    d = d.withColumn("copies", F.filter(every, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return d.select(
        "doc_id", "source", *[F.col(f"_payload.{c}").alias(c) for c in extra],
        "size", "source_size", "target", taken.alias("taken"), "copies",
        F.get("copies", F.lit(0))["position"].alias("position"),
    )


def curriculum(docs: DataFrame, *, workspace: Workspace | None = None, **options) -> DataFrame:
    """The mixed documents themselves, a row per copy, range-sorted by training position.

    Columns are those of ``docs``. The one copy of a source that its target cuts
    short holds the words up to the cut; ``n_chars``, if there, follows. The rows are stored once with their
    sizes and a number each; planning reads sizes only, and the texts join its result by number.
    """
    ws = Workspace.of(docs.sparkSession, workspace)
    apart = ["doc_id", "source", "text", *["n_chars"] * ("n_chars" in docs.columns)]
    rows = ws.keep(pack(docs, *apart).select("*", n_words(F.col("text")).alias("_size"), F.monotonically_increasing_id().alias("_number")))
    sized = rows.select("doc_id", "source", F.col("_size").alias("size"), F.struct("_number").alias("_payload"))
    planned = ws.keep(_planned(sized, ["_number"], **options).where(F.size("copies") > 0).select("_number", "copies"))
    c = rows.join(planned, "_number").withColumn("_copy", F.explode("copies"))
    cut = F.col("_copy.words") < F.col("_size")
    # Each part ends where a word ends, so the first k parts hold the first k words.
    parts = F.split("text", f"(?<={NOT_SPACE})(?={SPACE})")
    head = F.array_join(F.slice(parts, F.lit(1), F.col("_copy.words").cast("int")), "")
    c = c.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        c = c.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unpack(c.orderBy("_copy.position", "_copy.pass", "doc_id"), docs.columns, *apart)
