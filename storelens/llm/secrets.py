"""Secret scans with an incremental ledger of blobs.

Each version of a text is addressed by its SHA-256. The ledger remembers which (blob, rule
version) pairs were scanned and what was found, so a scan touches only pairs it has not seen:
copies of a text, old versions and unchanged rules cost nothing again. Findings are joined back to every path
and version that holds the blob.

All steps are DataFrame code. A blob's copies are reduced to one before its text is shuffled.
A ledger is a folder of four appended tables (texts, versions, findings, scanned). It holds each blob's text once, so
that a changed rule reaches every known blob; only pairs whose text was read are marked. ``scanned`` is written last:
a scan that breaks off is done again, and findings written twice count once.

Offsets are code points, the end is exclusive. Defined results: a null text is the empty blob; equal rows
of a version stay equal rows; a blob without findings has no row in ``findings``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, pack, unpack


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` matches, leftmost first and without overlap; shorter captures of ``group`` than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which kinds are listed. Runs are maximal, so a
# least length may stand in the pattern, but for the first rule, whose short captures use up text.
BASE = (
    SecretRule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", 1, r"[0-9a-f]{24,}"),
)
#: More kinds with an unmistakable form.
MORE = (
    SecretRule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    SecretRule("hub_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

_SCHEMAS = {
    "findings": "blob string, rule string, start long, end long",
    "scanned": "blob string, rule string",
    "texts": "blob string, text string, scan string",
}


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(r: SecretRule) -> Column:
    """For each match: the rule, its number, what lies between it and the one before, its length, whether it counts."""
    between, found = F.split("text", r.pattern), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else found

    def row(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(r.name).alias("rule"), i.alias("nth"), F.length(x["b"]).alias("gap"),
            F.length(x["f"]).alias("long"), (F.length(x["v"]) >= r.least).alias("good"),
        )

    return F.transform(F.arrays_zip(between.alias("b"), found.alias("f"), value.alias("v")), row)


def find_spans(blobs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """blob, rule, start, end of every finding in ``blobs`` (blob, text, todo: names of the rules to apply)."""
    hits = [F.when(F.array_contains("todo", r.name) & F.col("text").rlike(r.pattern), _matches(r)) for r in rules]
    every = F.concat(*[F.coalesce(h, F.array().cast("array<struct<rule:string,nth:int,gap:int,long:int,good:boolean>>")) for h in hits])
    one = blobs.select("blob", F.explode(every).alias("h")).select("blob", "h.*").where(F.col("long").isNotNull())
    # What lies before a match: the gaps up to it and all earlier matches, dropped ones too.
    order = Window.partitionBy("blob", "rule").orderBy("nth")
    passed = F.sum(F.col("gap") + F.col("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = one.withColumn("end", passed.cast("long")).where("good")
    return one.select("blob", "rule", (F.col("end") - F.col("long")).alias("start"), "end")


class BlobLedger:
    """Scanned blobs in ``folder``, which every executor must reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _stored(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], _SCHEMAS[name])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}") if there else empty

    def _read(self, name: str) -> DataFrame:
        return self._stored(name).distinct()

    def scan(self, versions: DataFrame, rules: Sequence[SecretRule] = RULES) -> None:
        """Take in rows of (path, version, text) and scan every known blob under the rules it was not scanned with."""
        addressed = versions.withColumn("blob", blob_of(F.col("text")))
        names, own = F.array(*[F.lit(r.name) for r in rules]), uuid.uuid4().hex
        one = addressed.groupBy("blob").agg(F.coalesce(F.first("text", ignorenulls=True), F.lit("")).alias("text"))
        one.join(self._stored("texts").select("blob"), "blob", "left_anti").write.parquet(f"{self.folder}/texts/scan={own}")
        addressed.select("path", "version", "blob").write.mode("append").parquet(f"{self.folder}/versions")
        texts = self._stored("texts")
        older, newer = texts.where(F.col("scan") != own), texts.where(F.col("scan") == own)
        with Workspace(self.spark) as ws:
            done = self._read("scanned").groupBy("blob").agg(F.collect_set("rule").alias("done"))
            todo = older.select("blob").join(done, "blob", "left")
            todo = todo.select("blob", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
            todo = ws.keep(todo.where(F.size("todo") > 0))
            rows = newer.select("blob", "text", names.alias("todo")).unionByName(older.select("blob", "text").join(todo, "blob"))
            find_spans(rows, rules).write.mode("append").parquet(f"{self.folder}/findings")
            pairs = newer.select("blob", names.alias("todo")).unionByName(todo)
            pairs.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.folder}/scanned")

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/versions")

    def findings(self, rules: Sequence[SecretRule] = RULES) -> DataFrame:
        """blob, kind, rule, start, end under the given rule versions."""
        found = self._read("findings").where(F.col("rule").isin([r.name for r in rules]))
        return found.withColumn("kind", F.substring_index("rule", "@", 1))

    def by_path(self, rules: Sequence[SecretRule] = RULES) -> DataFrame:
        """path, version, kind, start, end: every finding in every version that holds it."""
        return self.versions().join(self.findings(rules), "blob").select("path", "version", "kind", "start", "end")


def _number(kind: str) -> Column:
    return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")


def scan_documents(docs: DataFrame, rules: Sequence[SecretRule] = RULES, base: Sequence[SecretRule] = BASE, *, ledger: BlobLedger | None = None, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, n_<kind> per base kind, base_sha256 and spans of each document, one row per row of ``docs``."""
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, f"{Workspace.of(spark, workspace).path}/ledger")
    ledger.scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), rules)
    place = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    spans = ledger.findings(rules).withColumn("place", place[F.col("rule")])
    listed = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("s"))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = [r.kind for r in base]
    listed = listed.select(
        "blob",
        *[_number(k).alias(f"n_{k}") for k in kinds],
        F.sha2(written(F.filter("s", lambda x: x["kind"].isin(kinds))), 256).alias("base_sha256"),
        written(F.col("s")).alias("spans"),
    )
    out = ledger.versions().join(listed, "blob", "left")
    return out.select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in kinds],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, rules: Sequence[SecretRule] = RULES, mark: str = "[SECRET]", *, workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; ``n_chars``, if there, follows."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, f"{Workspace.of(spark, workspace).path}/ledger")
    ledger.scan(docs.select(F.lit(None).cast("long").alias("path"), F.lit(0).alias("version"), "text"), rules)
    # Overlapping findings of several kinds become one island.
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = ledger.findings(rules).select("blob", "start", "end")
    found = found.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    found = found.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = found.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    islands = islands.groupBy(F.col("blob").alias("_blob")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_islands"))
    apart = ["text", *["n_chars"] * ("n_chars" in docs.columns)]
    d = pack(docs, *apart).withColumn("_b", blob_of(F.col("text"))).join(islands, F.col("_b") == F.col("_blob"), "left")
    n = F.size("_islands")
    begin = lambda i: F.coalesce(F.get("_islands", i - 1)["end"], F.lit(0))
    stop = lambda i: F.coalesce(F.get("_islands", i)["start"], F.length("text").cast("long"))
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("text", (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")))
    changed = F.col("_islands").isNotNull()
    d = d.withColumn("text", F.when(changed, F.array_join(parts, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unpack(d, docs.columns, *apart)
