"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes
each result as Parquet to the shared folder and reads it again for the next stage. All but the last
return the columns of ``documents``; extra columns of ``docs`` stay, whatever their names.

What a stage stores for itself is deleted when a later stage begins, unless that stage's ``docs`` still
read it: so the tables of one stage, at most, lie beside its input and its output.

Null and empty texts have no words, so the quality rules drop them; an empty table passes every stage as an
empty one. Repeated rows: near-duplicates keep one. Ties go to the least doc_id, null last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import mixing, packing, quality_rules, secrets, simhash
from storelens.llm.common import Workspace, table
from storelens.llm.queries import tokenizer_path

_open: list[Workspace] = []


def _workspace(spark: SparkSession, docs: DataFrame) -> Workspace:
    """A workspace for a stage; those of earlier stages are closed unless ``docs`` read from them."""
    read = docs.inputFiles() if _open else []
    for earlier in list(_open):
        if not any(f"/{earlier.name}/" in file for file in read):
            earlier.close()
            _open.remove(earlier)
    _open.append(Workspace.of(spark, None))
    return _open[-1]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the learned list; null texts fail the base checks."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"), workspace=_workspace(spark, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of least doc_id; texts without words are one group."""
    return simhash.keep_one(docs, workspace=_workspace(spark, docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every finding in their texts replaced; a null text stays null."""
    return secrets.redact(docs, workspace=_workspace(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order; the copy at a source's limit is cut there.

    Texts without words have no copy; documents without a source are a source of their own.
    """
    return mixing.curriculum(docs, workspace=_workspace(spark, docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; a null text is one end token."""
    return packing.pack(docs, tokenizer_path(), workspace=_workspace(spark, docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_windows),
]

#: A learned list, fingerprints and a tokenizer have no SQL form; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, workspace: Workspace | None = None) -> DataFrame:
    """The last stage's rows. Of the stages' results only those that the next one reads lie on disk."""
    results = Workspace.of(spark, workspace)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = results.keep(stage(spark, docs, sf_dir))
        if before:
            results.drop(before)
        before = results.last
    return docs
