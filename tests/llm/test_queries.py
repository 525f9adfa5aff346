import importlib
import re
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import difference
from storelens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_reference_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_the_rest_does_not_import_this_subpackage():
    root = Path(entry.__file__).parent
    for path in (root / "storelens").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
    assert importlib.util.find_spec("storelens.llm") and "storelens.llm" in sys.modules
