"""Every query of the library against its DuckDB twin."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

from loomline.plans import registry  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf_dir)) == oracle.duck_rows(con, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "user_id"
    assert set(QUERIES) <= set(entry.queries())


def test_library_does_not_import_the_llm_subpackage():
    root = Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "loomline.llm" not in path.read_text() and "from .llm" not in path.read_text()
