"""Every registered query against its SQL twin on DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import database, duck_rows, spark_rows
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries) and set(oracles) <= set(queries)
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    columns, expected = duck_rows(con, contract.oracle_sql()[name])
    assert sorted(df.columns) == columns
    got = spark_rows(df)
    assert got and got == expected


def test_queries_without_what_the_training_texts_need():
    """Where a package of theirs is missing, all other queries are there."""
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e; from checks.queries import QUERIES\n"
        "assert set(e.queries()) == set(e.oracle_sql()) == set(QUERIES)"
    )
    root = Path(contract.__file__).parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, check=False).returncode == 0
