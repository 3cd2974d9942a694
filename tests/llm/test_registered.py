"""The registered corpus queries beside their SQL, where SQL can express them."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, rows_of
from platter.llm.queries import llm_queries, llm_sql

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(llm_queries()) | {"pipeline"} <= set(entry.queries())
    assert set(llm_sql()) <= set(llm_queries())


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query(spark, name):
    df = llm_queries()[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(llm_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())
