"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import ROOT, compare, connect

SF = "0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "ink", "pixels", "max_total", "mean", "max", "inked"]
    assert not df.isEmpty()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert (ROOT / f"sf{SF}").is_dir()


def test_stream_replay_keeps_the_stacks_of_the_batch_replay(spark):
    folder = str(ROOT / f"sf{SF}")
    batch, stream = (sorted(map(tuple, QUERIES[n](spark, folder).select("project", "value", "undo", "redo").collect())) for n in ("j5_replay", "stream_replay"))
    assert stream == batch
    assert max(undo for _, _, undo, _ in stream) > 8
