"""Every query with SQL against DuckDB on the smallest test tables, and the shape of the plans."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import difference, oracle_connection  # noqa: E402
from moodtide.operators import lexicon  # noqa: E402
from moodtide.plans import fixtures as fx  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF).toPandas()
    assert difference(found, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_every_query_is_named_like_its_operator():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline", n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_QUERIES = {"model_probability"}


@pytest.mark.parametrize("name", ["lexicon_compound_emphasis", "lexicon_compound_modifiers", "encode_sequence", "sliding_examples", "correlation_matrix"])
def test_no_python_on_the_data_path(spark, name):
    assert "Python" not in plan(entry.queries()[name](spark, SF))


def test_lexicon_is_broadcast_and_words_stay_on_their_node(spark):
    texts = fx.posts(spark, SF).selectExpr("source", "id", "title as text")
    found = plan(lexicon.lexicon_compound_emphasis(texts, fx.lexicon(spark), carry=[]))
    assert found.count("BroadcastHashJoin") >= 5
    above_explode = found[: found.index("Generate")]
    # Only per-post sums, never words, are moved: the aggregates stand around the one exchange.
    assert len(re.findall(r"Exchange hashpartitioning\(source", above_explode)) <= 1
    assert "SortMergeJoin" not in above_explode


def test_posts_view_pushes_columns_to_the_scan(spark):
    found = plan(entry.queries()["join_indicators"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in found
