"""A share of the registered queries next to their SQL form; ``tools/check.py`` runs all of them."""

import check
import pytest

import __spark_entry__ as entry
from tracegrid import checks

SF = "/root/testdata/sf0.001"
SHARE = [
    "table_diff", "hybrid_diff", "diff_tree_stats", "fill_down_partitioned", "normalize_req_id", "extract_link_ids",
    "normalize_generic", "normalize_srs", "star_traces", "section_groups", "neighbours", "bucket_blocks", "link_context",
    "trace_edges", "requirement_markdown", "chunk_documents", "regex_metadata", "retrieve", "incremental_ingest", "resume_plan",
]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", SHARE)
def test_equals_sql(spark, con, name):
    result = check.compare(spark, con, SF, name)
    assert result.startswith("ok"), result


def test_every_query_has_sql():
    assert set(checks.QUERIES) == set(checks.SQL)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
