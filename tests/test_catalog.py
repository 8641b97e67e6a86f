"""The catalog against its SQL. All of it with CORPUS_FULL=1; else one query of each kind."""

import os

import pytest

import __spark_entry__ as entry_point
import oracle
from corpusloom.catalog import all_queries

SF = "/root/testdata/sf0.001"
SOME = (
    "extract_content clean_text link_graph new_links_only normalize_url duplicate_members "
    "robots_allowed crawl_bfs_canonical analyze_content quality_report extract_code_blocks "
    "crawl_profile_lines build_page_tree orphans render_json render_hier_json page_paths "
    "render_hier_markdown render_hier_pages render_hier_pages_literal "
    "stream_extract stream_dedup_urls stream_quality_stats stream_crawl_profile stream_progress "
    "visit_nodes_breadth_first crawl_bfs_whole extract_selectors write_rendered write_rendered_pages "
    "top_pages_site worst_pages mark_duplicates is_seen"
).split()
NAMES = list(all_queries()) if os.environ.get("CORPUS_FULL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    report, _ = oracle.differences(
        entry_point.queries()[name](spark, SF), entry_point.oracle_sql()[name], con
    )
    assert not report, report


def test_every_query_has_sql():
    assert set(all_queries()) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
