"""Registered queries on small tables of their own, against their SQL."""

import duckdb
import pytest

from loomwork.plans import REGISTRIES

QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
SQL = {n: q for r in REGISTRIES for n, q in r.sql.items()}


def both(spark, folder, name, **tables):
    """The sorted rows of a query and of its SQL over tables: name -> (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, f"file://{folder}"), con.sql(SQL[name])
    return sorted(tuple(r[c] for c in want.columns) for r in got.collect()), sorted(want.fetchall())


def test_dates_in_texts_with_character_references(spark, tmp_path):
    page = "<html><head><title>1</title></head><body><p>{}</p></body></html>"
    texts = ["x" * 115 + "&quot;1&quot;", "x" * 120 + "&quot;1&quot;", "1 &amp; 2", "&#39;x&#39;", "none", "٣ May"]  # the second is too long as written
    rows = [(i, page.format(text)) for i, text in enumerate(texts)]
    got, want = both(spark, tmp_path, "d14_dates_in_order", pages=("page_id long, html string", rows))
    assert got == want and [r[3] for r in got] == [4, 3, 4, 4, 3, 3]


def test_all_pairs_of_categories(spark, tmp_path):
    rows = [(k, k % 4) for k in range(1, 30)]
    got, want = both(spark, tmp_path, "j19_cover_pairs", supplier=("s_suppkey long, s_nationkey int", rows))
    assert got == want and [r[:2] for r in got] == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


def own_shuffles(spark, name):
    """The shuffles that Spark adds to a query by itself, into its own number of partitions."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


@pytest.mark.parametrize("name", ["x01_mask_groups", "x01_two_star_groups", "x03_ranked_groups"])
def test_masks_stay_in_tasks_as_many_as_the_lines_ask_for(spark, monkeypatch, name):
    monkeypatch.setattr("loomwork.sources.tables.ROWS_A_TASK", 100)
    assert own_shuffles(spark, name) == [] and QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_links_of_large_pages_meet_in_tasks_as_many_as_the_lines_ask_for(spark):
    plan = QUERIES["x10_unordered_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(page" in line and ", key" in line and "ENSURE_REQUIREMENTS" in line]


def test_extraction_records_stay_in_tasks_as_many_as_the_lines_ask_for(spark):
    assert own_shuffles(spark, "x05_extraction_records") == []


def test_suffixes_stay_in_tasks_as_many_as_the_orders_ask_for(spark):
    assert own_shuffles(spark, "e06_suffix_match") == []


def test_growing_lists_stay_in_tasks_as_many_as_the_lines_ask_for(spark):
    assert own_shuffles(spark, "x21_shuffled_lists") == []


def test_guids_are_made_after_the_shuffle_by_user(spark):
    plan = QUERIES["g04_user_feed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning(user_id")
    assert "sha2" in above and "sha2" not in below and below


def test_a_document_is_made_once_for_its_head(spark):
    plan = QUERIES["d01_feed_heads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 3 and "Join" not in plan
