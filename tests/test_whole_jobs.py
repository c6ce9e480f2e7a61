"""Queries whose SQL once asked for less than the whole job."""

import duckdb

from tidemill.plans import registry

SF = "/root/testdata/sf0.001"


def test_leaks_are_judged_for_both_languages(spark):
    got = registry.QUERIES["cjk_leaks"](spark, SF)
    assert got.columns == ["doc_id", "in_russian", "in_chinese"]
    assert got.where("in_chinese").count() == 0 and got.where("in_russian").count() > 0


def test_lineage_of_a_source_is_one_row(spark):
    rows = registry.QUERIES["lineage_two_hop"](spark, SF).collect()
    sources, documents = duckdb.connect().execute(f"SELECT count(DISTINCT source), count(*) FROM (SELECT first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS source FROM '{SF}/documents.parquet')").fetchone()
    assert len(rows) == sources and sum(r.n for r in rows) == documents
