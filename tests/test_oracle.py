import pytest
from compare import same_rows

import __spark_entry__ as entry
from corpusmill import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    same_rows(spark, small, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_has_rows_and_all_queries_are_registered(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entities_without_semicolons_stay_as_in_the_sql(spark, tmp_path):
    html = ["<title>a &amp; b&amp</title>", "&&&amp", "&copy 1 &quot", "x&ampfoo; &amp;amp &copy;&middot;&quot;", None, "", "&amp;quot;"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/*.parquet")).rename(tmp_path / "pages.parquet")
    assert same_rows(spark, str(tmp_path), catalog.QUERIES["normalize_pages_text"], catalog.ORACLES["normalize_pages_text"]) == len(html)
