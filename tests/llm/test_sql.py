"""The queries with reference SQL, side by side with DuckDB; every query takes whole tables."""

import duckdb
import pytest
from conftest import SF

from cellsight.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def test_one_row_per_document_or_page(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op1_quality_classifier", "op4_language_id", "op6_bpe", "op7_html_extraction", "op8_lm_scoring"):
        assert QUERIES[name](spark, SF).count() == rows["pages" if name.startswith("op7") else "documents"]
