"""Character references without their semicolon, in queries and their SQL."""

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES
from tests.oracle import compare

HTML = ('<!DOCTYPE html><html lang="en"><head><title>Salt&amp</title></head><body><div class="ad">Ad &copy 1&middot2</div>'
        '<article><h1>Salt&amp</h1><p>Salt &amp; &quotpepper&quot;, &ampquot; and &amp;amp</p></article></body></html>')

NAMES = ["c5_epub_assemble", "c6_split_by_anchor", "t15_clean_pages", "t1_strip_html_if_tagged", "t2_normalize_unicode", "src4_html_to_text", "src4_html_to_text_strict"]


@pytest.mark.parametrize("name", NAMES)
def test_references_need_no_semicolon(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE pages AS SELECT i AS page_id, 'http://h.org/' || i AS url, '{HTML}' AS html FROM range(1, 8) r(i)")
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, 'en' AS lang, 's' AS source, 'A plain text.' AS text")
    for table in ("pages", "documents"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    error, rows = compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    assert error is None and rows >= 7, error
