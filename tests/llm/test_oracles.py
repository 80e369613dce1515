"""The SQL of the training-data queries, on the smallest tables and on odd rows."""

import duckdb
import pytest

from gridloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(v) if isinstance(v, float) else str(v)


def compare(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(ORACLES[name])
    order = sorted(range(len(result.description)), key=lambda k: result.description[k][0])
    assert [result.description[k][0] for k in order] == columns
    assert ours == sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    compare(spark, con, name, SF)


def test_sql_on_odd_rows(spark, tmp_path):
    prose = " ".join(f"word{k}" for k in range(70)) + "."
    texts = [None, "", "Home\nAbout\n" + prose + "\nHome\nAbout", "Home\nHome\n" * 40, prose + "\n" + prose, "Yes.\nYes.\n" + prose, "click here\n" + prose]
    urls = [None, "", "//casino.example/x", "www.porn.example", "cheap-pills", "http://A.example.com/en/71", "x://y", "https://k.org/es/?q"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op2_url_filter", "op9_quality_rules"):
        compare(spark, con, name, str(tmp_path))
