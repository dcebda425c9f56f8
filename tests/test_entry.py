import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillstream.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_caps_runs_over_short_texts_match_their_sql(spark, tmp_path):
    """The SQL strings the lexemes of both segments together by place, which breaks runs that begin within the second one's length."""
    texts = {2: "one", 9: "one two three four", 16: "", 3: "AB CD EF GH IJ KL", 10: " ".join(["AB"] * 12), 17: "x y z w AA BB CC DD EE", 5: "x y z w AA BB CC DD EE", 4: None}
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(ORACLES["caps_runs_documents"]).df()
    assert rows(QUERIES["caps_runs_documents"](spark, str(tmp_path)).toPandas()) == rows(want) and want["segments"][0] == 3
