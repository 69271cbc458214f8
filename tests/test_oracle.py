"""Every query with SQL gives the same rows in DuckDB; those without give rows of a stable kind."""

import duckdb
import pytest

from lodeflow import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(name, spark, sf, duck):
    ours, theirs = core.QUERIES[name](spark, sf).toPandas(), duck.execute(core.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_split_greedy_keeps_groups_together(spark, sf):
    found = core.QUERIES["split_greedy"](spark, sf)
    assert found.groupBy("group_id").agg({"fold": "approx_count_distinct"}).toPandas().iloc[:, 1].max() == 1
    assert {"train", "val"} <= {r.fold for r in found.select("fold").distinct().collect()}


def test_weighted_sample_draws_all(spark, sf):
    found = core.QUERIES["weighted_sample"](spark, sf).toPandas()
    assert sorted(found.draw) == list(range(1000))
    assert found.equals(core.QUERIES["weighted_sample"](spark, sf).toPandas()) or set(map(tuple, found.values)) == set(map(tuple, core.QUERIES["weighted_sample"](spark, sf).toPandas().values))


def test_null_texts_keep_their_rows(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"text {i % 20}", "en", f"s{i % 2}", 6) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("split_quota", "dense_group_ids"):
        ours, theirs = core.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(core.ORACLE_SQL[name]).df()
        assert len(ours) == 60 and sorted(map(str, ours[sorted(ours)].values.tolist())) == sorted(map(str, theirs[sorted(ours)].values.tolist()))
    assert core.QUERIES["split_greedy"](spark, str(tmp_path)).count() == 60


def test_early_stopping_reads_all_of_part(spark, sf):
    found = core.QUERIES["early_stop_histories"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert found.select("history").distinct().count() > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
