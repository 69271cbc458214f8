"""op5 beyond its broadcast: chunks of texts ask the shards."""

import time
import uuid
from pathlib import Path

import numpy as np
import pytest

from lodeflow import session
from lodeflow.llm import lm_scoring
from lodeflow.session import materialize

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def marked(spark):
    return spark.read.parquet(DOCUMENTS).select("doc_id", "text", lm_scoring.held_out_column().alias("held_out"))


@pytest.fixture
def settings(spark):
    """Sets the session's settings, and puts them back."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rows(scores):
    return sorted((tuple(r) for r in scores.collect()), key=str)


def test_little_is_written_beyond_the_broadcast(spark, monkeypatch, tmp_path):
    docs = marked(spark)
    model = lm_scoring.fit(docs.where("NOT held_out"))
    monkeypatch.setattr(session, "scratch_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    assert len(lm_scoring.score(docs, model, max_broadcast_bytes=0).collect()) == docs.count()
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2 * Path(DOCUMENTS).stat().st_size


def test_a_chunk_read_in_several_runs(spark, settings, monkeypatch):
    docs = marked(spark)
    model = lm_scoring.fit(docs.where("NOT held_out"))
    want = rows(lm_scoring.score(docs, model))
    written = []
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, **x: written.append(materialize(df, **x)) or written[-1])
    settings("spark.sql.files.maxPartitionBytes", "100000")
    settings("spark.sql.files.openCostInBytes", "1000")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "200000")
    try:
        found = rows(lm_scoring.score(docs, model, max_broadcast_bytes=0))
    finally:
        hadoop.unset("parquet.block.size")
    assert written[1].select("chunk", "first").distinct().count() > written[1].select("chunk").distinct().count()
    for a, b in zip(want, found, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-12)


def test_packed_numbers_come_back():
    for values in ([], [0], [7, 0, 255], [256, 1], [(1 << 64) - 1, 3], list(range(0, 1 << 40, (1 << 33) + 1))):
        packed = lm_scoring._packed(np.array(values, np.uint64))
        assert lm_scoring._unpacked(packed).tolist() == values
    assert len(lm_scoring._packed(np.array([1 << 24, 5], np.uint64))) == 9


def test_shuffle_files_go_with_their_write(spark):
    held = lambda: {f for f in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()).rglob("shuffle_*.data")}
    before = held()
    counts = materialize(spark.range(100_000).selectExpr("id % 5000 AS k").groupBy("k").count(), drop_shuffles=True)
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and counts.count() == 5000


def test_no_broadcast_beyond_a_quarter_of_the_heap(spark, monkeypatch):
    docs = marked(spark)
    model = lm_scoring.fit(docs.where("NOT held_out"))
    assert lm_scoring.broadcast_room(spark) == 2 << 30  # local_session: 8g
    ways = []
    monkeypatch.setattr(lm_scoring, "_score_by_shards", lambda *_: ways.append("shards"))
    for room in (model.n_bytes - 1, model.n_bytes):
        monkeypatch.setattr(lm_scoring, "broadcast_room", lambda _, room=room: room)
        ways.append(room if lm_scoring.score(docs, model) is not None else None)
    assert ways == ["shards", None, model.n_bytes]
