"""Archives in ranges, the write-once store, and logs that grow."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeflow.sources import archive, store
from lodeflow.sources.log_tail import tail_logs
from lodeflow.streaming.progress import progress_stream


def entries(spark, path, size):
    return sorted(((r.archive.split("/")[-1], r.entry_no, r.path, r.encrypted, r.size, bytes(r.content or b""), r.error is None) for r in archive.read_archives(spark, str(path), size).collect()), key=str)


@pytest.mark.parametrize("size", [64, 700, 1 << 26])
def test_ranges_of_archives(spark, tmp_path, size):
    draw = random.Random(4)
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", b"")
        for i in range(30):
            z.writestr(f"000{i % 3}/{i}.png", draw.randbytes(draw.randrange(200)))
        z.writestr("empty.png", b"")
    (tmp_path / "broken.zip").write_bytes(b"no archive" * 50)
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    found = entries(spark, tmp_path, size)
    with zipfile.ZipFile(tmp_path / "t.zip") as z:
        want = [("t.zip", i, n.filename, False, n.file_size, z.read(n), True) for i, n in enumerate(x for x in z.infolist() if not x.is_dir())]
    assert [r for r in found if r[-1]] == sorted(want, key=str)
    assert [(r[0], r[1], r[-1]) for r in found if not r[-1]] == [("broken.zip", None, False), ("none.zip", None, False)]
    assert [r[:3] for r in entries(spark, tmp_path / "t.zip", size)] == sorted([r[:3] for r in want], key=str)


def test_broken_and_locked_entries_are_rows(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.png", b"good content")
        z.writestr("b.png", b"bad content")
        z.writestr("c.png", b"locked")
    data = held.getvalue().replace(b"bad content", b"bad_content", 1)
    at = data.rindex(b"PK\x01\x02")
    data = data[: at + 8] + b"\x01" + data[at + 9 :]
    (tmp_path / "t.zip").write_bytes(data)
    found = {r.path: r for r in archive.read_archives(spark, str(tmp_path), 50).collect()}
    assert bytes(found["a.png"].content) == b"good content" and found["b.png"].content is None and "CRC" in found["b.png"].error
    assert found["c.png"].encrypted and found["c.png"].content is None and found["c.png"].error is None and found["c.png"].declared_size == 6


def test_a_task_reads_its_range_only(tmp_path, monkeypatch):
    """An archive above 2 GB (sparse here): a range reads the directory at the end and its own entries, nothing between."""
    path = tmp_path / "big.zip"
    with path.open("wb") as file:
        with zipfile.ZipFile(file, "w") as z:
            z.writestr("first.png", b"1" * 1000)
            file.seek((2 << 30) + 12345)
            z.start_dir = file.tell()
            z.writestr("last.png", b"2" * 1000)
    assert path.stat().st_size > 2 << 30
    seen = [0]

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            seen[0] += len(data)
            return data

    monkeypatch.setattr(archive, "_opened", lambda uri: Counted(str(path)))
    parts = archive._EntryReader({"path": str(path)}).partitions()
    told = [[row[2] for row in archive.entries_within(p)] for p in parts]
    assert len(parts) > 30 and told[0] == ["first.png"] and told[-1] == ["last.png"] and not any(told[1:-1])
    seen[0] = 0
    assert [(r[2], r[7]) for r in archive.entries_within(parts[0])] == [("first.png", b"1" * 1000)] and seen[0] < 200_000


def test_written_archives(spark, tmp_path):
    rows = [("x", f"{i:03}.txt", None if i == 3 else f"{i}".encode() * i) for i in range(50)] + [("y", "one.txt", b"1"), (None, "z", b""), ("x", None, b"")]
    told = archive.write_archives(spark.createDataFrame(rows, "name string, path string, content binary"), f"file://{tmp_path}/out", name="name").collect()
    assert {(r.archive, r.entries) for r in told} == {("x", 50), ("y", 1)} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.zip", "y.zip"]
    with zipfile.ZipFile(tmp_path / "out/x.zip") as z:
        assert z.namelist() == [f"{i:03}.txt" for i in range(50)] and z.read("007.txt") == b"7" * 7


FILES = "path string, label string, file_hash string, content binary"


def put(spark, path, rows):
    return {(r.path, r.file_hash): (r.n, r.status) for r in store.write_once(spark.createDataFrame(rows, FILES), path).collect()}


def test_write_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert put(spark, path, [("a/1", "a", "h1", b"1"), ("b/2", "b", "h2", b"2")]) == {("a/1", "h1"): (1, "written"), ("b/2", "h2"): (1, "written")}
    again = put(spark, path, [("a/1", "a", "h1", b"1"), ("b/2", "b", "other", b"!"), ("b/3", "b", "h3", b"3")])
    assert again == {("a/1", "h1"): (1, "reused"), ("b/2", "other"): (1, "conflict"), ("b/3", "h3"): (1, "written")}
    assert {(r.path, r.file_hash, r.label, bytes(r.content)) for r in store.stored(spark, path).collect()} == {("a/1", "h1", "a", b"1"), ("b/2", "h2", "b", b"2"), ("b/3", "h3", "b", b"3")}


def test_a_path_more_than_once_in_a_call(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = [("a", "x", "h2", b"2"), ("a", "x", "h1", b"1"), ("a", "x", "h1", b"1"), ("b", "x", "h9", b"9"), (None, "x", "h", b""), ("c", "x", None, b"")]
    told = put(spark, path, rows)
    assert told == {("a", "h1"): (2, "written"), ("a", "h2"): (1, "conflict"), ("b", "h9"): (1, "written"), (None, "h"): (1, "conflict"), ("c", None): (1, "conflict")}
    assert sorted((r.path, bytes(r.content)) for r in store.stored(spark, path).collect()) == [("a", b"1"), ("b", b"9")]
    assert put(spark, path, rows)[("a", "h1")] == (2, "reused") and store.stored(spark, path).count() == 2


def test_a_failed_call_leaves_the_store_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/store"
    put(spark, path, [("a", "x", "h1", b"1")])
    broken = spark.createDataFrame([("b", "x", "h2", b"2"), ("c", "x", "h3", b"3")], FILES).withColumn("content", F.when(F.col("path") == "c", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.write_once(broken, path)
    assert [r.path for r in store.stored(spark, path).collect()] == ["a"]
    assert put(spark, path, [("b", "x", "h2", b"2"), ("c", "x", "h3", b"3")]) == {("b", "h2"): (1, "written"), ("c", "h3"): (1, "written")}
    assert sorted(r.path for r in store.stored(spark, path).collect()) == ["a", "b", "c"]


LINES = ["[train] D:\\x.zip：100 个文件\n", "[train] 50/100 (50.0%)，可用 49，异常 1，6.5 张/秒\n", "noise\n", "[test] x 9 个文件\n"]


def follow(spark, logs, at):
    told = []
    stream = progress_stream(spark, f"file://{logs}", 60)
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: told.append({r.stage: (r.announced, tuple(r.state) if r.state else None) for r in df.collect()})).start()
    assert query.awaitTermination(90)
    return told


def test_progress_follows_growing_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(LINES) + "[train] 60/100 (60.0%)，可")  # a line that is not ended yet
    assert follow(spark, logs, tmp_path)[-1] == {"train": (100, (50, 100, 50.0, 49, 1, 6.5)), "test": (9, None)}
    with (logs / "a.log").open("a") as log:  # after a restart from the checkpoint: what was open is ended, and the total shrinks
        log.write("用 59，异常 1，7.0 张/秒\n[train] y.zip：80 个文件\n[train] 55/80 (68.8%)，可用 55，异常 0，7.5 张/秒\n")
    assert follow(spark, logs, tmp_path)[-1] == {"train": (80, (55, 80, 68.8, 55, 0, 7.5)), "test": (9, None)}
    (logs / "b.log").write_text("[test] 1/9 (11.1%)，可用 1，异常 0，1.0 张/秒\n")
    assert follow(spark, logs, tmp_path)[-1]["test"] == (9, (1, 9, 11.1, 1, 0, 1.0))


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_each_line_once(spark, tmp_path, size):
    text = "one\n\nthree is long\r\n" + "x" * 40 + "\nlast é\nopen"
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "_hidden").write_text("no\n")
    from lodeflow.sources.log_tail import _TailReader

    reader = _TailReader(f"file://{tmp_path}", size)
    end = reader.latestOffset()
    found = [row for part in reader.partitions({}, end) for row in reader.read(part)]
    assert [line for _, _, line in found] == ["one", "", "three is long", "x" * 40, "last é"]
    assert all(text.encode()[at:].decode().startswith(line) for _, at, line in found) and end == {f"{tmp_path}/a.log": len(text.encode()) - 4}
    assert reader.partitions(end, end) == []
    with pytest.raises(ValueError):
        reader.partitions({f"{tmp_path}/a.log": 10**6}, end)
    assert tail_logs(spark, f"file://{tmp_path}").isStreaming


def test_directories_are_read_a_bounded_number_of_times(spark, tmp_path):
    """However small the ranges asked for, an archive is cut into MOST_RANGES of them, and no entry is lost."""
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        for i in range(500):
            z.writestr(f"{i}.png", f"{i}" * 50)
    assert len(archive._EntryReader({"path": str(tmp_path), "rangeBytes": "64"}).partitions()) <= archive.MOST_RANGES
    assert sorted(r[1] for r in entries(spark, tmp_path, 64)) == list(range(500))
