"""Hand-made cases for the operators: boundaries, nulls, ties, empty tables."""

import inspect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.config import read_settings
from lodeflow.functions import scalars as S
from lodeflow.functions import vectors as V
from lodeflow.operators import audit, dedup, reliability, report, split
from lodeflow.operators.components import connected_components
from lodeflow.plans import curation
from lodeflow.session import scratch_dir
from lodeflow.sources import images, sinks


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(3, 1), (1, 2), (2, 3), (9, 8), (8, 8), (None, 4), (7, None)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 20 for i in range(20, 61)} | {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("task_links", [3, 40, 10**6])
def test_components_in_rounds(spark, task_links):
    rng = random.Random(task_links)
    links = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(100, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] * 2
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), task_links=task_links).collect()}
    assert found == {i: find(i) for i in parent}


@pytest.mark.parametrize("radius", [0, 2, 5, 8])
def test_hamming_pairs_match_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for flips in (radius, radius + 1, 1):
            q = p
            for b in rng.sample(range(64), flips):
                q ^= 1 << b
            prints.append(q)
    prints += [prints[0] ^ sum(1 << b for b in range(radius)), prints[0] ^ (1 << 63)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    df = spark.createDataFrame([(p,) for p in signed] + [(None,), (signed[0],)], "h long")
    assert {(r.a, r.b) for r in dedup.hamming_pairs(df, radius).collect()} == want


def test_radius_out_of_range(spark):
    with pytest.raises(ValueError):
        dedup.hamming_pairs(spark.createDataFrame([(1,)], "h long"), 9)


def test_groups_are_global_and_transitive(spark):
    rows = [(0, "a", 0), (1, "b", 0xFF), (2, "c", 0xFFFF), (3, "a", -1), (4, None, None), (5, None, None), (6, "d", 0x7777777700000000)]
    found = {r.id: r.group_id for r in dedup.build_groups(spark.createDataFrame(rows, "id long, file_hash string, h long"), 8).collect()}
    assert found[0] == found[1] == found[2] == found[3] == 0
    assert len({found[k] for k in (0, 4, 5, 6)}) == 4 and sorted(set(found.values())) == [0, 1, 2, 3]


def test_null_hashes_are_no_duplicates(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 2), (2, "x", 1), (3, "x", 2), (4, "y", 1), (5, "y", 1)], "id long, file_hash string, class_idx int")
    assert {r.id: r.conflict for r in dedup.conflict_mask(df).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False}
    assert {r.id: r.weight for r in dedup.dup_weight(df).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0.5, 5: 0.5}
    assert {r.id for r in dedup.drop_conflicts(df).collect()} == {0, 1, 4, 5}


def test_paths(spark):
    cases = {"": None, "/abs": None, "C:/x": None, "a/../b": None, "a\\b": "a/b", "a//b": "a/b", "a/./b": "a/b", "./a": "a", ".": "", "a/": "a"}
    df = spark.createDataFrame([(p,) for p in cases] + [(None,)], "p string").select("p", S.safe_path(F.col("p")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == cases | {None: None}


def test_scalars(spark):
    row = spark.range(1).select(
        S.aspect_ratio(F.lit(4), F.lit(0)).alias("none"),
        S.replace_prefix(F.lit("/x/a/x/b"), "/x", "/y").alias("both"),
        S.hex_to_long(F.lit("ffffffffffffffff")).alias("minus"),
        S.hex_to_long(F.lit("zz")).alias("bad"),
        S.hamming(F.lit(-1), F.lit(0)).alias("all"),
        S.extension(F.lit("A/b.JPG")).alias("ext"),
    ).first()
    assert (row.none, row.both, row.minus, row.bad, row.all, row.ext) == (None, "/y/a/y/b", -1, None, 64, ".jpg")
    assert S.layers("last_4", 12) == [8, 9, 10, 11] and S.layers(None, 3) == [] and S.layers("all", 2) == [0, 1] and S.layers([-1, 0], 4) == [0, 3]


def test_rank_ties_and_single_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 3.0), (1, 9.0)], "y int, v double")
    assert sorted((r.y, r.r) for r in reliability.rank_within_class(df, "v").collect()) == [(0, 0.25), (0, 0.25), (0, 1.0), (1, 0.5)]


def test_tail_protection_small_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.9)] + [(2, 0.9)] * 6, "y int, q0 double")
    found = sorted((r.y, round(r.q0, 6)) for r in reliability.tail_protection(df).collect())
    assert found[:3] == [(0, 1.0), (0, 1.0), (1, 1.0)] and found[3:] == [(2, 0.9)] * 6


def test_fusion_needs_a_signal(spark):
    with pytest.raises(ValueError):
        reliability.fuse_q0(spark.createDataFrame([(0,)], "y int"), {})


def clusters(spark, seed=0, classes=4, per=15, dim=8, noise=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, dim)) * 2
    rows = []
    for c in range(classes):
        for _ in range(per):
            z = centres[c] + rng.normal(size=dim)
            wrong = rng.random() < noise
            rows.append((len(rows), int((c + 1) % classes) if wrong else c, len(rows), [float(x) for x in z / np.linalg.norm(z)], bool(wrong)))
    return rows, spark.createDataFrame(rows, "id long, y int, g long, z array<double>, noisy boolean")


def test_reliability_prefers_clean_rows(spark):
    rows, df = clusters(spark)
    q = {r.id: r.q0 for r in reliability.compute_q0(split.group_kfold(df, 3, group="g"), k=5).collect()}
    assert all(0 <= v <= 1 for v in q.values()) and len(q) == len(rows)
    assert np.mean([q[r[0]] for r in rows if not r[4]]) > np.mean([q[r[0]] for r in rows if r[4]]) + 0.1


def test_prototype_signal_against_numpy(spark):
    rows, df = clusters(spark, 1)
    rows = [(i, y, g // 2, z, n) for i, y, g, z, n in rows]
    df = df.withColumn("g", F.expr("g div 2"))
    z = np.array([r[3] for r in rows])
    y, g = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    unit = lambda v: v / (np.linalg.norm(v) + 1e-8)
    mean = unit(z.mean(axis=0))
    shrunk = lambda s, n: unit(n / (n + 10) * unit(s) + (1 - n / (n + 10)) * mean)
    full = {c: shrunk(z[y == c].sum(axis=0), (y == c).sum()) for c in set(y)}
    found = {r.id: r.proto for r in reliability.prototype_signal(df).collect()}
    for i in range(len(rows)):
        rest = (y == y[i]) & (g != g[i])
        own = shrunk(z[rest].sum(axis=0), (y == y[i]).sum()) if rest.any() else mean
        want = unit(z[i]) @ own - max(unit(z[i]) @ p for c, p in full.items() if c != y[i])
        assert abs(found[i] - want) < 2e-6


def test_prototypes_beyond_a_broadcast_are_refused(spark):
    rows = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0]), (3, [0.6, 0.8])], "y int, proto array<double>")
    assert [p.y for p in rows.agg(reliability.packed_protos("proto", 6)).first().protos] == [1, 2, 3]
    assert rows.limit(0).agg(reliability.packed_protos("proto", 6)).first().protos == []
    with pytest.raises(Exception, match="too large to broadcast: 6 numbers"):
        rows.agg(reliability.packed_protos("proto", 5)).collect()


def test_crc32_hex(spark):
    data = [b"", b"a", b"\x00" * 9, "été".encode(), *(random.Random(i).randbytes(i) for i in range(60))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*data, None])], "id int, data binary").select("id", S.crc32_hex(F.col("data")).alias("crc")).orderBy("id").collect()
    assert [r.crc for r in rows] == [*(f"{zlib.crc32(x):08x}" for x in data), None]


def test_class_of_one_group_falls_back(spark):
    df = spark.createDataFrame([(0, 0, 7, [1.0, 0.0]), (1, 0, 7, [1.0, 0.1]), (2, 1, 8, [0.0, 1.0]), (3, 1, 9, [0.1, 1.0])], "id long, y int, g long, z array<double>")
    assert reliability.prototype_signal(df).count() == 4


def test_neighbours_in_blocks_equal_one_block(spark):
    _, df = clusters(spark, 2)
    one, many = (sorted(map(tuple, reliability.knn(df, 6, rows).collect())) for rows in (1000, 17))
    assert one == many and len(one) == 60 * 6


def test_no_mutual_neighbour_is_zero(spark):
    df = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (1, 0, 1, [1.0, 0.1])], "id long, y int, g long, z array<double>")
    assert [r.knn for r in reliability.mutual_knn_signal(df, 1).collect()] == [0.0, 0.0]


def test_head_wins_and_empty(spark):
    df = spark.createDataFrame([(c, "train") for c in range(3) for _ in range(c + 1)], "class_idx int, fold string")
    assert {r.class_idx: r.part for r in split.class_parts(df, 0.7, 0.7).collect()} == {0: "tail", 1: "head", 2: "head"}
    assert split.class_parts(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", [split.split_greedy, split.split_quota])
def test_groups_never_span_folds(spark, how):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(60), rng.choice([0, 0, 0, 1, 1, 2])) for _ in range(200)] + [(100, 9), (101, 9)], "group_id long, class_idx int")
    found = how(df)
    assert found.count() == 202
    assert found.groupBy("group_id").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    assert {r.fold[:3] for r in found.where("class_idx = 9").collect()} == {"oof"}


def test_greedy_split_keeps_its_rule(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.choice([0, 0, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "group_id long, class_idx int")
    bound = {"most_groups": 1} if "most_groups" in inspect.signature(split.split_greedy).parameters else {}
    goal, held, want = {c: max(1, int(sum(k == c for _, k in rows) * 0.1)) for c in range(3)}, dict.fromkeys(range(3), 0), {}
    order = sorted({g for g, _ in rows})
    random.Random(42).shuffle(order)
    for g in order:
        own = {c: rows.count((g, c)) for c in range(3)}
        gain = sum(abs(held[c] + n - goal[c]) - abs(held[c] - goal[c]) for c, n in own.items())
        want[g] = "val" if gain < 0 else "train"
        for c, n in own.items():
            held[c] += n * (gain < 0)
    assert {r.group_id: r.fold for r in split.split_greedy(df, **bound).collect()} == want


def test_greedy_rule_against_a_plain_version():
    """Rows kept as lists, counts made anew at each step; classes of a group's own decide its load."""
    for seed in range(50):
        rng = random.Random(1000 + seed)
        rows = [(rng.randrange(60), rng.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 6])) for _ in range(rng.randrange(5, 160))]
        groups = sorted({g for g, _ in rows})
        size = {c: sum(k == c for _, k in rows) for _, c in rows}
        fold, order, dice = {}, list(groups), random.Random(seed)
        dice.shuffle(order)
        for g in order:
            own = [c for k, c in rows if k == g]
            big = sorted({c for c in own if size[c] >= 10})
            if big:
                val = {c: sum(k == c and fold.get(h) == "val" for h, k in rows) for c in big}
                goal = {c: max(1, int(size[c] * 0.1)) for c in big}
                fold[g] = "val" if sum(abs(val[c] + own.count(c) - goal[c]) for c in big) < sum(abs(val[c] - goal[c]) for c in big) else "train"
                continue
            tries = list(range(3))
            dice.shuffle(tries)
            held = lambda k: sum(c in own and fold.get(h) == f"oof_{k}" for h, c in rows)  # noqa: B023, E731
            fold[g] = f"oof_{sorted(tries, key=held)[0]}"
        counts = [(g, sorted({c: rows.count((g, c)) for k, c in rows if k == g}.items())) for g in groups]
        assert dict(split.greedy_folds(counts, 0.1, 10, 3, seed)) == fold


def test_greedy_split_refuses(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "group_id long, class_idx int")
    for wrong in ({"folds": 1}, {"groups_at_most": 1}):
        with pytest.raises(ValueError):
            split.split_greedy(df, **wrong)


def test_epoch_order(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(5,)], "id long")
    first, again, other = ({r.id: r.position for r in split.epoch_order(df, 1, e).collect()} for e in (0, 0, 1))
    assert first == again != other and sorted(first.values()) == list(range(200))
    assert split.epoch_order(df.limit(0), 1, 0).count() == 0


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0), (3, None)], "id long, w double")
    n = {r.id: r["count"] for r in split.weighted_sample(df, "w", 4000).groupBy("id").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] / 4000 - 0.75) < 0.05


def test_fingerprint_ignores_packing(spark):
    rows = [("a", "1"), ("b", None), (None, "3"), ("a", "1")]
    one = audit.dataset_fingerprint(spark.createDataFrame(rows, "p string, h string"), F.col("p"), F.col("h")).first()
    two = audit.dataset_fingerprint(spark.createDataFrame(rows[::-1], "p string, h string").repartition(3), F.col("p"), F.col("h")).first()
    assert one == two and one.n == 4
    assert audit.dataset_fingerprint(spark.createDataFrame([], "p string, h string"), F.col("p"), F.col("h")).first().n == 0


def test_assert_counts(spark):
    audit.assert_counts(spark.range(3).agg(F.count("*").alias("n")), {"n": 3})
    with pytest.raises(ValueError):
        audit.assert_counts(spark.range(3).agg(F.count("*").alias("n")), {"n": 4})


def test_early_stopping(spark):
    df = spark.createDataFrame(list(enumerate([0.5, 0.5, 0.6, 0.1, 0.2, 0.7])), "epoch long, acc double")
    assert [(r.improved, r.stale, r.stopped) for r in report.early_stopping(df, 2).orderBy("epoch").collect()] == [
        (True, 0, False), (False, 1, False), (True, 0, False), (False, 1, False), (False, 2, True), (True, 0, False),
    ]


def test_accuracy_of_nothing(spark):
    assert report.accuracy(spark.createDataFrame([], "p int, y int"), F.col("p"), F.col("y")).first().accuracy == 0.0


def test_log_progress(spark):
    log = spark.createDataFrame([(0, "[b] 1/10 (2.5 img/s)"), (1, "noise"), (2, "[a] 3/3"), (3, "[b] 7/10 (9.0 img/s)"), (4, "[b] 8/10")], "line_no int, line string")
    found = {r.stage: (r.first_line, r.done, r.total, r.rate) for r in report.progress(log).collect()}
    assert found == {"b": (0, 8, 10, 9.0), "a": (2, 3, 3, None)} or found == {"b": (0, 8, 10, None), "a": (2, 3, 3, None)}
    assert abs(report.overall(report.progress(log)).first().share - 11 / 13) < 1e-12


def test_vectors_of_nothing(spark):
    row = spark.range(1).select(V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), V.l2_normalize(F.lit(None).cast("array<double>")).alias("n"), V.argmax(F.array(F.lit(1.0), F.lit(1.0))).alias("a")).first()
    assert (row.z, row.n, row.a) == ([0.0, 0.0], None, 0)


def test_class_folders(spark, tmp_path):
    for name in ("b/1.png", "a/2.JPG", "a/no.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assert {(r.label, r.class_idx) for r in images.scan_class_folders(spark, str(tmp_path)).collect()} == {("a", 0), ("b", 1)}


def test_image_kinds(spark):
    files = {
        b"\xff\xd8\xff\xe0data\xff\xd9": "jpeg",
        b"\xff\xd8\xff\xe0data": None,
        b"\x89PNG\r\n\x1a\nxIEND\xaeB`\x82": "png",
        b"GIF89a;": "gif",
        b"BM\x0a\x00\x00\x00xxxx": "bmp",
        b"BM\x0b\x00\x00\x00xxxx": None,
        b"RIFF\x04\x00\x00\x00WEBP": "webp",
        b"": None,
        b"text": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(files)] + [(99, None)], "i int, content binary")
    found = {r.i: r.k for r in df.select("i", S.image_kind(F.col("content")).alias("k")).collect()}
    assert found == {**dict(enumerate(files.values())), 99: None}


def test_image_headers(spark):
    end, png = b"IEND\xaeB`\x82", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"
    jpeg = b"\xff\xd8\xff\xff\xe0\0\x04\xff\xc0\xff\xd0"  # a fill byte, a segment that holds a frame's mark, a mark alone
    riff = lambda rest: b"RIFF" + (4 + len(rest)).to_bytes(4, "little") + b"WEBP" + rest
    files = {
        png + b"\0\0\1\0\0\0\0\x40\x08\x02" + end: ("png", 256, 64, 4.0, "RGB"),
        png + b"\0\0\0\3\0\0\0\0\x01\0" + end: ("png", 3, 0, None, "1"),
        png + b"\0": None,
        b"GIF89a\x05\0\x02\0;": ("gif", 5, 2, 2.5, "P"),
        b"BM\x1e\0\0\0" + bytes(8) + b"\x28\0\0\0\x06\0\0\0\xfd\xff\xff\xff\x01\0\x08\0": ("bmp", 6, 3, 2.0, "P"),
        jpeg + b"\xff\xc2\0\x0b\x08\0\x02\x01\0\x01\xff\xd9": ("jpeg", 256, 2, 128.0, "L"),
        jpeg + b"\xff\xda\0\x04\xff\xc2\0\x0b\x08\0\x02\x01\0\x01\xff\xd9": ("jpeg", None, None, None, None),
        b"\xff\xd8\xff\xe0\0\0\xff\xd9": ("jpeg", None, None, None, None),
        riff(b"VP8 \0\0\0\0\0\0\0\x9d\x01\x2a\x07\x40\x09\0"): ("webp", 7, 9, 0.777778, "RGB"),
        riff(b"VP8L\0\0\0\0\x2f" + (9 | 4 << 14 | 1 << 28).to_bytes(4, "little")): ("webp", 10, 5, 2.0, "RGBA"),
        riff(b"VP8X\x0a\0\0\0\x10\0\0\0\x07\0\0\x01\0\0"): ("webp", 8, 2, 4.0, "RGBA"),
        b"": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(files)] + [(99, None)], "i int, content binary")
    found = {r.i: tuple(r.h) for r in df.select("i", S.image_header(F.col("content")).alias("h")).collect()}
    assert found == {i: want or (None,) * 5 for i, want in {**dict(enumerate(files.values())), 99: None}.items()}


def test_folders_without_images_keep_their_class(spark, tmp_path):
    for name, data in (("a/no.txt", b"x"), ("b/1.png", b"\x89PNG\r\n\x1a\nxIEND\xaeB`\x82"), ("c/2.png", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {(r.label, r.class_idx, r.error) for r in images.scan_class_folders(spark, str(tmp_path)).collect()} == {("b", 1, None), ("c", 2, "undecodable")}


def test_tables_and_text_files(spark, tmp_path):
    columns = [c.split()[0] for c in images.MANIFEST.split(", ")]
    row = ["7", "p.png", "0007/p.png", "0007", "7", "", "3", "", "RGB", "true", "12", "0a", "ff", "0f", ""]
    sinks.write_csv(spark.createDataFrame([row], [*columns]), f"{tmp_path}/m")
    found = images.read_manifest(spark, f"{tmp_path}/m").first()
    assert (found.id, found.orig_label, found.width, found.height, found.decodable) == (7, "0007", None, 3, True)
    (tmp_path / "log.txt").write_text("a\n\nb")
    assert [(r.line_no, r.line) for r in images.read_log(spark, f"{tmp_path}/log.txt").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert images.count_lines(spark, f"{tmp_path}/log.txt") == 3
    for name in ("b.jpg", "a.png", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in images.list_predict_files(spark, f"{tmp_path}/in").collect()] == ["a.png", "b.jpg"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, None)], "id long, a double, b double")
    assert sinks.write_arrays(df, f"{tmp_path}/w", ["a", "b"]) == ["a"] and spark.read.parquet(f"{tmp_path}/w").columns == ["id", "a"]
    sinks.write_json(df, f"{tmp_path}/j")
    assert {r.id for r in spark.read.json(f"{tmp_path}/j").collect()} == {1, 2}
    sinks.write_submission(spark.createDataFrame([("b.jpg", 3), ("a.jpg", 12)], "filename string, pred int"), f"{tmp_path}/s")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/s").collect()] == [("a.jpg", "0012"), ("b.jpg", "0003")]
    sinks.write_features(spark.createDataFrame([(1, [1.0, 0.0])], "id long, z array<double>"), f"{tmp_path}/f", "one")
    assert sinks.check_fingerprint(spark.read.parquet(f"{tmp_path}/f"), "one").count() == 1
    with pytest.raises(Exception, match="other settings"):
        sinks.check_fingerprint(spark.read.parquet(f"{tmp_path}/f"), "two").collect()
    assert sinks.place_after(df, "b", "id").columns == ["id", "b", "a"]
    moved = sinks.remap_by_archive_path(spark.createDataFrame([("x", "0/a.png")], "path string, archive_path string"), "/data/")
    assert moved.first().path == "/data/0/a.png"
    with pytest.raises(KeyError):
        sinks.remap_by_archive_path(df, "/data")


def test_audit_log(spark):
    lines = ["[train] D:\\x\\train.zip：103218 个文件", "[train] 1000/103218 (1.0%)，可用 990，异常 10，65.8 张/秒", "noise", "[test] 9 个文件", "[train] 2000/103218 (1.9%)，可用 1980，异常 20，70.0 张/秒"]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    found = {r.stage: tuple(r)[1:] for r in report.audit_progress(log).collect()}
    assert found == {"train": (0, 103218, 2000, 103218, 1.9, 1980, 20, 70.0), "test": (3, 9, None, None, None, None, None, None)}
    assert abs(report.audit_share(report.audit_progress(log)).first().share - 2000 / 103227) < 1e-12
    assert report.audit_share(report.audit_progress(log.limit(0))).first().share is None
    shown = spark.createDataFrame([(0.0,), (59.9,), (3599.0,), (3600.0,), (-5.0,)], "s double").select(S.clock(F.col("s")).alias("t"))
    assert [r.t for r in shown.collect()] == ["00:00", "00:59", "59:59", "1:00:00", "00:00"]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master)))
    assert scratch_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "s3a://b/x/"}, sparkContext=None)).startswith("s3a://b/x/lodeflow/")


def test_settings(tmp_path):
    put = lambda text: (tmp_path / "c.json").write_text(text) and tmp_path / "c.json"
    found = read_settings(put('{"paths": {"train": "in/train", "far": "s3a://b/x", "here": "/x"}, "splitting": {"seed": 3, "val_ratio": 1}, "weights": {"cls": 2}}'))
    assert dict(found.paths) == {"train": str(tmp_path / "in/train"), "far": "s3a://b/x", "here": "/x"}
    assert (found.splitting.seed, found.splitting.val_ratio, found.splitting.folds, found.signals.k, dict(found.weights)) == (3, 1.0, 3, 20, {"cls": 2.0})
    for wrong in ("[1]", '{"speed": 1}', '{"splitting": {"seeds": 1}}', '{"splitting": {"seed": "1"}}', '{"splitting": {"seed": true}}', '{"signals": 3}', '{"weights": {}}', '{"paths": {"a": 1}}'):
        with pytest.raises(ValueError):
            read_settings(put(wrong))
    with pytest.raises(AttributeError):
        found.splitting.seed = 4


def test_plans(spark):
    rows = [(i, i % 2, f"h{i // 2}" if i < 8 else f"u{i}", None, True) for i in range(40)]
    manifest = spark.createDataFrame(rows, "id long, class_idx int, file_hash string, h long, decodable boolean")
    found = curation.audit_to_split(manifest)
    assert found.count() == 40 and found.groupBy("file_hash").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    kept = curation.training_rows(found)
    assert kept.where("id < 8").count() == 0 and kept.where("fold = 'val'").count() == 0
    _, df = clusters(spark, 5)
    scored = curation.features_to_q0(df.withColumn("fold", F.when(F.col("id") % 10 == 0, "val").otherwise("train")), k=5)
    assert scored.where("q0 IS NULL").count() == 6


def test_rows_meet_one_to_one(spark):
    make = lambda ids, name: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], f"id int, {name} int")
    assert sorted(map(tuple, curation.aligned(make([1, 2], "a"), make([2, 1], "b")).collect())) == [(1, 0, 1), (2, 1, 0)]
    assert tuple(curation.meeting(make([1, 1, None, 3], "a"), make([1, None, 4, 5], "b")).first()) == (4, 4, 2, 1, 2, 1)
    assert tuple(curation.meeting(make([], "a"), make([], "b")).first()) == (0,) * 6
    for left, right in (([1, 2], [1]), ([1], [1, 2]), ([1, 1], [1]), ([None, 1], [None, 1])):
        with pytest.raises(ValueError):
            curation.aligned(make(left, "a"), make(right, "b"))


def test_nearest_of_copies_and_zeros():
    """Ties, copies, zero vectors, values that are no number and fewer rows than k, against a full sort; few pairs are worked out in double precision."""
    draw = np.random.default_rng(3)
    right = draw.normal(size=(3000, 8))
    right[500:1500] = right[7]
    right[1600] += 1e-9 - 0 * right[1600]
    right[2000:2010] = 0.0
    right /= np.linalg.norm(right, axis=1, keepdims=True) + 1e-8
    right[2500] = np.nan
    ids = draw.permutation(3000).astype(np.int64)
    for n, k in ((3000, 21), (15, 21), (3000, 1)):
        row, nbr, cos = reliability._nearest(right[:300], right[:n], ids[:n], k)
        every = np.round(right[:300] @ right[:n].T, 9)
        order = np.lexsort((np.broadcast_to(ids[:n], every.shape), -every), axis=1)[:, :k]
        assert (row == np.repeat(np.arange(300), min(n, k))).all() and (nbr == ids[:n][order].reshape(-1)).all()
        assert np.allclose(cos, np.take_along_axis(every, order, 1).reshape(-1), atol=2e-9, equal_nan=True)
