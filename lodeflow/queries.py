"""Queries for the engine's own operators over the driver's tables, each with the SQL that checks it.

embeddings stand for features with labels, documents for a manifest (source is the label, the text's SHA-256 the
content hash), pages for archive entries, events, lineitem and conversations for larger tables of values and groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import losses as L
from lodeflow.functions import scalars as S
from lodeflow.functions import vectors as V
from lodeflow.operators import audit, dedup, mixup, reliability, report, split
from lodeflow.plans import curation
from lodeflow.session import materialize, scratch_dir
from lodeflow.sources import archive, store
from lodeflow.sources.sinks import submission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- tables -------------------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("label"), "lang", F.col("n_chars").alias("file_size"), "text", F.sha2("text", 256).alias("file_hash")
    )
    return audit.class_index(docs)


def _join_hash(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows with the columns of first for their file_hash, null ones among them."""
    first = first.withColumnRenamed("file_hash", "first_hash")
    return rows.join(first, F.col("file_hash").eqNullSafe(F.col("first_hash"))).drop("first_hash")


def _features(spark: SparkSession, sf: str, folds: int = 3) -> DataFrame:
    emb = _read(spark, sf, "embeddings")
    z = emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), F.expr("vec_id div 2").alias("g"), V.doubles(F.col("embedding")).alias("z"))
    return split.group_kfold(z, folds, group="g")


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest with fold val for a tenth of the rows and train for the others."""
    return _manifest(spark, sf).withColumn("fold", F.when(S.seeded_bucket(F.col("id"), 42, 10) == 0, "val").otherwise("train"))


MANIFEST = """manifest AS (
    SELECT doc_id AS id, source AS label, lang, n_chars AS file_size, text, sha256(text) AS file_hash,
           CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS class_idx
    FROM documents)"""
BUCKET = "CAST(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {n} AS INTEGER)"
FOLDED = MANIFEST + ", folded AS (SELECT *, CASE WHEN " + BUCKET.format(seed=42, key="id", n=10) + " = 0 THEN 'val' ELSE 'train' END AS fold FROM manifest)"
FEATURES = (
    "features AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, vec_id // 2 AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), "
    "f AS (SELECT *, " + BUCKET.format(seed=42, key="g", n=3) + " AS fold_no, list_transform(z, lambda x: x / (sqrt(list_dot_product(z, z)) + 1e-8)) AS unit FROM features)"
)


def _round(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


# ---- projections and filters -----------------------------------------------------------------------------------


@_query("SELECT doc_id AS id, n_chars AS file_size FROM documents WHERE n_chars % 7 <> 0")
def decodable_filter(spark, sf):
    return audit.decodable(_manifest(spark, sf).withColumn("decodable", F.col("file_size") % 7 != 0)).select("id", "file_size")


@_query(
    """SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS ext FROM (
    SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '' END AS path FROM pages)
    WHERE lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN ('.bmp','.gif','.jpeg','.jpg','.png','.tif','.tiff','.webp')"""
)
def ext_filter(spark, sf):
    tail = F.expr("CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '' END")
    pages = _read(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("path"))
    return pages.where(S.has_extension(F.col("path"))).select("page_id", "path", S.extension(F.col("path")).alias("ext"))


@_query("SELECT doc_id AS id, CASE WHEN n_chars % 5 <> 0 THEN round(CAST(n_chars AS DOUBLE) / (n_chars % 5), 6) END AS aspect_ratio FROM documents")
def aspect_ratio(spark, sf):
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.aspect_ratio(F.col("n_chars"), F.col("n_chars") % 5).alias("aspect_ratio"))


@_query("SELECT page_id, sha256(html) AS sha, md5(html) AS md FROM pages")
def content_digest(spark, sf):
    return _read(spark, sf, "pages").select("page_id", S.digest(F.col("html")).alias("sha"), S.digest(F.col("html"), "md5").alias("md"))


_RAW = """raw AS (SELECT page_id, page_id AS entry_no, CASE page_id % 12 WHEN 0 THEN '' WHEN 1 THEN '/abs/' || stem WHEN 2 THEN 'C:/' || stem WHEN 3 THEN 'a/../' || stem
    WHEN 4 THEN 'a\\' || stem WHEN 5 THEN 'a//' || stem WHEN 6 THEN './a/' || stem WHEN 7 THEN 'a/same.png' WHEN 8 THEN 'b/' || stem || '/' WHEN 9 THEN 'b/c/' || stem
    ELSE 'c/' || stem END AS path FROM (SELECT page_id, replace(regexp_replace(url, '^[a-z]+://', ''), '/', '_') || '.png' AS stem FROM pages))"""
_SAFE = """plain AS (SELECT *, replace(path, '\\', '/') AS p FROM raw),
parted AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS parts,
    p <> '' AND NOT starts_with(p, '/') AND NOT contains(split_part(p, '/', 1), ':') AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM plain),
norm AS (SELECT *, CASE WHEN safe THEN array_to_string(parts, '/') END AS norm_path FROM parted)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.concat(F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit("_")), F.lit(".png"))
    kinds = ["", "/abs/", "C:/", "a/../", "a\\", "a//", "./a/", None, "b/", "b/c/", "c/", "c/"]
    path = F.lit("a/same.png")
    for k, front in enumerate(kinds):
        if front is not None:
            built = F.lit("") if not front else F.concat(F.lit(front), F.col("stem"), F.lit("/" if k == 8 else ""))
            path = F.when(F.col("page_id") % 12 == k, built).otherwise(path)
    return _read(spark, sf, "pages").withColumn("stem", stem).select("page_id", F.col("page_id").alias("entry_no"), path.alias("path"))


@_query(f"WITH {_RAW}, {_SAFE} SELECT page_id, path, norm_path, CAST(CASE WHEN safe THEN len(parts) ELSE 0 END AS INTEGER) AS depth FROM norm")
def safe_path(spark, sf):
    return audit.normalized(_entries(spark, sf)).select("page_id", "path", "norm_path", "depth")


_CASCADE = f"""WITH {_RAW}, {_SAFE}, ranked AS (SELECT *, norm_path IS NOT NULL AND entry_no > min(entry_no) OVER (PARTITION BY norm_path) AS repeated,
    CAST(CASE WHEN safe THEN len(parts) ELSE 0 END AS INTEGER) AS depth FROM norm),
audited AS (SELECT page_id, CASE WHEN norm_path IS NULL THEN 'unsafe_path' WHEN repeated THEN 'duplicate_path' WHEN depth <> 2 THEN 'wrong_depth'
    WHEN NOT ends_with(lower(norm_path), '.png') THEN 'bad_extension' WHEN page_id % 17 = 3 THEN 'encrypted' WHEN page_id % 19 = 0 THEN 'empty'
    WHEN page_id % 23 = 0 THEN 'length_mismatch' WHEN page_id % 29 = 0 THEN 'undecodable' WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN 'write_conflict' END AS error,
    CASE WHEN norm_path IS NOT NULL AND len(parts) > 0 THEN parts[1] END AS label,
    CASE WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN 'conflict' WHEN page_id % 13 = 0 THEN 'reused' ELSE 'written' END AS status FROM ranked)"""


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    new = _entries(spark, sf).select(
        "*",
        (p % 17 == 3).alias("encrypted"),
        F.when(p % 19 == 0, 0).otherwise(100).alias("size"),
        F.when(p % 23 == 0, 99).when(p % 19 == 0, 0).otherwise(100).alias("declared_size"),
        (p % 29 != 0).alias("decodable"),
        F.md5(p.cast("string")).alias("file_hash"),
        F.when(p % 13 == 0, F.when(p % 2 == 0, F.lit("other")).otherwise(F.md5(p.cast("string")))).alias("existing_hash"),
    )
    files = new.select(F.col("page_id").cast("string").alias("path"), "file_hash")
    there = new.where("existing_hash IS NOT NULL").select(F.col("page_id").cast("string").alias("path"), F.col("existing_hash").alias("file_hash"))
    status = audit.write_status(files, there).select(F.col("path").cast("bigint").alias("page_id"), "status")
    return audit.validate(new, depth=2).join(status, "page_id")


@_query(f"{_CASCADE} SELECT page_id, error, label FROM audited")
def validation_cascade(spark, sf):
    return _audited(spark, sf).select("page_id", "error", "label")


@_query(f"{_CASCADE} SELECT page_id, status FROM audited")
def write_status(spark, sf):
    return _audited(spark, sf).select("page_id", "status")


@_query(
    f"""{_CASCADE} SELECT count(*) AS entries, count(*) FILTER (WHERE error IS NULL) AS accepted, count(*) FILTER (WHERE error IS NOT NULL) AS anomalies,
    count(*) FILTER (WHERE error IS NULL AND status = 'written') AS written, count(*) FILTER (WHERE error IS NULL AND status = 'reused') AS reused,
    count(DISTINCT CASE WHEN error IS NULL THEN label END) AS labels FROM audited"""
)
def audit_summary(spark, sf):
    return audit.audit_summary(_audited(spark, sf))


@_query(f"{_CASCADE} SELECT page_id, error FROM audited WHERE error IS NOT NULL")
def anomalies(spark, sf):
    audited = _audited(spark, sf)
    early, late = audited.where("error IN ('unsafe_path', 'duplicate_path')"), audited.where("error NOT IN ('unsafe_path', 'duplicate_path')")
    return early.select("page_id", "error").unionByName(late.select("page_id", "error"))


@_query("SELECT page_id, '/data/' || replace(regexp_replace(url, '^[a-z]+://', ''), 'example', 'sample') AS path, url LIKE 'http://%' AS counted FROM pages")
def remap_prefix(spark, sf):
    plain = F.regexp_replace("url", "^[a-z]+://", "")
    path = F.concat_ws("/", F.lit("/data"), S.replace_prefix(plain, "example", "sample"))
    return _read(spark, sf, "pages").select("page_id", path.alias("path"), F.startswith("url", F.lit("http://")).alias("counted"))


@_query(
    """SELECT doc_id AS id, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(text), 9, 8) AS BIGINT) AS lo FROM documents"""
)
def hex_to_long(spark, sf):
    h = S.hex_to_long(F.substring(F.md5("text"), 1, 16))
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), h.alias("h")).select(
        "id", F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo")
    )


@_query("SELECT doc_id AS id, lpad(printf('%04d', CAST(n_chars % 500 AS INTEGER)), 4, '0') AS class_name, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def class_names(spark, sf):
    return _read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), S.class_name((F.col("n_chars") % 500).cast("int")).alias("class_name"), F.sha2("text", 256).alias("file_hash"))


# ---- vectors ---------------------------------------------------------------------------------------------------


@_query(f"WITH {FEATURES} SELECT id, CAST(pos AS INTEGER) AS pos, round(unit[pos + 1], 6) AS v FROM f, range(64) t(pos)")
def l2_normalize(spark, sf):
    return _features(spark, sf).select("id", F.posexplode(V.l2_normalize(F.col("z"))).alias("pos", "v")).select("id", "pos", _round(F.col("v")).alias("v"))


_PROTO = """sums AS (SELECT y, pos, sum(z[pos + 1]) / count(*) AS m, count(*) AS n FROM f, range(64) t(pos) GROUP BY y, pos),
protos AS (SELECT y, max(n) AS n, list(m ORDER BY pos) AS mean FROM sums GROUP BY y),
p AS (SELECT y, n, list_transform(mean, lambda x: x / (sqrt(list_dot_product(mean, mean)) + 1e-8)) AS proto FROM protos),
cosines AS (SELECT id, f.y AS own, p.y AS y, 20 * list_dot_product(unit, proto) AS logit FROM f, p)"""


@_query(f"WITH {FEATURES}, {_PROTO} SELECT y, n, CAST(pos AS INTEGER) AS pos, round(proto[pos + 1], 6) AS v FROM p, range(64) t(pos)")
def class_prototypes(spark, sf):
    protos = reliability.class_prototypes(_features(spark, sf))
    return protos.select("y", "n", F.posexplode("proto").alias("pos", "v")).select("y", "n", "pos", _round(F.col("v")).alias("v"))


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    df = _features(spark, sf)
    return reliability.cosine_logits(df, reliability.class_prototypes(df))


@_query(f"WITH {FEATURES}, {_PROTO} SELECT id, y, round(logit, 6) AS logit FROM cosines")
def cosine_to_proto(spark, sf):
    return _logits(spark, sf).select("id", F.explode(F.arrays_zip("classes", "logits")).alias("c")).select("id", F.col("c.classes").alias("y"), _round(F.col("c.logits")).alias("logit"))


@_query(
    f"""WITH {FEATURES}, {_PROTO}, e AS (SELECT id, y, exp(logit - max(logit) OVER (PARTITION BY id)) AS x FROM cosines)
    SELECT id, y, round(x / (sum(x) OVER (PARTITION BY id) + 1e-8), 6) AS p FROM e"""
)
def softmax_probs(spark, sf):
    probs = _logits(spark, sf).select("id", "classes", V.softmax(F.col("logits")).alias("p"))
    return probs.select("id", F.explode(F.arrays_zip("classes", "p")).alias("c")).select("id", F.col("c.classes").alias("y"), _round(F.col("c.p")).alias("p"))


_PRED = "pred AS (SELECT id, any_value(own) AS y, arg_min(y, (-round(logit, 9), y)) AS pred FROM cosines GROUP BY id)"


@_query(f"WITH {FEATURES}, {_PROTO}, {_PRED} SELECT id, y, pred FROM pred")
def argmax_class(spark, sf):
    return reliability.predicted(_logits(spark, sf)).select("id", "y", "pred")


@_query(f"WITH {FEATURES}, {_PROTO}, {_PRED} SELECT count(*) AS n, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred")
def top1_accuracy(spark, sf):
    return report.accuracy(reliability.predicted(_logits(spark, sf)), F.col("pred"), F.col("y")).select("n", _round(F.col("accuracy")).alias("accuracy"))


@_query(f"WITH {FEATURES}, {_PROTO}, {_PRED} SELECT printf('%06d', id) || '.jpg' AS filename, printf('%04d', pred) AS class_name FROM pred")
def submission_rows(spark, sf):
    named = reliability.predicted(_logits(spark, sf)).withColumn("filename", F.concat(F.printf(F.lit("%06d"), F.col("id")), F.lit(".jpg")))
    return submission(named)


# ---- counts and reports ------------------------------------------------------------------------------------------


@_query(f"WITH {MANIFEST} SELECT class_idx, count(id) AS n FROM manifest GROUP BY class_idx")
def class_counts(spark, sf):
    rows = _manifest(spark, sf)
    return report.class_counts(rows, rows.select("class_idx").distinct())


@_query(f"WITH {MANIFEST} SELECT id, file_hash, group_size FROM (SELECT *, count(*) OVER (PARTITION BY file_hash) AS group_size FROM manifest) WHERE group_size > 1")
def dup_groups(spark, sf):
    return dedup.dup_groups(_manifest(spark, sf)).select("id", "file_hash", "group_size")


@_query("SELECT conv_id AS group_id, role AS class_idx, count(*) AS n FROM conversations GROUP BY ALL")
def group_class_contingency(spark, sf):
    return split.contingency(_read(spark, sf, "conversations").select(F.col("conv_id").alias("group_id"), F.col("role").alias("class_idx")))


@_query(f"WITH {MANIFEST} SELECT file_hash, count(*) AS n, count(DISTINCT class_idx) AS n_labels FROM manifest WHERE file_hash IS NOT NULL GROUP BY file_hash")
def distinct_classes_per_hash(spark, sf):
    return dedup.hash_groups(_manifest(spark, sf))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return report.value_counts(_read(spark, sf, "events"), "event_type")


@_query(
    f"""WITH {MANIFEST}, lines AS (SELECT CAST(id AS VARCHAR) AS path, file_hash FROM manifest),
    b AS (SELECT substr(sha256(path), 1, 2) AS bucket, count(*) AS n, sha256(string_agg(path || chr(0) || file_hash || chr(10), '' ORDER BY path || chr(0) || file_hash)) AS h FROM lines GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || h, '' ORDER BY bucket)) AS fingerprint FROM b"""
)
def dataset_fingerprint(spark, sf):
    return audit.dataset_fingerprint(_manifest(spark, sf), F.col("id").cast("string"), F.col("file_hash"))


@_query(
    f"""WITH {MANIFEST} SELECT count(DISTINCT class_idx) AS classes, count(*) AS images, count(*) FILTER (WHERE place <= 5 AND file_size % 7 = 0) AS unreadable
    FROM (SELECT *, row_number() OVER (PARTITION BY class_idx ORDER BY id) AS place FROM manifest)"""
)
def data_check(spark, sf):
    return audit.sampled_check(_manifest(spark, sf), "class_idx", "id", F.col("file_size") % 7 != 0)


def _quantile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, " + ", ".join(f"round(CAST(quantile_cont({c}, {q}) AS DOUBLE), 6) AS q{int(q * 100)}" for q in report.QUARTILES) + f" FROM {table}" for c in columns
    )


@_query(_quantile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def signal_quantiles(spark, sf):
    found = report.quantiles(_read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("name", *(_round(F.col(f"q{int(q * 100)}")).alias(f"q{int(q * 100)}") for q in report.QUARTILES))


@_query(
    """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem"""
)
def signal_corr(spark, sf):
    return report.correlations(_read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", _round(F.col("r")))


# ---- windows and splits --------------------------------------------------------------------------------------------


@_query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN n <= 1 THEN 0.5 ELSE round((rk + (same - 1) / 2e0 - 1) / (n - 1), 6) END AS r FROM (
    SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rk, count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS same,
    count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"""
)
def rank_within_class(spark, sf):
    return reliability.rank_within_class(_read(spark, sf, "lineitem"), "l_quantity", "l_suppkey").select("l_orderkey", "l_linenumber", _round(F.col("r")).alias("r"))


_PARTS = """sizes AS (SELECT class_idx, count(*) AS n FROM folded WHERE fold <> 'val' GROUP BY class_idx),
placed AS (SELECT *, row_number() OVER (ORDER BY n, class_idx) AS place, count(*) OVER () AS c FROM sizes),
parts AS (SELECT class_idx, n, CASE WHEN place > c - floor(c * 0.33e0) THEN 'head' WHEN place <= floor(c * 0.33e0) THEN 'tail' ELSE 'middle' END AS part FROM placed)"""


@_query(f"WITH {FOLDED}, {_PARTS} SELECT class_idx, n, part FROM parts")
def head_mid_tail(spark, sf):
    return split.class_parts(_folded(spark, sf))


@_query(f"WITH {FOLDED}, {_PARTS} SELECT id, class_idx, coalesce(part, 'middle') AS part FROM folded LEFT JOIN parts USING (class_idx)")
def assign_parts(spark, sf):
    return split.assign_parts(_folded(spark, sf)).select("id", "class_idx", "part")


@_query(f"WITH {MANIFEST} SELECT id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS group_id FROM (SELECT id, min(id) OVER (PARTITION BY file_hash) AS first FROM manifest)")
def dense_group_ids(spark, sf):
    rows = _manifest(spark, sf)
    first = rows.groupBy("file_hash").agg(F.min("id").alias("first"))
    return dedup.dense_ids(_join_hash(rows, first), "first", "group_id").select("id", "group_id")


@_query(f"WITH {MANIFEST} SELECT id, label, class_idx FROM manifest")
def class_index(spark, sf):
    return _manifest(spark, sf).select("id", "label", "class_idx")


@_query(
    """WITH h AS (SELECT p_brand AS history, p_partkey AS epoch, CAST(p_size AS DOUBLE) / 50 + p_partkey / 1e5 AS acc FROM part),
    b AS (SELECT *, greatest(coalesce(max(acc) OVER (PARTITION BY history ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS before FROM h),
    i AS (SELECT *, acc > before AS improved, greatest(acc, before) AS best FROM b),
    s AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY history ORDER BY epoch), min(epoch) OVER (PARTITION BY history) - 1) AS stale FROM i)
    SELECT history, epoch, improved, round(best, 6) AS best, CAST(stale AS BIGINT) AS stale, stale >= 5 AS stopped FROM s"""
)
def early_stop_scan(spark, sf):
    acc = F.col("p_size").cast("double") / 50 + F.col("p_partkey") / F.lit(1e5)
    history = _read(spark, sf, "part").select(F.col("p_brand").alias("history"), F.col("p_partkey").alias("epoch"), acc.alias("acc"))
    return report.early_stopping(history, 5, "history").select("history", "epoch", "improved", _round(F.col("best")).alias("best"), "stale", "stopped")


@_query(
    """WITH h AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS history, p_partkey AS epoch, p_retailprice / 1e4 AS acc FROM part),
    b AS (SELECT *, greatest(coalesce(max(acc) OVER (PARTITION BY history ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS before FROM h),
    i AS (SELECT *, acc > before AS improved, greatest(acc, before) AS best FROM b),
    s AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY history ORDER BY epoch), min(epoch) OVER (PARTITION BY history) - 1) AS stale FROM i)
    SELECT history, epoch, improved, round(best, 6) AS best, CAST(stale AS BIGINT) AS stale, stale >= 5 AS stopped FROM s"""
)
def early_stop_histories(spark, sf):
    history = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("history")
    rows = _read(spark, sf, "part").select(history, F.col("p_partkey").alias("epoch"), (F.col("p_retailprice") / F.lit(1e4)).alias("acc"))
    return report.early_stopping(rows, 5, "history").select("history", "epoch", "improved", _round(F.col("best")).alias("best"), "stale", "stopped")


@_query("SELECT conv_id, turn, " + BUCKET.format(seed=42, key="conv_id", n=5) + " AS fold_no FROM conversations")
def group_kfold(spark, sf):
    return split.group_kfold(_read(spark, sf, "conversations"), 5, group="conv_id").select("conv_id", "turn", "fold_no")


@_query(f"WITH {MANIFEST} SELECT id, class_idx, CAST((row_number() OVER (PARTITION BY class_idx ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 3 AS INTEGER) AS fold_no FROM manifest")
def stratified_kfold(spark, sf):
    return split.stratified_kfold(_manifest(spark, sf), 3).select("id", "class_idx", "fold_no")


@_query(
    f"""WITH {MANIFEST}, rows AS (SELECT id, class_idx, min(id) OVER (PARTITION BY file_hash) AS group_id FROM manifest),
    counts AS (SELECT group_id, class_idx, count(*) AS n FROM rows GROUP BY ALL),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY class_idx) AS class_n FROM counts),
    main AS (SELECT group_id, arg_max(class_idx, (n, -class_idx)) AS class_idx, sum(n) AS size FROM sized GROUP BY group_id),
    joined AS (SELECT main.*, class_n FROM main JOIN (SELECT DISTINCT class_idx, class_n FROM sized) USING (class_idx)),
    run AS (SELECT *, sum(size) OVER (PARTITION BY class_idx ORDER BY md5('42:' || CAST(group_id AS VARCHAR)), group_id ROWS UNBOUNDED PRECEDING) AS upto FROM joined)
    SELECT rows.id, group_id, CASE WHEN class_n < 10 THEN 'oof_' || CAST({BUCKET.format(seed=42, key="group_id", n=3)} AS VARCHAR)
        WHEN upto <= greatest(1, floor(class_n * 0.1e0)) THEN 'val' ELSE 'train' END AS fold FROM rows JOIN run USING (group_id)"""
)
def split_quota(spark, sf):
    rows = _manifest(spark, sf)
    first = rows.groupBy("file_hash").agg(F.min("id").alias("group_id"))
    return split.split_quota(_join_hash(rows, first).select("id", "group_id", "class_idx")).select("id", "group_id", "fold")


@_query()
def split_greedy(spark, sf):
    rows = _manifest(spark, sf)
    first = rows.groupBy("file_hash").agg(F.min("id").alias("group_id"))
    return split.split_greedy(_join_hash(rows, first).select("id", "group_id", "class_idx")).select("id", "group_id", "fold")


@_query(
    f"""WITH {MANIFEST}, groups AS (SELECT file_hash, count(*) AS n, count(DISTINCT class_idx) AS k FROM manifest WHERE file_hash IS NOT NULL GROUP BY file_hash),
    w AS (SELECT id, CASE WHEN n > 1 AND k = 1 THEN 1e0 / n ELSE 1e0 END AS w FROM manifest LEFT JOIN groups USING (file_hash)),
    placed AS (SELECT id, w, sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS high FROM w),
    points AS (SELECT range AS draw, CAST('0x' || substr(md5('42:' || CAST(range AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 * (SELECT sum(w) FROM w) AS spot FROM range(1000))
    SELECT draw, id FROM points JOIN placed ON spot >= high - w AND spot < high"""
)
def weighted_sample(spark, sf):
    return split.weighted_sample(dedup.dup_weight(_manifest(spark, sf)), "weight", 1000)


# ---- duplicates ----------------------------------------------------------------------------------------------------

_CONFLICT = "groups AS (SELECT file_hash, count(*) AS n, count(DISTINCT class_idx) AS k FROM manifest WHERE file_hash IS NOT NULL GROUP BY file_hash)"


@_query(f"WITH {MANIFEST}, {_CONFLICT} SELECT id, class_idx, coalesce(n > 1 AND k > 1, false) AS conflict FROM manifest LEFT JOIN groups USING (file_hash)")
def conflict_mask(spark, sf):
    return dedup.conflict_mask(_manifest(spark, sf)).select("id", "class_idx", "conflict")


@_query(f"WITH {MANIFEST}, {_CONFLICT} SELECT id, CASE WHEN n > 1 AND k = 1 THEN round(1e0 / n, 9) ELSE 1e0 END AS weight FROM manifest LEFT JOIN groups USING (file_hash)")
def dup_weight(spark, sf):
    return dedup.dup_weight(_manifest(spark, sf)).select("id", _round(F.col("weight"), 9).alias("weight"))


@_query(f"WITH {FOLDED}, groups AS (SELECT file_hash, count(*) AS n, count(DISTINCT class_idx) AS k FROM manifest GROUP BY file_hash) SELECT id, class_idx FROM folded JOIN groups USING (file_hash) WHERE fold <> 'val' AND NOT (n > 1 AND k > 1)")
def drop_conflicts(spark, sf):
    return dedup.drop_conflicts(_folded(spark, sf)).where("fold <> 'val'").select("id", "class_idx")


_SIMHASH = """words AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))) AS w FROM documents),
bits AS (SELECT id, b, CAST('0x' || substr(md5(w), CAST(1 + 2 * (b // 8) AS BIGINT), 2) AS BIGINT) >> (7 - b % 8) & 1 AS bit FROM words, range(64) t(b)),
votes AS (SELECT id, b, 2 * sum(bit) > count(*) AS yes FROM bits GROUP BY id, b),
prints AS (SELECT id, CAST(sum(CASE WHEN yes AND b < 32 THEN 1::BIGINT << (31 - b) ELSE 0 END) AS BIGINT) AS hi,
    CAST(sum(CASE WHEN yes AND b >= 32 THEN 1::BIGINT << (63 - b) ELSE 0 END) AS BIGINT) AS lo FROM votes GROUP BY id)"""


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.simhash(_read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def _halves(name: str, *keep: str) -> list[Column]:
    return [F.shiftrightunsigned(name, 32).alias(f"{name}_hi"), F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"{name}_lo"), *map(F.col, keep)]


@_query(
    f"""WITH {_SIMHASH}, d AS (SELECT DISTINCT hi, lo FROM prints), pairs AS (SELECT a.hi AS ah, a.lo AS al, b.hi AS bh, b.lo AS bl,
    bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM d a, d b WHERE (a.hi, a.lo) <> (b.hi, b.lo)),
    signed AS (SELECT *, (CASE WHEN ah >= 2147483648 THEN ah - 4294967296 ELSE ah END) AS sa, (CASE WHEN bh >= 2147483648 THEN bh - 4294967296 ELSE bh END) AS sb FROM pairs WHERE distance <= 8)
    SELECT ah AS a_hi, al AS a_lo, bh AS b_hi, bl AS b_lo, CAST(distance AS INTEGER) AS distance FROM signed WHERE (sa, al) < (sb, bl)"""
)
def hamming_pairs(spark, sf):
    return dedup.hamming_pairs(_prints(spark, sf), 8).select(*_halves("a"), *_halves("b", "distance"))


@_query(
    f"""WITH RECURSIVE {_SIMHASH}, m AS (SELECT doc_id AS id, sha256(text) AS h, hi, lo FROM documents LEFT JOIN prints ON doc_id = prints.id),
    link AS (SELECT a.id AS x, b.id AS y FROM m a JOIN m b ON a.h = b.h OR bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8),
    reach(x, y) AS (SELECT id, id FROM m UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
    root AS (SELECT x AS id, min(y) AS r FROM reach GROUP BY x)
    SELECT id, CAST(dense_rank() OVER (ORDER BY r) - 1 AS BIGINT) AS group_id FROM root"""
)
def near_dup_components(spark, sf):
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash")).join(_prints(spark, sf), "id", "left")
    return dedup.build_groups(rows).select("id", "group_id")


# ---- reliability ---------------------------------------------------------------------------------------------------

_OOF = """per AS (SELECT fold_no, y, pos, sum(z[pos + 1]) AS s, count(*) AS n FROM f, range(64) t(pos) GROUP BY ALL),
tot AS (SELECT y, pos, sum(s) AS s, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY ALL),
rest AS (SELECT k.fold_no, tot.y, tot.pos, CASE WHEN tot.n - coalesce(per.n, 0) > 0 THEN (tot.s - coalesce(per.s, 0)) / (tot.n - coalesce(per.n, 0)) ELSE 0 END AS m
    FROM tot CROSS JOIN (SELECT DISTINCT fold_no FROM f) k LEFT JOIN per ON per.fold_no = k.fold_no AND per.y = tot.y AND per.pos = tot.pos),
rl AS (SELECT fold_no, y, list(m ORDER BY pos) AS m FROM rest GROUP BY ALL),
rp AS (SELECT fold_no, y, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-8)) AS proto FROM rl),
ol AS (SELECT id, f.y AS own, rp.y AS y, 20 * list_dot_product(unit, proto) AS logit FROM f JOIN rp USING (fold_no)),
oe AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM ol),
op AS (SELECT *, e / (sum(e) OVER (PARTITION BY id) + 1e-8) AS p FROM oe),
oof AS (SELECT id, round(p, 6) AS cls, round(-ln(p + 1e-8), 6) AS loss FROM op WHERE y = own)"""
_LOO = """cs AS (SELECT y, pos, sum(z[pos + 1]) AS s, count(*) AS n FROM f, range(64) t(pos) GROUP BY ALL),
gs AS (SELECT g, y, pos, sum(z[pos + 1]) AS s, count(*) AS n FROM f, range(64) t(pos) GROUP BY ALL),
gm AS (SELECT list(s / n ORDER BY pos) AS m FROM (SELECT pos, sum(s) AS s, sum(n) AS n FROM cs GROUP BY pos)),
g0 AS (SELECT list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-8)) AS g0 FROM gm),
cl AS (SELECT y, max(n) AS n, list(s ORDER BY pos) AS s FROM cs GROUP BY y),
gl AS (SELECT g, y, max(n) AS n, list(s ORDER BY pos) AS s FROM gs GROUP BY g, y),
cn AS (SELECT y, n, s, g0, list_transform(s, lambda x: x / (sqrt(list_dot_product(s, s)) + 1e-8)) AS u FROM cl, g0),
cb AS (SELECT *, list_transform(list_zip(u, g0), lambda t: n / (n + 10e0) * t[1] + (1 - n / (n + 10e0)) * t[2]) AS b FROM cn),
cp AS (SELECT *, list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-8)) AS own FROM cb),
lo AS (SELECT f.id, f.y, f.unit, cp.n, cp.g0, cp.n - gl.n AS left_n, list_transform(list_zip(cp.s, gl.s), lambda t: t[1] - t[2]) AS d FROM f JOIN cp USING (y) JOIN gl ON gl.g = f.g AND gl.y = f.y),
ln_ AS (SELECT *, list_transform(d, lambda x: x / (sqrt(list_dot_product(d, d)) + 1e-8)) AS u FROM lo),
lb AS (SELECT *, list_transform(list_zip(u, g0), lambda t: n / (n + 10e0) * t[1] + (1 - n / (n + 10e0)) * t[2]) AS b FROM ln_),
lp AS (SELECT *, CASE WHEN left_n > 0 THEN list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-8)) ELSE g0 END AS own FROM lb),
rv AS (SELECT f.id, max(list_dot_product(f.unit, cp.own)) AS rival FROM f JOIN cp ON cp.y <> f.y GROUP BY f.id),
loo AS (SELECT lp.id, round(list_dot_product(unit, own) - coalesce(rival, 0), 6) AS proto FROM lp LEFT JOIN rv ON rv.id = lp.id)"""
_KNN = """kc AS (SELECT a.id, b.id AS nbr, a.y, b.y AS ny, a.g, b.g AS ng, round(list_dot_product(a.unit, b.unit), 9) AS cos FROM f a, f b),
kr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, nbr) AS rank FROM kc),
kt AS MATERIALIZED (SELECT * FROM kr WHERE rank <= 21),
ke AS (SELECT * FROM kt WHERE id <> nbr AND g <> ng),
km AS (SELECT a.* FROM ke a JOIN ke b ON a.id = b.nbr AND a.nbr = b.id),
ks AS (SELECT id, sum(CASE WHEN y = ny THEN greatest(cos, 0) ELSE 0 END) / (sum(greatest(cos, 0)) + 1e-8) AS knn FROM km GROUP BY id),
agree AS (SELECT f.id, round(coalesce(knn, 0), 6) AS knn FROM f LEFT JOIN ks USING (id))"""
_SIGNALS = f"WITH {FEATURES}, {_OOF}, {_LOO}, {_KNN}, wide AS (SELECT f.id, f.y, cls, loss, proto, knn FROM f JOIN oof USING (id) JOIN loo USING (id) JOIN agree USING (id))"


def _rank_sql(v: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY y) <= 1 THEN 0.5e0 ELSE (rank() OVER (PARTITION BY y ORDER BY {v}) + (count(*) OVER (PARTITION BY y, {v}) - 1) / 2e0 - 1) / (count(*) OVER (PARTITION BY y) - 1) END"


_FUSED = f"""{_SIGNALS}, ranked AS (SELECT *, {_rank_sql('cls')} AS r1, {_rank_sql('proto')} AS r2, {_rank_sql('knn')} AS r3 FROM wide),
meant AS (SELECT *, (r1 + r2 + r3) / 3 AS m FROM ranked),
fused AS (SELECT *, least(greatest(m - 0.1e0 * ((r1 - m) * (r1 - m) + (r2 - m) * (r2 - m) + (r3 - m) * (r3 - m)) / 3, 0), 1) AS q FROM meant),
kept AS (SELECT *, CASE WHEN sum(q) OVER (PARTITION BY y) < 5 THEN least(greatest(q + (5 - sum(q) OVER (PARTITION BY y)) / count(*) OVER (PARTITION BY y), 0), 1) ELSE q END AS q0 FROM fused)"""


@_query(f"WITH {FEATURES}, {_OOF} SELECT id, cls, loss FROM oof")
def oof_signal(spark, sf):
    return reliability.oof_signal(_features(spark, sf))


@_query(f"WITH {FEATURES}, {_LOO} SELECT id, proto FROM loo")
def loo_prototype(spark, sf):
    return reliability.prototype_signal(_features(spark, sf))


@_query(f"WITH {FEATURES}, {_KNN} SELECT id, nbr, cos, CAST(rank AS INTEGER) AS rank FROM kr WHERE rank <= 21")
def knn_topk(spark, sf):
    return reliability.knn(_features(spark, sf), 21).select("id", "nbr", "cos", F.col("rank").cast("int").alias("rank"))


@_query(f"WITH {FEATURES}, {_KNN} SELECT a.id, a.nbr, a.cos FROM kt a JOIN kt b ON a.id = b.nbr AND a.nbr = b.id")
def mutual_knn(spark, sf):
    return reliability.mutual(reliability.knn(_features(spark, sf), 21)).select("id", "nbr", "cos")


@_query(f"WITH {FEATURES}, {_KNN} SELECT id, knn FROM agree")
def mutual_knn_signal(spark, sf):
    return reliability.mutual_knn_signal(_features(spark, sf))


@_query(f"{_FUSED} SELECT id, y, round(q, 6) AS q0 FROM fused")
def fuse_q0(spark, sf):
    df = _features(spark, sf)
    wide = df.select("id", "y").join(reliability.oof_signal(df), "id").join(reliability.prototype_signal(df), "id").join(reliability.mutual_knn_signal(df), "id")
    return reliability.fuse_q0(materialize(wide), {"cls": 1.0, "proto": 1.0, "knn": 1.0}).select("id", "y", _round(F.col("q0")).alias("q0"))


@_query(
    """WITH v AS (SELECT s_suppkey AS id, CAST(s_nationkey AS INTEGER) AS y, abs(s_acctbal) % 100 / 400 AS q FROM supplier)
    SELECT id, y, round(CASE WHEN sum(q) OVER w < 5 THEN least(greatest(q + (5 - sum(q) OVER w) / count(*) OVER w, 0), 1) ELSE least(greatest(q, 0), 1) END, 6) AS q0 FROM v WINDOW w AS (PARTITION BY y)"""
)
def tail_protection(spark, sf):
    v = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("y"), (F.abs("s_acctbal") % 100 / 400).alias("q0"))
    return reliability.tail_protection(v).select("id", "y", _round(F.col("q0")).alias("q0"))


@_query(f"{_FUSED} SELECT id, y, cls, proto, knn, loss, round(q0, 6) AS q0 FROM kept")
def q0_full(spark, sf):
    return reliability.compute_q0(_features(spark, sf)).select("id", "y", "cls", "proto", "knn", "loss", _round(F.col("q0")).alias("q0"))


@_query(
    f"""{_FUSED}, sizes AS (SELECT y, count(*) AS n FROM kept GROUP BY y), placed AS (SELECT *, row_number() OVER (ORDER BY n, y) AS place, count(*) OVER () AS c FROM sizes),
    parts AS (SELECT y, CASE WHEN place > c - floor(c * 0.33e0) THEN 'head' WHEN place <= floor(c * 0.33e0) THEN 'tail' ELSE 'middle' END AS part FROM placed)
    SELECT part, round(avg(q0), 6) AS mean, round(stddev_samp(q0), 6) AS std, count(q0) AS n FROM kept JOIN parts USING (y) GROUP BY part"""
)
def q0_by_part(spark, sf):
    scored = reliability.compute_q0(_features(spark, sf)).withColumn("fold", F.lit("train"))
    found = report.spread_by(split.assign_parts(scored, key="y"), "part", "q0")
    return found.select("part", _round(F.col("mean")).alias("mean"), _round(F.col("std")).alias("std"), "n")


_PART = "ln({w}) - 0.5e0 * ln({s}) - (v - {m}) * (v - {m}) / (2 * {s})"
_GMM = f"""WITH RECURSIVE {FEATURES}, {_OOF}, counts AS MATERIALIZED (SELECT loss AS v, CAST(count(*) AS DOUBLE) AS n FROM oof GROUP BY loss),
moments AS (SELECT sum(n) AS n, min(v) AS low, max(v) AS high, sum(n * v) / sum(n) AS mean, greatest(sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) ** 2, 1e-6) AS var FROM counts),
em(k, i, w, m1, s1, m2, s2) AS (
    SELECT 0, i, 0.5e0, CASE i WHEN 0 THEN low WHEN 1 THEN mean - sqrt(var) ELSE mean END, var, CASE i WHEN 1 THEN mean + sqrt(var) ELSE high END, var FROM moments, range(3) t(i)
    UNION ALL (SELECT k + 1, i, least(greatest(sum(n * r) / sum(n), 1e-9), 1 - 1e-9),
        sum(n * r * v) / greatest(sum(n * r), 1e-9), greatest(sum(n * r * v * v) / greatest(sum(n * r), 1e-9) - (sum(n * r * v) / greatest(sum(n * r), 1e-9)) ** 2, 1e-6),
        sum(n * (1 - r) * v) / greatest(sum(n * (1 - r)), 1e-9), greatest(sum(n * (1 - r) * v * v) / greatest(sum(n * (1 - r)), 1e-9) - (sum(n * (1 - r) * v) / greatest(sum(n * (1 - r)), 1e-9)) ** 2, 1e-6)
    FROM (SELECT k, i, v, n, 1 / (1 + exp(least(greatest(({_PART.format(w="1 - w", m="m2", s="s2")}) - ({_PART.format(w="w", m="m1", s="s1")}), -700), 700))) AS r FROM em, counts WHERE k < {reliability.EM_STEPS}) GROUP BY k, i)),
done AS (SELECT * FROM em WHERE k = {reliability.EM_STEPS}),
scores AS (SELECT i, round(sum(n * (greatest(a, b) + ln(1 + exp(-abs(a - b))))), 4) AS score FROM (SELECT i, n, {_PART.format(w="w", m="m1", s="s1")} AS a, {_PART.format(w="1 - w", m="m2", s="s2")} AS b FROM done, counts) GROUP BY i),
best AS (SELECT CASE WHEN m2 < m1 THEN 1 - w ELSE w END AS w, least(m1, m2) AS m1, CASE WHEN m2 < m1 THEN s2 ELSE s1 END AS s1, greatest(m1, m2) AS m2, CASE WHEN m2 < m1 THEN s1 ELSE s2 END AS s2
    FROM done WHERE i = (SELECT arg_max(i, (score, -i)) FROM scores)),
scored AS (SELECT id, v, 1 / (1 + exp(least(greatest(({_PART.format(w="1 - w", m="m2", s="s2")}) - ({_PART.format(w="w", m="m1", s="s1")}), -700), 700))) AS gmm FROM (SELECT id, loss AS v FROM oof), best),
gate AS (SELECT count(*) AS n, count(*) FILTER (WHERE gmm >= 0.5) AS a, avg(CASE WHEN (gmm >= 0.5) = (v <= (SELECT median(loss) FROM oof)) THEN 1e0 ELSE 0 END) AS same FROM scored)
SELECT id, round(gmm, 4) AS gmm FROM scored, gate WHERE n >= 100 AND least(a, n - a) >= 50 AND same > 0.55e0"""


@_query(_GMM)
def gmm_gate(spark, sf):
    found = reliability.gmm_signal(reliability.oof_signal(_features(spark, sf)), least=50)
    return found.select("id", _round(F.col("gmm"), 4).alias("gmm")) if found is not None else spark.createDataFrame([], "id bigint, gmm double")


# ---- losses and schedules ------------------------------------------------------------------------------------------

_LOSS = f"""WITH {FEATURES}, {_PROTO}, mx AS (SELECT *, max(logit) OVER (PARTITION BY id) AS m FROM cosines),
lp AS (SELECT id, own, y, logit - m - ln(sum(exp(logit - m)) OVER (PARTITION BY id)) AS logp FROM mx),
each AS (SELECT id, -logp AS ce, (1 - pow(greatest(exp(logp), 1e-8), 0.7e0)) / 0.7e0 AS gce, (id % 10) / 10e0 AS q FROM lp WHERE y = own),
mean AS (SELECT id, sum(logp) AS s, count(*) AS k FROM lp GROUP BY id)"""


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    index = (F.array_position("classes", F.col("y")) - 1).cast("int")
    return _logits(spark, sf).select("id", "logits", index.alias("label"), (F.col("id") % 10 / 10).alias("reliability"), V.l2_normalize(F.col("z")).alias("z"))


@_query(f"{_LOSS} SELECT round(sum(q * ce) / (sum(q) + 1e-8), 6) AS loss FROM each")
def weighted_ce(spark, sf):
    return _losses(spark, sf).agg(_round(L.weighted_mean(L.cross_entropy(F.col("logits"), F.col("label")), F.col("reliability"))).alias("loss"))


@_query(f"{_LOSS} SELECT id, round(ce, 6) AS ce, round(0.9e0 * ce - 0.1e0 * s / k, 6) AS smoothed FROM each JOIN mean USING (id)")
def plain_ce(spark, sf):
    return _losses(spark, sf).select(
        "id", _round(L.cross_entropy(F.col("logits"), F.col("label"))).alias("ce"), _round(L.smoothed_cross_entropy(F.col("logits"), F.col("label"), 0.1)).alias("smoothed")
    )


@_query(f"{_LOSS} SELECT round(avg(gce), 6) AS loss FROM each")
def gce(spark, sf):
    return _losses(spark, sf).agg(_round(F.avg(L.gce(F.col("logits"), F.col("label")))).alias("loss"))


@_query(f"{_LOSS} SELECT round(sum(q * gce) / (sum(q) + 1e-8), 6) AS loss FROM each")
def weighted_gce(spark, sf):
    return _losses(spark, sf).agg(_round(L.weighted_mean(L.gce(F.col("logits"), F.col("label")), F.col("reliability"))).alias("loss"))


_ANCHOR = ", pairs AS (SELECT a.id, (0.1e0 + 0.9e0 * (1 - (a.id % 10) / 10e0)) * (1 - list_dot_product(a.unit, b.proto)) AS anchor FROM f a JOIN p b ON a.y = b.y)"


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    protos = reliability.class_prototypes(_features(spark, sf)).select("y", F.col("proto").alias("z0"))
    return _losses(spark, sf).join(_features(spark, sf).select("id", "y"), "id").join(protos, "y")


@_query(f"{_LOSS}{_ANCHOR} SELECT id, round(anchor, 6) AS anchor FROM pairs")
def anchor_loss(spark, sf):
    return _anchored(spark, sf).select("id", _round(L.anchor(F.col("z"), F.col("z0"), F.col("reliability"))).alias("anchor"))


@_query(
    f"""{_LOSS}{_ANCHOR}, s AS (SELECT sum(CASE WHEN q < 0.3e0 THEN 0 ELSE q * gce END) / (sum(CASE WHEN q < 0.3e0 THEN 0 ELSE q END) + 1e-8) AS supervised FROM each),
    a AS (SELECT avg(anchor) AS anchor FROM pairs) SELECT round(supervised, 6) AS supervised, round(anchor, 6) AS anchor, round(supervised + 0.5e0 * anchor, 6) AS total FROM s, a"""
)
def total_loss_hard_drop(spark, sf):
    found = L.total_loss(_anchored(spark, sf), "gce", anchor_weight=0.5, hard_drop=0.3)
    return found.select(*(_round(F.col(c)).alias(c) for c in ("supervised", "anchor", "total")))


@_query("SELECT range AS step, round(CASE WHEN range < 10 THEN (range + 1) / 10e0 ELSE 0.5e0 * (1 + cos(pi() * (range - 10) / 90e0)) END, 6) AS factor FROM range(100)")
def lr_schedule(spark, sf):
    return L.lr_schedule(spark, 100, 10).select("step", _round(F.col("factor")).alias("factor"))


@_query("SELECT range AS layer, round(1e-3 * pow(0.75e0, 11 - range), 12) AS rate FROM range(12)")
def layer_lr(spark, sf):
    return L.layer_rates(spark, 12, 1e-3, 0.75).select("layer", _round(F.col("rate"), 12).alias("rate"))


@_query(
    f"""WITH {FEATURES} SELECT a.id, CAST(c AS INTEGER) AS c, round(0.7e0 * (CASE WHEN a.y = c THEN 1 ELSE 0 END) + 0.3e0 * (CASE WHEN b.y = c THEN 1 ELSE 0 END), 6) AS target
    FROM f a JOIN f b ON b.id = a.g * 2 + 1 - a.id % 2, range(10) t(c)"""
)
def mixup_targets(spark, sf):
    df = _features(spark, sf).select("id", "g", "y")
    other = df.select(F.col("id").alias("partner"), F.col("y").alias("py"))
    met = df.withColumn("partner", F.col("g") * 2 + 1 - F.col("id") % 2).join(other, "partner")
    target = V.blend(V.one_hot(F.col("y"), 10), V.one_hot(F.col("py"), 10), 0.7)
    return met.select("id", F.posexplode(target).alias("c", "t")).select("id", "c", _round(F.col("t")).alias("target"))


_LOG = """log AS (SELECT event_id AS line_no, '[' || event_type || '] ' || CAST(event_id AS VARCHAR) || '/' || CAST(event_id + user_id AS VARCHAR) ||
    CASE WHEN event_id % 2 = 0 THEN ' (' || CAST(event_id % 90 AS VARCHAR) || '.5 img/s)' ELSE '' END AS line FROM events)"""


@_query(
    f"""WITH {_LOG}, parsed AS (SELECT line_no, regexp_extract(line, '^\\[(\\w+)\\]', 1) AS stage, CAST(regexp_extract(line, '\\s(\\d+)/', 1) AS BIGINT) AS done,
    CAST(regexp_extract(line, '/(\\d+)', 1) AS BIGINT) AS total, CAST(nullif(regexp_extract(line, '\\(([\\d.]+) img', 1), '') AS DOUBLE) AS rate FROM log)
    SELECT stage, min(line_no) AS first_line, arg_max(done, line_no) AS done, arg_max(total, line_no) AS total, last(rate ORDER BY line_no) AS rate FROM parsed GROUP BY stage"""
)
def progress_log(spark, sf):
    rate = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ("), (F.col("event_id") % 90).cast("string"), F.lit(".5 img/s)"))).otherwise("")
    line = F.concat(F.lit("["), F.col("event_type"), F.lit("] "), F.col("event_id").cast("string"), F.lit("/"), (F.col("event_id") + F.col("user_id")).cast("string"), rate)
    return report.progress(_read(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("line")))


@_query(
    """SELECT event_id, CAST(event_id // 3600 AS VARCHAR) || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS took,
    repeat('#', CAST(floor((event_id % 100) / 100e0 * 20) AS BIGINT)) || repeat('.', 20 - CAST(floor((event_id % 100) / 100e0 * 20) AS BIGINT)) AS bar FROM events"""
)
def progress_render(spark, sf):
    return _read(spark, sf, "events").select("event_id", S.duration(F.col("event_id")).alias("took"), S.text_bar(F.col("event_id") % 100 / 100).alias("bar"))


_AUDIT_LOG = """log AS (SELECT event_id AS line_no, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS stage, event_id % 10 = 0 AS is_total, event_id % 10 = 1 AS is_other,
    event_id AS done, event_id + user_id AS total, (event_id % 1000) / 10e0 AS percent, event_id // 2 AS usable, event_id % 7 AS anomalies, event_id % 90 + 0.5e0 AS rate FROM events)"""


@_query(
    f"""WITH {_AUDIT_LOG}, told AS (SELECT * FROM log WHERE NOT is_other), last AS (SELECT stage, max(line_no) AS line_no FROM told WHERE NOT is_total GROUP BY stage),
    firsts AS (SELECT stage, min(line_no) AS first_line, arg_max(total, line_no) FILTER (WHERE is_total) AS announced FROM told GROUP BY stage)
    SELECT stage, first_line, announced, done, total, percent, usable, anomalies, rate FROM firsts LEFT JOIN (SELECT l.* FROM told l JOIN last USING (stage, line_no)) USING (stage)"""
)
def audit_log(spark, sf):
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    stage = F.when(e % 3 == 0, "[test] ").otherwise("[train] ")
    total = F.concat(stage, F.lit("D:/data/x1.zip："), text(e + F.col("user_id")), F.lit(" 个文件"))
    state = F.concat(
        stage, text(e), F.lit("/"), text(e + F.col("user_id")), F.lit(" ("), text((e % 1000) / 10), F.lit("%)，可用 "), text(F.expr("event_id div 2")), F.lit("，异常 "), text(e % 7), F.lit("，"), text(e % 90), F.lit(".5 张/秒")
    )
    line = F.when(e % 10 == 0, total).when(e % 10 == 1, F.concat(stage, F.lit("a line of another kind"))).otherwise(state)
    return report.audit_progress(_read(spark, sf, "events").select(e.alias("line_no"), line.alias("line")))


@_query(
    """SELECT event_id, CASE WHEN event_id >= 3600 THEN CAST(event_id // 3600 AS VARCHAR) || ':' ELSE '' END || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS took,
    repeat('█', CAST(round_even((event_id % 101) / 101e0 * 30, 0) AS BIGINT)) || repeat('░', 30 - CAST(round_even((event_id % 101) / 101e0 * 30, 0) AS BIGINT)) AS bar FROM events"""
)
def clock_render(spark, sf):
    return _read(spark, sf, "events").select("event_id", S.clock(F.col("event_id")).alias("took"), S.block_bar(F.col("event_id") % 101 / 101).alias("bar"))


@_query("SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY md5('42:3:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS position FROM documents")
def epoch_shuffle(spark, sf):
    return split.epoch_order(_read(spark, sf, "documents").select(F.col("doc_id").alias("id")), 42, 3).select("id", "position")


@_query(
    f"""WITH {FOLDED}, groups AS (SELECT file_hash, count(*) AS n, count(DISTINCT class_idx) AS k FROM manifest WHERE file_hash IS NOT NULL GROUP BY file_hash),
    kept AS (SELECT id, class_idx, fold, file_hash FROM folded LEFT JOIN groups USING (file_hash) WHERE fold <> 'val' AND NOT coalesce(n > 1 AND k > 1, false))
    SELECT id, class_idx, fold, CASE WHEN file_hash IS NULL THEN 1e0 ELSE round(1e0 / count(*) OVER (PARTITION BY file_hash), 9) END AS weight FROM kept
    UNION ALL SELECT id, class_idx, fold, 1e0 FROM folded WHERE fold = 'val'"""
)
def training_rows(spark, sf):
    rows = _folded(spark, sf)
    columns = ["id", "class_idx", "fold", _round(F.col("weight"), 9).alias("weight")]
    return curation.training_rows(rows).select(columns).unionByName(curation.validation_rows(rows).select(columns))


@_query(
    f"""WITH {_RAW}, {_SAFE}, hashed AS (SELECT norm.*, sha256(html) AS file_hash FROM norm JOIN (SELECT page_id, html FROM pages) USING (page_id)),
    old AS (SELECT norm_path, min(CASE WHEN page_id % 2 = 0 THEN 'other' ELSE file_hash END) AS old_hash FROM hashed WHERE page_id % 13 = 0 AND norm_path IS NOT NULL GROUP BY norm_path),
    ranked AS (SELECT *, norm_path IS NOT NULL AND entry_no > min(entry_no) OVER (PARTITION BY norm_path) AS repeated, CAST(CASE WHEN safe THEN len(parts) ELSE 0 END AS INTEGER) AS depth,
        CASE WHEN norm_path IS NOT NULL AND len(parts) > 0 THEN parts[1] END AS label FROM hashed LEFT JOIN old USING (norm_path)),
    told AS (SELECT *, CASE WHEN norm_path IS NULL THEN 'unsafe_path' WHEN repeated THEN 'duplicate_path' WHEN depth <> 2 THEN 'wrong_depth' WHEN NOT ends_with(lower(norm_path), '.png') THEN 'bad_extension'
        WHEN page_id % 17 = 3 THEN 'encrypted' WHEN page_id % 19 = 0 THEN 'empty' WHEN page_id % 23 = 0 THEN 'length_mismatch' WHEN page_id % 29 = 0 THEN 'undecodable' WHEN old_hash <> file_hash THEN 'write_conflict' END AS error FROM ranked)
    SELECT page_id, file_hash, label, CASE WHEN label IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY label NULLS LAST) - 1 AS INTEGER) END AS class_idx, error,
        CASE WHEN error IS NULL THEN 'accepted' ELSE 'quarantined' END AS outcome, CASE WHEN error IS NULL THEN CASE WHEN old_hash IS NULL THEN 'written' ELSE 'reused' END END AS status FROM told"""
)
def archive_audit(spark, sf):
    p = F.col("page_id")
    entries = _entries(spark, sf).join(_read(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), "page_id")
    entries = entries.withColumns(
        {
            "encrypted": p % 17 == 3,
            "size": F.when(p % 19 == 0, 0).otherwise(100),
            "declared_size": F.when(p % 23 == 0, 99).when(p % 19 == 0, 0).otherwise(100),
            "decodable": p % 29 != 0,
        }
    )
    hashed = F.when(p % 2 == 0, F.lit("other")).otherwise(F.sha2("content", 256))
    there = audit.normalized(entries.where(p % 13 == 0)).where("norm_path IS NOT NULL").groupBy(F.col("norm_path").alias("path")).agg(F.min(hashed).alias("file_hash"))
    return curation.audit_archive(entries, there, 2).select("page_id", "file_hash", "label", "class_idx", "error", "outcome", "status")


@_query(
    """SELECT 'pages' || CAST(page_id % 4 AS VARCHAR) || '.zip' AS archive, CAST(row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1 AS INTEGER) AS entry_no,
    'c' || CAST(page_id % 7 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.png' AS path, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha256(coalesce(html, '')) AS file_hash FROM pages"""
)
def archive_entries(spark, sf):
    """All pages, written to four zip archives by Spark and read again by ranges of the archives."""
    p, folder = F.col("page_id"), scratch_dir(spark)
    path = F.concat(F.lit("c"), (p % 7).cast("string"), F.lit("/"), p.cast("string"), F.lit(".png"))
    files = _read(spark, sf, "pages").select(F.concat(F.lit("pages"), (p % 4).cast("string")).alias("archive"), path.alias("path"), F.encode("html", "utf-8").alias("content"), "page_id")
    materialize(archive.write_archives(files, folder, order="page_id"))
    entries = archive.with_digest(archive.read_archives(spark, folder, 1 << 16))
    return entries.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "entry_no", "path", "size", "file_hash")


@_query(
    """WITH files AS (SELECT lang || '/' || CAST(doc_id % 50 AS VARCHAR) AS path, sha256(coalesce(text, '')) AS file_hash, doc_id FROM documents),
    old AS (SELECT path, min(file_hash) AS h FROM files WHERE doc_id % 2 = 0 GROUP BY path), new AS (SELECT path, min(file_hash) AS h FROM files GROUP BY path),
    each AS (SELECT path, file_hash, count(*) AS n FROM files GROUP BY ALL)
    SELECT path, file_hash, n, CASE WHEN old.h IS NOT NULL THEN CASE WHEN old.h = file_hash THEN 'reused' ELSE 'conflict' END WHEN new.h = file_hash THEN 'written' ELSE 'conflict' END AS status
    FROM each JOIN new USING (path) LEFT JOIN old USING (path)"""
)
def store_files(spark, sf):
    """Two calls of the write-once store: rows with an even id, then all rows. Paths are repeated with like and unlike texts."""
    docs = _read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    path = F.concat("lang", F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    files = docs.select("doc_id", path.alias("path"), F.col("lang").alias("label"), F.sha2("text", 256).alias("file_hash"), F.encode("text", "utf-8").alias("content"))
    folder = scratch_dir(spark)
    store.write_once(files.where("doc_id % 2 = 0").drop("doc_id"), folder)
    return store.write_once(files.drop("doc_id"), folder)


@_query(
    f"""WITH {MANIFEST}, rows AS (SELECT id, class_idx, min(id) OVER (PARTITION BY file_hash) AS root FROM manifest WHERE id % 11 <> 0),
    grouped AS (SELECT id, class_idx, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS group_id FROM (SELECT id, class_idx, min(id) OVER (PARTITION BY root) AS root FROM rows)),
    counts AS (SELECT group_id, class_idx, count(*) AS n FROM grouped GROUP BY ALL),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY class_idx) AS class_n FROM counts),
    main AS (SELECT group_id, arg_max(class_idx, (n, -class_idx)) AS class_idx, sum(n) AS size FROM sized GROUP BY group_id),
    joined AS (SELECT main.*, class_n FROM main JOIN (SELECT DISTINCT class_idx, class_n FROM sized) USING (class_idx)),
    run AS (SELECT *, sum(size) OVER (PARTITION BY class_idx ORDER BY md5('42:' || CAST(group_id AS VARCHAR)), group_id ROWS UNBOUNDED PRECEDING) AS upto FROM joined),
    folded AS (SELECT g.id, g.class_idx, g.group_id, CASE WHEN class_n < 10 THEN 'oof_' || CAST({BUCKET.format(seed=42, key="g.group_id", n=3)} AS VARCHAR)
        WHEN upto <= greatest(1, floor(class_n * 0.1e0)) THEN 'val' ELSE 'train' END AS fold FROM grouped g JOIN run USING (group_id)),
    sizes AS (SELECT class_idx, count(*) AS n FROM folded WHERE fold <> 'val' GROUP BY class_idx),
    placed AS (SELECT class_idx, row_number() OVER (ORDER BY n, class_idx) AS place, count(*) OVER () AS c FROM sizes)
    SELECT id, group_id, fold, CASE WHEN place > c - floor(c * 0.33e0) THEN 'head' WHEN place <= floor(c * 0.33e0) THEN 'tail' ELSE 'middle' END AS part FROM folded LEFT JOIN placed USING (class_idx)"""
)
def audit_to_split(spark, sf):
    """The whole plan from a manifest to parts: decodable rows, groups of equal hashes, folds by quota, head and tail classes."""
    rows = _manifest(spark, sf).select("id", "class_idx", "file_hash", F.lit(None).cast("bigint").alias("h"), (F.col("id") % 11 != 0).alias("decodable"))
    return curation.audit_to_split(rows, rule="quota").select("id", "group_id", "fold", "part")


@_query(
    f"""WITH RECURSIVE {MANIFEST}, lines AS (SELECT sha256(CAST(id AS VARCHAR) || chr(0) || file_hash || chr(10)) AS h, count(*) AS n FROM manifest GROUP BY 1),
    size AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(greatest(0, ceil(round(log2(count(*) / 64e0) / 4, 9))) AS INTEGER) AS depth FROM lines),
    tree(k, prefix, h) AS (SELECT depth, substr(h, 1, depth), sha256(string_agg(h || ':' || CAST(lines.n AS VARCHAR), chr(10) ORDER BY h)) FROM lines, size GROUP BY depth, substr(h, 1, depth)
        UNION ALL (SELECT k - 1, substr(prefix, 1, k - 1), sha256(string_agg(prefix || ':' || h, chr(10) ORDER BY prefix)) FROM tree WHERE k > 0 GROUP BY k, substr(prefix, 1, k - 1)))
    SELECT n, h AS fingerprint FROM tree, size WHERE k = 0"""
)
def fingerprint_tree(spark, sf):
    return audit.fingerprint_tree(_manifest(spark, sf), F.col("id").cast("string"), F.col("file_hash"), 64)


_DRAW = "CAST('0x' || substr(md5('42:0:' || CAST(batch AS VARCHAR) || ':{side}:' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0"
_MIXED = f"""placed AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, (row_number() OVER (ORDER BY md5('42:0:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) AS position FROM embeddings),
dealt AS (SELECT *, position // 128 AS batch, row_number() OVER (PARTITION BY position // 128 ORDER BY position) AS own,
    row_number() OVER (PARTITION BY position // 128 ORDER BY md5('42:0:partner:' || CAST(id AS VARCHAR)), id) AS other FROM placed),
draws AS (SELECT batch, j, pow({_DRAW.format(side="u")}, 1 / 0.4e0) AS x, pow({_DRAW.format(side="v")}, 1 / 0.4e0) AS w FROM (SELECT DISTINCT batch FROM dealt), range(32) t(j)),
lams AS (SELECT b.batch, coalesce(arg_min(x / (x + w), j), 0.5e0) AS lam FROM (SELECT DISTINCT batch FROM dealt) b LEFT JOIN draws d ON d.batch = b.batch AND x + w <= 1 AND x + w > 0 GROUP BY b.batch),
mixed AS (SELECT a.id, a.y, CAST(a.batch AS BIGINT) AS batch, b.id AS partner, b.y AS py, greatest(lam, 1 - lam) AS lam FROM dealt a JOIN dealt b ON a.batch = b.batch AND a.own = b.other JOIN lams ON lams.batch = a.batch)"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    df = _features(spark, sf).select("id", "y")
    return mixup.mixed_batches(df, 0.4, 128).join(df.select(F.col("id").alias("partner"), F.col("y").alias("py")), "partner")


@_query(f"WITH {_MIXED} SELECT id, y, batch, partner, py, round(lam, 6) AS lam FROM mixed")
def mixup_batches(spark, sf):
    return _mixed(spark, sf).select("id", "y", "batch", "partner", "py", _round(F.col("lam")).alias("lam"))


@_query(
    f"""WITH {FEATURES}, {_PROTO}, {_MIXED}, mx AS (SELECT *, max(logit) OVER (PARTITION BY id) AS m FROM cosines),
    lp AS (SELECT id, y, logit - m - ln(sum(exp(logit - m)) OVER (PARTITION BY id)) AS logp FROM mx)
    SELECT mixed.id, round(-(lam * a.logp + (1 - lam) * b.logp), 6) AS loss FROM mixed JOIN lp a ON a.id = mixed.id AND a.y = mixed.y JOIN lp b ON b.id = mixed.id AND b.y = mixed.py"""
)
def mixup_loss(spark, sf):
    """Cross-entropy of each row against the mixed labels of its own and its partner's class."""
    logits = _logits(spark, sf).select("id", "classes", "logits")
    met = _mixed(spark, sf).join(logits, "id")
    target = F.transform("classes", lambda c: F.when(c == F.col("y"), F.col("lam")).otherwise(0.0) + F.when(c == F.col("py"), 1 - F.col("lam")).otherwise(0.0))
    return met.select("id", _round(L.soft_cross_entropy(F.col("logits"), target)).alias("loss"))


@_query(
    """SELECT page_id, kind, w AS width, h AS height, CASE WHEN h > 0 THEN round(CAST(w AS DOUBLE) / h, 6) END AS aspect_ratio,
    CASE kind WHEN 'png' THEN 'RGBA' WHEN 'gif' THEN 'P' ELSE 'RGB' END AS mode FROM (
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' ELSE 'jpeg' END AS kind, length(html) % 60000 AS w, page_id % 3001 AS h FROM pages)"""
)
def image_headers(spark, sf):
    """Files with headers made of the pages, a JPEG with the page's url in a segment before its frame, read back."""
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c, n: F.concat(*(F.substring(hexed(c, n), i, 2) for i in range(n - 1, 0, -2)))
    w, h, url = (F.length("html") % 60000).cast("bigint"), F.col("page_id") % 3001, F.hex(F.encode(F.col("url"), "utf-8"))
    note = F.concat(F.lit("FFE1"), hexed(F.octet_length("url") + 2, 4), url)
    content = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8), F.lit("0806000000000000000000000049454E44AE426082")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("474946383961"), little(w, 4), little(h, 4), F.lit("0000003B")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("424D1E0000000000000000000000" + "28000000"), little(w, 8), little(h, 8), F.lit("01001800")))
        .otherwise(F.concat(F.lit("FFD8FFE000100000000000000000000000000000"), note, F.lit("FFC0001108"), hexed(h, 4), hexed(w, 4), F.lit("03FFD9")))
    )
    files = _read(spark, sf, "pages").select("page_id", F.unhex(content).alias("content"))
    return files.select("page_id", S.image_header(F.col("content")).alias("head")).select("page_id", "head.*")


@_query(
    """WITH l AS (SELECT o_orderkey AS id, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CAST(coalesce(sum(l.n), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS right_rows, count(*) FILTER (WHERE l.n > 0 AND r.n > 0) AS matched,
    count(*) FILTER (WHERE r.n IS NULL) AS left_only, count(*) FILTER (WHERE l.n IS NULL) AS right_only, count(*) FILTER (WHERE l.n > 1 OR r.n > 1) AS repeated
    FROM l FULL JOIN r ON l.id IS NOT DISTINCT FROM r.id"""
)
def row_meeting(spark, sf):
    orders = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return curation.meeting(orders, _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))
