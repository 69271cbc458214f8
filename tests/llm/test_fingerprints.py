"""Merkle fingerprints against a plain version, SQL over all rows, and planted edits."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from lodeflow.llm import fingerprints as M


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def parts(text, pattern):
    return [m for m in (x.group() for x in re.finditer(pattern.replace(r"\z", r"\Z"), text)) if m]


def plain(text):
    """root, written fingerprint and distinct leaves of a text."""
    told, sections, leaves = [], [], set()
    for s in parts(text or "", M.SECTION):
        nodes, own = [], []
        for p in parts(s, M.PARAGRAPH):
            found = [sha(x)[:16] for x in parts(p, M.PIECE)]
            nodes.append(sha("".join(found))[:16])
            own.append(nodes[-1] + ":" + "".join(x[:8] for x in found))
            leaves |= {x[:8] for x in found}
        sections.append(sha("".join(nodes))[:16])
        told.append(f"{sections[-1]}({','.join(own)})")
    root = sha("".join(sections))
    return root, root + "/" + "".join(told), leaves


def near(a, b):
    if a[0] == b[0]:
        return 1.0
    return round(2 * len(a[2] & b[2]) / (len(a[2]) + len(b[2])), 9) if a[2] or b[2] else 0.0


def expected(rows):
    """By the contract: rows of (doc_id, text) in descending order."""
    rows = sorted(rows, key=lambda r: -r[0])
    found = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, e, n = plain(t), plain(edited), plain(after)
        found.append((i, len(t), sha(edited), a[1], e[1], near(a, e), near(a, n)))
    return sorted(found)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
HOSTILE = [
    (1, None), (2, ""), (3, "\n \n\n"), (4, "One.\n\nTwo lines\nhere! And more?\n\n \nLast"), (5, "x" * 5000), (6, "né ü 漢字。 \U0001f600 end. " * 40), (7, "same text. " * 900), (8, "same text. " * 900),
    (9, "...!!!???"), (11, "A title\n\nBody (with: marks, and / more). \n" * 3),
]


def test_query_is_the_contract(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = sorted(map(tuple, M.op12_document_fingerprints(spark, sf).select(*COLUMNS).collect()))
    assert found == expected(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(M.OP12_SQL).fetchall()) == found


def test_hostile_texts(spark):
    docs = spark.createDataFrame(HOSTILE, "doc_id long, text string").withColumns({"need": F.lit(1), "h": F.lit("x"), "place": F.lit(2)})
    found = sorted(map(tuple, M.edited_fingerprints(docs).select(*COLUMNS).collect()))
    assert found == expected(HOSTILE)
    assert {r.fingerprint for r in M.fingerprints(docs.where("doc_id in (7, 8)")).collect()} == {plain(HOSTILE[6][1])[1]}
    assert M.edited_fingerprints(docs.where("false")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "nameless. text"), (5, "five. is here and long enough."), (5, "five. is here and long enough."), (5, "another five. text of it."), (9, "nine")]
    found = M.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5
    twins = [r for r in found if r.fingerprint == plain(rows[1][1])[1]]
    assert len(twins) == 2 and twins[0] == twins[1]
    nameless = next(r for r in found if r.doc_id is None)
    assert nameless.edited_sha256 == sha("nameless. " + "nine")


def test_edits_are_located(spark):
    a = "Intro line one.\nIntro line two.\n\nBody first.\nBody second.\nBody third.\n\nEnd."
    b = a.replace("Body second.", "Body changed here.")
    df = spark.createDataFrame([(a, b)], "a string, b string").select(M.edits(M.merkle_tree(F.col("a")), M.merkle_tree(F.col("b"))).alias("e"), M.edits(M.merkle_tree(F.col("a")), M.merkle_tree(F.col("a"))).alias("none"))
    row = df.first()
    told = [(e.side, (a if e.side == "-" else b)[e.start : e.start + e.chars]) for e in row.e]
    assert told == [("-", "Body second.\n"), ("+", "Body changed here.\n")] and row.none == []


def test_no_python_in_the_plan(spark, sf):
    plan = M.op12_document_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edited_text_is_nearer_than_the_next(spark, sf):
    rows = M.op12_document_fingerprints(spark, sf).where("n_chars > 400").collect()
    assert sum(r.near_edited > 0.5 for r in rows) > 0.9 * len(rows)
    assert sum(r.near_edited > r.near_next or r.near_next == 1 for r in rows) == len(rows)
