"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, made of built-in functions alone.

A section ends with a blank line, a paragraph with its line, a piece with its sentence or, where no sentence ends for
48 characters, with the word there. White space belongs to what it follows, so the pieces are the whole text. A piece's
hash is the first 64 bits of its SHA-256; every other node is the SHA-256 of its children's hashes, cut to 64 bits but
for the root, which keeps all. Equal roots mean equal texts; below unequal ones only the branches that differ are open.

A fingerprint is written as root, then sections: `root/section(paragraph:pieces,paragraph:pieces)section(...)`, nodes
with 16 hexadecimal digits and the pieces of a paragraph with 8 each, without anything between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.vectors import let
from lodeflow.operators.ranks import numbered
from lodeflow.session import materialize

#: Characters of a piece after which it ends at the next word's end, and characters of one word that it takes then.
PIECE_CHARS = 48
_BLANK = r"[ \t\x0B\f\r]"
SECTION = rf"(?s).+?(?:\n{_BLANK}*\n[ \t\x0B\f\r\n]*|\z)"
PARAGRAPH = r"[^\n]+\n*|\n+"
PIECE = rf"[^.!?\n]{{0,{PIECE_CHARS}}}[^.!?\x20\t\x0B\f\r\n]{{0,{PIECE_CHARS}}}[.!?]*[ \t\x0B\f\r\n]*"
_NODE, _LEAF = 16, 8  # hexadecimal digits


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: p != "")


def _node(children: Column, digits: int = _NODE) -> Column:
    return F.substring(F.sha2(F.array_join(children, ""), 256), 1, digits)


def merkle_tree(text: Column) -> Column:
    """root, and sections of node and paragraphs of node, chars (code points) and leaves, the pieces' hashes.

    A null text counts as an empty one, which has no section; its root is that of no children.
    """

    def paragraph(p: Column) -> Column:
        leaves = F.transform(_parts(p, PIECE), lambda x: F.substring(F.sha2(x, 256), 1, _NODE))
        return let(leaves, lambda found: F.struct(_node(found).alias("node"), F.length(p).alias("chars"), F.transform(found, lambda x: F.substring(x, 1, _LEAF)).alias("leaves")))

    def section(s: Column) -> Column:
        return let(F.transform(_parts(s, PARAGRAPH), paragraph), lambda found: F.struct(_node(F.transform(found, lambda p: p["node"])).alias("node"), found.alias("paragraphs")))

    whole = F.coalesce(text, F.lit(""))
    sections = F.transform(F.when(whole.rlike(rf"\n{_BLANK}*\n"), _parts(whole, SECTION)).when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole)), section)
    return let(sections, lambda found: F.struct(_node(F.transform(found, lambda s: s["node"]), 64).alias("root"), found.alias("sections")))


def written(tree: Column) -> Column:
    """A tree as text, see the module."""
    paragraphs = lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(p["node"], F.lit(":"), F.array_join(p["leaves"], ""))), ",")
    sections = lambda t: F.array_join(F.transform(t["sections"], lambda s: F.concat(s["node"], F.lit("("), paragraphs(s), F.lit(")"))), "")
    return let(tree, lambda t: F.concat(t["root"], F.lit("/"), sections(t)))


def read_back(fingerprint: Column) -> Column:
    """root and leaves, the distinct hashes of pieces, of a written fingerprint."""
    told = F.regexp_extract_all(fingerprint, F.lit(r":([0-9a-f]+)"), F.lit(1))
    leaves = F.array_distinct(F.flatten(F.transform(told, lambda run: F.regexp_extract_all(run, F.lit(rf"[0-9a-f]{{{_LEAF}}}"), F.lit(0)))))
    return F.struct(F.substring_index(fingerprint, "/", 1).alias("root"), leaves.alias("leaves"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints that are read back are: 1 for equal roots, else twice the distinct pieces of both over those of each, 0 .. 1."""

    def met(x: Column, y: Column) -> Column:
        total = F.size(x["leaves"]) + F.size(y["leaves"])
        return F.when(x["root"] == y["root"], 1.0).when(total == 0, 0.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(x["leaves"], y["leaves"])) / total)

    return let(a, lambda x: let(b, lambda y: met(x, y)))


def edits(a: Column, b: Column) -> Column:
    """Where tree b differs from tree a: side (`-` a, `+` b), start (code points into that side's text), chars and node of
    each paragraph of one that the other does not hold, in order. Sections that both hold are not opened; equal roots give none.
    """

    def alone(tree: Column, other: Column, side: str) -> Column:
        chars = lambda s: F.aggregate(s["paragraphs"], F.lit(0), lambda n, p: n + p["chars"])
        flat = F.flatten(
            F.transform(
                tree["sections"],
                lambda s: F.when(
                    F.exists(other["sections"], lambda o: o["node"] == s["node"]),
                    F.array(F.struct(F.lit("").alias("node"), chars(s).alias("chars"))),
                ).otherwise(F.transform(s["paragraphs"], lambda p: F.struct(p["node"].alias("node"), p["chars"].alias("chars")))),
            )
        )
        there = F.transform(F.flatten(F.transform(other["sections"], lambda s: s["paragraphs"])), lambda p: p["node"])
        start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<side: string, start: int, chars: int, node: string>>").alias("told"))
        step = lambda s, p, known: F.struct(
            (s["at"] + p["chars"]).alias("at"),
            F.when((p["node"] == "") | F.array_contains(known, p["node"]), s["told"])
            .otherwise(F.concat(F.coalesce(s["told"], F.array().cast("array<struct<side: string, start: int, chars: int, node: string>>")), F.array(F.struct(F.lit(side).alias("side"), s["at"].alias("start"), p["chars"].alias("chars"), p["node"].alias("node")))))
            .alias("told"),
        )
        return let(there, lambda known: F.coalesce(F.aggregate(flat, start, lambda s, p: step(s, p, known))["told"], F.array().cast("array<struct<side: string, start: int, chars: int, node: string>>")))

    return F.when(a["root"] == b["root"], F.array().cast("array<struct<side: string, start: int, chars: int, node: string>>")).otherwise(F.concat(alone(a, b, "-"), alone(b, a, "+")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of docs (doc_id, text).

    A null or empty text has no sections and one fingerprint; repeated rows and null ids are answered row by row, equal
    texts alike; a very long text is one row's work, its paragraphs' pieces are hashed one after the other. An empty table
    gives an empty one. Columns other than doc_id and text are not looked at, whatever their names.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), written(merkle_tree(text)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text) and of its edited text, and how alike it is to that and to the next document.

    Documents stand in descending order of doc_id, null ids last; rows alike in doc_id and text are one document there and
    share its answer, unlike texts under one id go by their hash. The edited text has its last n_chars div 3 code points
    replaced by the first as many (or all) of the next document; the last one's next is the first.

    The order is made of ids and lengths only, in ranges. Then whole texts move once, to meet what the next document
    sends: the characters that are needed of it, and its fingerprint. No task holds more than a share of the rows,
    whatever ids and lengths are. An empty table gives an empty one; other columns are not looked at.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)).alias("doc_id"), docs["doc_id"].isNull().alias("nameless"), F.xxhash64(text).alias("h"), text.alias("text"))
    key, to = ["doc_id", "nameless", "h"], ["to_id", "to_nameless", "to_h"]
    known = materialize(rows.select(*key, F.length("text").cast("bigint").alias("n_chars")).distinct())
    placed = materialize(numbered(known, F.col("nameless"), F.desc("doc_id"), F.col("h")))
    n = placed.agg(F.count("*").alias("n"))  # one row
    after = placed.join(F.broadcast(n)).select(F.pmod(F.col("place") - 1, "n").alias("place"), *key)
    before = placed.select("place", *(F.col(a).alias(b) for a, b in zip(key, to, strict=True)), F.expr("n_chars div 3").cast("int").alias("need"))
    sends = materialize(after.join(before, "place").drop("place"))
    # both joins need the same rows by the same keys, so texts are sent once and read twice
    sent = rows.join(sends, key).select(*to, F.left("text", "need").alias("first"), written(merkle_tree(F.col("text"))).alias("next_fingerprint"))
    sent = sent.dropDuplicates(to).select(*(F.col(b).alias(a) for a, b in zip(key, to, strict=True)), "first", "next_fingerprint")
    met = rows.join(sent, key).withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id")))
    n_chars = F.length("text")
    cut = met.select("doc_id", n_chars.cast("bigint").alias("n_chars"), "text", F.concat(F.left("text", n_chars - F.expr("length(text) div 3").cast("int")), "first").alias("edited"), "next_fingerprint")
    told = cut.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(merkle_tree(F.col("text"))).alias("fingerprint"), written(merkle_tree(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint")
    near = let(read_back(F.col("fingerprint")), lambda own: F.struct(*(likeness(own, read_back(F.col(c))).alias(name) for c, name in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next")))))
    return told.withColumn("near", near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round("near.near_edited", 9).alias("near_edited"), F.round("near.near_next", 9).alias("near_next"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tree_sql(text: str, name: str) -> str:
    """fingerprint and leaves of each text; sections in DuckDB's own pattern language."""
    piece = rf"[^.!?\n]{{0,{PIECE_CHARS}}}[^.!?\x20\t\x0B\f\r\n]{{0,{PIECE_CHARS}}}[.!?]*[ \t\x0B\f\r\n]*"
    section = r"(?s).+?(?:\n[ \t\x0B\f\r]*\n[ \t\x0B\f\r\n]*|\z)"
    parts = lambda x, p: f"list_filter(regexp_extract_all({x}, '{p}'), lambda q: q <> '')"
    cut = lambda x, d: f"substr(sha256({x}), 1, {d})"
    join = lambda x: f"coalesce(list_aggregate({x}, 'string_agg', ''), '')"
    return f"""{name}_s AS (SELECT doc_id, generate_subscripts({parts(text, section)}, 1) AS s, unnest({parts(text, section)}) AS section FROM cut),
{name}_p AS (SELECT doc_id, s, generate_subscripts({parts('section', PARAGRAPH)}, 1) AS p, unnest({parts('section', PARAGRAPH)}) AS paragraph FROM {name}_s),
{name}_l AS (SELECT doc_id, s, p, list_transform({parts('paragraph', piece)}, lambda x: {cut('x', _NODE)}) AS leaves FROM {name}_p),
{name}_n AS (SELECT *, {cut(join('leaves'), _NODE)} AS node FROM {name}_l),
{name}_g AS (SELECT doc_id, s, {cut("string_agg(node, '' ORDER BY p)", _NODE)} AS node, string_agg(node || ':' || {join(f'list_transform(leaves, lambda x: substr(x, 1, {_LEAF}))')}, ',' ORDER BY p) AS told,
    flatten(list(list_transform(leaves, lambda x: substr(x, 1, {_LEAF})) ORDER BY p)) AS leaves FROM {name}_n GROUP BY ALL),
{name}_r AS (SELECT doc_id, sha256(string_agg(node, '' ORDER BY s)) AS root, string_agg(node || '(' || told || ')', '' ORDER BY s) AS told, list_distinct(flatten(list(leaves))) AS leaves FROM {name}_g GROUP BY doc_id),
{name} AS (SELECT cut.doc_id, coalesce(root, sha256('')) AS root, coalesce(root, sha256('')) || '/' || coalesce(told, '') AS fingerprint, coalesce(leaves, []) AS leaves FROM cut LEFT JOIN {name}_r USING (doc_id))"""


def _near_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a}.root = {b}.root THEN 1e0 WHEN len({a}.leaves) + len({b}.leaves) = 0 THEN 0e0 ELSE round(2e0 * len(list_intersect({a}.leaves, {b}.leaves)) / (len({a}.leaves) + len({b}.leaves)), 9) END"


OP12_SQL = f"""WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
chained AS (SELECT doc_id, text, lead(doc_id) OVER (ORDER BY doc_id DESC) AS after, first_value(doc_id) OVER (ORDER BY doc_id DESC) AS front FROM whole),
cut AS (SELECT a.doc_id, a.text, b.doc_id AS next_id, left(a.text, length(a.text) - length(a.text) // 3) || left(b.text, length(a.text) // 3) AS edited
    FROM chained a JOIN whole b ON b.doc_id = coalesce(a.after, a.front)),
{_tree_sql('text', 't')},
{_tree_sql('edited', 'e')}
SELECT cut.doc_id, length(cut.text) AS n_chars, sha256(cut.edited) AS edited_sha256, t.fingerprint, e.fingerprint AS edited_fingerprint, {_near_sql('t', 'e')} AS near_edited, {_near_sql('t', 'n')} AS near_next
FROM cut JOIN t USING (doc_id) JOIN e USING (doc_id) JOIN t n ON n.doc_id = cut.next_id"""
