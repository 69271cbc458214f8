"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is a set of rows, one for each turn, with a list of typed parts: text, image, audio, document. A
visitor flattens a turn's parts in order: text is escaped and written out, every other part leaves a placeholder
and an attachment record with its reference and the number of tokens that the placeholder expands to.

The template writes `<s>[TURN]role[BODY]...</s>` for each turn. Control strings inside roles and texts are split
by a backslash after their first character, and backslashes are doubled, so no escaped text holds one: splitting
at control strings finds the template's own ones only, and dropping each escaping backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END, TURN, BODY = "<s>", "</s>", "[TURN]", "[BODY]"
#: Placeholders by part type.
MARKS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Expansion: an image is cut into square patches of so many pixels; audio and documents have rates.
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
_CONTROL = r"<(?=/?s>)|\[(?=(?:/?INST|TURN|BODY|IMAGE|AUDIO|DOCUMENT)\])"

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part; a null text is an empty one."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("int").alias("pages"),
    )
    return F.array(part)


def _mark(part: Column) -> Column:
    found = F.lit("")
    for kind, mark in MARKS.items():
        found = F.when(part["type"] == kind, F.lit(mark)).otherwise(found)
    return found


def _tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; unknown sizes count as one patch, second or page."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(1)) / F.lit(PATCH))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """A row for each conversation: formatted, loss_spans, attachments, expanded_tokens.

    turns: conv_id, turn, role, parts (PARTS); other columns are not read. Turns stand in the order of turn
    (nulls first), ties by role and written text, so repeated rows stay and stand together. A null role is an
    empty one; null parts and parts of an unknown type leave nothing. Rows with a null conv_id are one
    conversation. loss_spans are starts and ends, in code points and in UTF-8 bytes of formatted, of the
    assistant's written bodies. A conversation is one row in the end, however many or long its turns are; the work
    on it follows its length. Attachments are numbered from 0 by turn and place; nothing is dropped. No rows give no rows.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    written = F.concat_ws("", F.transform(parts, lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(_mark(p))))
    seen = F.transform(
        F.filter(parts, lambda p: p["type"].isin(list(MARKS))), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
    )
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(BEGIN + TURN), escape(role), F.lit(BODY))
    said = turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), written.alias("body"), seen.alias("seen"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "head", "seen").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda size: F.coalesce(F.sum(size(F.col("head")) + size(F.col("body")) + len(END)).over(before), F.lit(0))
    placed = said.withColumns({"at": total(F.length), "byte": total(F.octet_length)})
    item = F.struct("at", "byte", "role", "body", "head", "seen")
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))

    def span(t: Column) -> Column:
        start, byte = t["at"] + F.length(t["head"]), t["byte"] + F.octet_length(t["head"])
        ends = (start, start + F.length(t["body"]), byte, byte + F.octet_length(t["body"]))
        return F.struct(*(x.cast("bigint").alias(name) for name, x in zip(("start", "stop", "byte_start", "byte_stop"), ends, strict=True)))

    seen_all = F.flatten(F.transform("t", lambda t, i: F.transform(t["seen"], lambda a: F.struct(i.alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return held.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"), span).alias("loss_spans"),
        seen_all.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text); placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"\Q" + BODY + r"\E")
        return F.struct(unescape(F.substr(halves[0], F.lit(len(BEGIN + TURN) + 1))).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; cut out by bytes, which need no walk from the start."""

    def cut(data: Column) -> Column:
        part = lambda s: F.substr(data, (s["byte_start"] + 1).cast("int"), (s["byte_stop"] - s["byte_start"]).cast("int"))
        return F.array_join(F.transform(spans, lambda s: unescape(F.decode(part(s), "UTF-8"))), "")

    return F.transform(F.array(F.encode(formatted, "UTF-8")), cut)[0]  # encoded once


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what formatted conversations say, read back from the formatted text."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        chats.withColumn("turns", turns)
        .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
            F.size("attachments").cast("bigint").alias("n_attachments"),
            "expanded_tokens",
        )
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    return digests(format_chat(turns))


#: Without formatted_chars, expanded_tokens and n_attachments, what the conversations themselves say.
OP1_SQL = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
    SELECT conv_id, turn, role, text,
           19 + length(role) + length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
               '</?s>|\\[(/?INST|TURN|BODY|IMAGE|AUDIO|DOCUMENT)\\]', '\\0.', 'g')) AS chars
    FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM written GROUP BY conv_id
"""
