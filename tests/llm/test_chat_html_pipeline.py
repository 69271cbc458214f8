"""Chat formatting, page texts and the pipeline."""

import hashlib
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeflow.llm import chat_format as C
from lodeflow.llm import html_text, quality_classifier, quality_rules
from lodeflow.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return C.format_chat(df.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\", "\\</s>", "<\\/s>", "[TURN]x[BODY]", "<", "</s", "[BODY", "]", "", "é\U0001f600 \n", "[IMAGE]\\[AUDIO]", "$1 \\$0", "<s><s></s></s>"]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in (C.BEGIN, C.END, C.TURN, C.BODY, *C.MARKS.values(), "[INST]", "[/INST]"))


def test_read_back(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant", "[BODY]\\"] * 5, NASTY, strict=True))]
    rows += [(2, None, None, None), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, "assistant", "x")]
    chats = formatted(spark, rows)
    found = {r.conv_id: r for r in chats.select("conv_id", C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [(r[2], r[3]) for r in rows[:15]]
    assert found[1].loss == "".join(r[3] for r in rows[:15] if r[2] == "assistant")
    assert [(t.role, t.text) for t in found[2].turns] == [("", ""), ("assistant", "a"), ("assistant", "a")] and found[None].loss == "x"
    digest = {r.conv_id: r for r in C.digests(chats).collect()}
    assert digest[2].turns_sha256 == hashlib.sha256(b"\n\nassistant\na\nassistant\na\n").hexdigest() and digest[2].n_turns == 3
    assert formatted(spark, []).count() == 0


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("text", " [IMAGE]", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("text", "read", None, None, None, None, None), ("odd", "lost", None, None, None, None, None)]),
        (1, 2, "assistant", None),
    ]
    r = C.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert r.formatted == "<s>[TURN]user[BODY]see [IMAGE] [\\IMAGE][AUDIO]</s><s>[TURN]assistant[BODY][DOCUMENT]read</s><s>[TURN]assistant[BODY]</s>"
    assert [(a.turn_no, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536)]
    assert r.expanded_tokens == 1578 and [r.formatted[x.start : x.stop] for x in r.loss_spans] == ["[DOCUMENT]read", ""]


def test_long_conversation(spark):
    """The work on a conversation follows its length: 20,000 turns of 400 characters."""
    turns = spark.range(20_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("é</s> x"), 50), F.col("id").cast("string")).alias("text")
    )
    start = time.perf_counter()
    r = C.digests(C.format_chat(turns.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))).first()
    assert time.perf_counter() - start < 20
    said = "".join("é</s> x" * 50 + str(i) for i in range(1, 20_000, 2))
    assert r.n_turns == 20_000 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_plan_is_native(spark, sf):
    plan = QUERIES["op1_chat_formatting"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf):
    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    theirs = con.execute(ORACLE_SQL[name]).df()
    ours = QUERIES[name](spark, sf).toPandas()[list(theirs.columns)]
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))


PAGES = {
    "<html><head><title>No</title></head><body><nav><a>Menu</a></nav><article><h1>T &amp; t</h1><p>One\n <b>bold</b>, two.<br>Three<p>Four.</article><footer>No</footer></body></html>": "T & t\nOne bold, two. Three\nFour.",
    "<body><header>Site</header><div id='sidebar'>x</div><main><header><h1>Head</h1></header><p>Body, here.</p><form>no</form><section class='comments'><p>Nice, really, a very long comment, with many, many words.</p></section><ul><li>a<li>b</ul></main><div class=ad>Buy!</div></body>": "Head\nBody, here.\na\nb",
    "<div><div class=menu><a>x</a></div><div><p>Long text here, with words. And more.</p><p>Two, three.</p></div><div>foot</div></div>": "Long text here, with words. And more.\nTwo, three.",
    "<article><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;b&gt; &#233;</p></article>": "yes <b> é",
    "plain < text": "plain < text",
    "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\nb\nc",
    "<nav>only menu</nav>": "",
    "": "",
    None: "",
    "<article><p title='>'>quoted</p><p a=\"unclosed>x</p></article>": None,
}


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", p, 3) for i, p in enumerate(PAGES)], "page_id long, url string, html string, n_chars int")
    found = {r.page_id: r for r in html_text.extract(df).collect()}
    for i, (page, want) in enumerate(PAGES.items()):
        assert want is None or found[i].text == want, page
        assert found[i].n_chars == len(found[i].text)
    assert html_text.extract(df.limit(0)).count() == 0


LONG = "A sentence of the text, with commas, and more words. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><h1>Title</h1><div class=intro>{LONG * 2}</div><div class=body>{LONG * 12}</div></div><div>foot</div></body>", ["Title", LONG * 2, LONG * 12]),
        (f"<body><h1>Title</h1><div class=body><p>{LONG * 4}</p><h2>Part</h2><p>{LONG * 5}</p></div><div>foot</div></body>", ["Title", LONG * 4, "Part", LONG * 5]),
        (f"<div><article><p>{LONG * 3}</p></article><h2>Between</h2><article><p>{LONG * 9}</p><ul><li>a</ul></article></div><div>foot</div>", [LONG * 3, "Between", LONG * 9, "a"]),
        (f"<article><p>Teaser, a short one.</p></article><div class=body><p>{LONG * 9}</p><p>{LONG}</p></div>", [LONG * 9, LONG]),
    ],
)
def test_whole_text_of_a_page(page, want):
    assert html_text.main_text(page) == "\n".join(x.strip() for x in want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='page has-sidebar'><article><p>{LONG}</p></article></div>", [LONG]),
        (f"<div class='no-ads'><div class=content-with-comments><p>{LONG}</p></div></div>", [LONG]),
        (f"<div class=related><main><p>{LONG}</p></main></div>", [LONG]),
        (f"<form id=aspnetForm><div class=menu>x</div><h1>T</h1><p>{LONG * 3}</p></form>", ["T", LONG * 3]),
        (f"<article><h1>T</h1><div class=widget><p>{LONG * 3}</p></div><div class=related-posts>More</div></article>", ["T", LONG * 3]),
        (f"<article><p>{LONG}</p><h2 id='related-work'>R</h2><section id='notice-periods'>n</section><p class='comment'>c</p><div data-id='share-3'>d</div><div title='a class=ad'>e</div></article>", [LONG, "R", "n", "c", "d", "e"]),
        (f"<article><p>{LONG}</p><div id='share-3'>no</div><div class='ad-slot'>no</div></article><div class=sidebar><p>{LONG * 20}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p></article><aside><article>Teaser</article></aside>", [LONG]),
        (f"<div class=comments><p>{LONG}</p></div>", [LONG]),
    ],
)
def test_names_do_not_outweigh_scores(page, want):
    assert html_text.main_text(page) == "\n".join(x.strip() for x in want)


STORY = f"<h1>T</h1><p>{LONG * 4}</p><p>{LONG * 3}</p>"
TOLD = ["T", LONG * 4, LONG * 3]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{STORY}<p class=advert>Buy a lamp now!</p><p class='share'>Share this</p></article>", TOLD),
        (f"<p class='cookie-notice'>{LONG}</p><article>{STORY}</article>", TOLD),
        (f"<article>{STORY}<p class=notice>{LONG * 3}</p></article>", [*TOLD, LONG * 3]),
        (f"<div id=header><p>{LONG}</p></div><div class=story>{STORY}</div>", TOLD),
        (f"<div class=masthead>{LONG}</div><div>{STORY}</div>", TOLD),
        (f"<div id='gdpr-consent'><p>{LONG * 2}</p></div><div>{STORY}</div>", TOLD),
        (f"<article>{STORY}<div class=header>Part</div></article>", [*TOLD, "Part"]),
        (f"<article>{STORY}<ol class=commentlist><li>{LONG}</ol></article>", TOLD),
        (f"<article>{STORY}<div hidden><p>{LONG}</p></div><p style='color:red; display: none'>no</p><div aria-hidden=false title=' hidden '>yes</div></article>", [*TOLD, "yes"]),
        (f"<body style='display:none'><div hidden><p>{LONG}</p></div></body>", [LONG]),
        (f"<div><p>{LONG}</p></div><form class=newsletter><p>{LONG * 3}</p><input></form>", [LONG]),
        (f"<form id=all><div class=menu>x</div><p>{LONG * 3}</p></form><div>foot</div>", [LONG * 3]),
        (f"<article>{STORY}<div class='more-stories'><p>{LONG}</p></div></article>", TOLD),
        (f"<main><article>{STORY}</article><article><h3>Other</h3></article><article class=teaser><p>{LONG}</p></article></main>", TOLD),
        (f"<main><article>{STORY}</article><article><p>{LONG * 5}</p></article></main>", [*TOLD, LONG * 5]),
        (f"<article>{STORY}<article class=comment><p>{LONG}</p></article></article>", TOLD),
        (f"<article>{STORY}</article><aside hidden><p>{LONG * 30}</p></aside>", TOLD),
    ],
)
def test_what_is_not_the_article(page, want):
    assert html_text.main_text(page) == "\n".join(x.strip() for x in want)


@pytest.mark.parametrize("page", ["<script>x" * 20_000, "<b>x" * 40_000, "<div>x, y." * 40_000, '<p a="' * 30_000, "<" * 200_000, "<!--" * 50_000, "<ul><li><p>One, two." * 20_000])
def test_time_follows_length(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 10


def test_ratios_by_hand():
    """Each block's ratios, smoothing and fusion, counted from their definition."""
    paths, texts = [1, 2, 2, 3, 2], ["Menu", "One, two. Three!", "Four", "x" * 7, "Five; six."]
    ratio = []
    for p in paths:
        own = [t for q, t in zip(paths, texts, strict=True) if q == p]
        marks = sum(c in ",.;:!?…。，、！？" for t in own for c in t)
        ratio.append(sum(map(len, own)) / len(own) * (1 + marks / len(own)))
    for i, got in enumerate(html_text.fused_scores(paths, texts)):
        near = [(3 - abs(k - i), ratio[k]) for k in range(5) if abs(k - i) <= 2]
        assert abs(got**2 - ratio[i] * sum(w * r for w, r in near) / sum(w for w, _ in near)) < 1e-9 * got**2


def test_real_pages(spark, sf):
    """The tables' pages hold their text in one article element."""
    import html
    import re

    found = {r.page_id: r.text for r in QUERIES["op9_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = corpus_pipeline.materialize(corpus_pipeline.apply_rules(spark, docs, sf))
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules.columns == docs.columns
    assert {r.doc_id for r in rules.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs, model).where("kept").collect()}
    good = corpus_pipeline.materialize(corpus_pipeline.apply_classifier(spark, rules, sf))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_classifier.quality_classifier(rules, quality_classifier.fit(rules)).where("kept").collect()}
    extra = good.limit(3).unionByName(good.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(good.limit(1).withColumn("doc_id", F.lit(10**9)))
    alone = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.materialize(good.unionByName(extra)), sf).collect()
    ids = [r.doc_id for r in alone]
    assert len(ids) == len(set(ids)) and 10**9 not in ids and None not in ids  # rows without an id are copies like others
    sets = [(r.doc_id, frozenset(zip(*(r.text.lower().split()[k:] for k in range(5)), strict=False))) for r in alone if r.doc_id is not None]
    for i, (_, a) in enumerate(sets):
        for _, b in sets[:i]:
            assert not a or not b or len(a & b) < 0.8 * len(a | b)
    packed = corpus_pipeline.pack(spark, good, sf).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in good.collect()} and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_near_copies_under_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    schema = "doc_id long, text string, key string, component int"

    def kept(rows):
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], schema)
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert out.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert kept([(1, a), (5, b), (5, a)]) == [(1, a), (5, b)]
    assert kept([(5, a), (5, b)]) == [(5, a), (5, b)]
    assert kept([(5, a), (5, a), (None, a), (7, a + " more")]) == [(5, a)]
    assert kept([(None, a), (None, a)]) == [(None, a)]
    assert kept([(1, ""), (2, None), (2, None), (3, " \n")]) == sorted([(1, ""), (2, None), (2, None), (3, " \n")], key=str)
    assert kept([]) == []


def test_stages_on_nothing(spark, sf):
    """Every stage, and the classifiers' fits, on an empty table and on null texts only."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in ([], [(1, None), (None, None), (1, "")]):
        some = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}).select(docs.columns)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, sf)
            assert out.count() == (0 if name == "quality rules" else len(rows) if name == "packing" or name.startswith("n-gram") else out.count())


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name in ("op7_quality_classifier", "op10_quality_rules"):
        found = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
        clean = [found[i].kept for i, q in labels.items() if q == 1 and not (name.startswith("op10") and found[i].base_failed)]
        assert np.mean(clean) > 0.97
        assert np.mean([found[i].kept for i, q in labels.items() if q == 0]) < 0.1
