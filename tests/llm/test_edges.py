"""Empty tables, clashing names, nulls and very long texts where no other test has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.llm import chat, html_text, media, url_filter


def test_chats(spark):
    long = "word </turn> " * 100_000
    rows = [(None, 0, "user", "a"), (1, 0, None, None), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, "assistant", "")]
    messages = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("m", F.lit(1)).withColumn("inner", F.lit(2))
    messages = messages.withColumn("content", chat.text_parts(F.col("text")))
    done = chat.format_chats(messages).withColumn("read", chat.read_turns(F.col("formatted")))
    made = {r.conv_id: [(t["role"], t["text"]) for t in r.read] for r in done.collect()}
    assert made == {None: [("user", "a")], 1: [("", ""), ("assistant", long), ("assistant", long)], 2: [("assistant", "")]}
    assert chat.format_chats(messages.limit(0)).count() == 0


def test_pages(spark):
    long = "<html><body><article>" + "<p>A sentence of words that is told at some length, with a comma.</p>" * 5_000 + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, None), (3, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    made = sorted((r.row.page_id, r.n_chars, r.text[:10]) for r in html_text.extract_text(pages).collect())
    whole = len("A sentence of words that is told at some length, with a comma. ") * 5_000 - 1
    assert made == [(1, whole, "A sentence"), (1, whole, "A sentence"), (2, 0, ""), (3, 0, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_media_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string").withColumn("media", F.lit("clash")).withColumn("feature", F.lit("clash"))
    stored = media.with_media(docs)
    assert stored.count() == 0 and media.media_features(stored.select("row.doc_id", "media")).count() == 0


def test_rules_with_nulls(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://org/"), (3, None)], "page_id long, url string")
    made = {r.row.page_id: r.rule for r in url_filter.judge(pages, rules).collect()}
    assert made == {1: None, 2: "org/", 3: None}
