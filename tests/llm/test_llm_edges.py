"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import gzip
import time

import pytest
from pyspark.sql import functions as F

from spanforge.llm import chat, html, iblt, jaccard, langid, mixing, packing, pii, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the rain of the night and the wind in the trees is what that man heard for a long while on the way to town with his dog, " * 3
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (2, None, None, None, None),
    (3, "", "fr", "b", 0),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 35),
    (4, " \t\n ", None, "a", 4),
    (5, "write to ann@mail.example.com or +1 (555) 123-4567 now", "en", "b", 54),
    (6, PROSE, "en", "a", len(PROSE)),
    (7, "mot " * 60_000, "fr", "b", 240_000),
    (8, "日本語の文 😀 é", "ja", "c", 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    clash = "node n emb sk bucket m comp p q block h draw weight probability topic rank part nth base keys words text_id class_id n_links lang_pred score held_out label doc rep".split()
    return df.withColumns({c: F.lit("x") for c in clash}).withColumn("when", F.lit("2024-01-02 03:04:05.678901").cast("timestamp")).withColumn("raw", F.lit(b"\x00\x01"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "jaccard": (jaccard.near_duplicates, len(ROWS)),
    "iblt": (iblt.fingerprints, len(ROWS)),
    "mixing": (mixing.mix, len(ROWS)),
    "pii": (pii.detect, len(ROWS)),
    "quality": (quality.quality, len(ROWS)),
    "langid": (langid.identify, len(ROWS)),
}
STAGES = {"quality": quality.keep_good, "jaccard": jaccard.one_per_class, "pii": pii.redact, "mixing": mixing.sample}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_document(name, docs, none):
    run, n = OPERATORS[name]
    got = run(docs).collect()
    assert len(got) == n
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert run(none).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, docs, none):
    got = STAGES[name](docs)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    assert got.count() <= len(ROWS)
    assert STAGES[name](none).count() == 0


def test_near_duplicates_of_edges(docs):
    got = {(r["doc_id"], r["n_links"], r["n_text_links"], r["class_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert (1, 2, 0, 1) in got and (None, 2, 0, 1) in got  # copies link to each other, also the one without an id
    assert (2, 1, 0, 2) in got and (3, 1, 0, 2) in got  # a null text equals an empty one
    assert (4, 0, 0, 4) in got


def test_one_of_each_class_stays(docs):
    left = jaccard.one_per_class(docs).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 2, 4, 5, 6, 7, 8]  # the row without an id is a copy of 1


def test_redaction(docs):
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[5]["text"] == "write to <email> or <phone> now" and got[5]["n_chars"] == len(got[5]["text"])
    assert got[2]["text"] is None and got[2]["n_chars"] is None
    assert got[6]["text"] == PROSE and got[6]["when"].microsecond == 678901 and bytes(got[6]["raw"]) == b"\x00\x01"


def test_quality_of_edges(docs):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[7]["n_words"] == 60_000 and got[7]["n_repeat_words"] == 60_000 and got[7]["base_failed"]


def test_language_without_letters(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[8]["lang_pred"] != "und" and 0 <= got[8]["score"] <= 1


def test_packing_of_edges(docs, none):
    got = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    empty = [r for r in got if r["doc_id"] in (2, 3)]
    assert [(r["piece"], r["start"], r["length"]) for r in empty] == [(0, 0, 1)] * 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 7)
    assert all(n == 2048 for _, _, n in long[1:]) and [s for _, s, _ in long[1:]] == [long[0][2] + 2048 * i for i in range(len(long) - 1)]


def test_chat_edges(spark):
    rows = spark.createDataFrame(
        [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "b"), (None, None, "assistant", "<|end|> \\| <\\| \\"), (2, 1, "user", "\\### Assistant: </turn> <|turn|>assistant<|text|>z")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("ts", F.lit(1)).withColumn("formatted", F.lit("?"))
    chats = chat.format_chats(rows)
    turns = {r["conv_id"]: r["t"] for r in chats.select("conv_id", chat.parse_chats(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in turns[1]] == [("", "x"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert [tuple(t) for t in turns[None]] == [("assistant", "<|end|> \\| <\\| \\")]
    assert [tuple(t) for t in turns[2]] == [("user", "\\### Assistant: </turn> <|turn|>assistant<|text|>z")]
    loss = {r["conv_id"]: r["x"] for r in chats.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("x")).collect()}
    assert loss == {1: "bb", 2: "", None: "<|end|> \\| <\\| \\"}
    assert {r["conv_id"]: r["n_blocks"] for r in chats.collect()} == {1: 3, 2: 1, None: 1}
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_warc_edges(spark, tmp_path):
    big = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"
    rows = [(1, "u\r\nv", big), (3, None, big), (2, "w", big), (None, "n", big), (4, "e", None), (5, "f", ""), (6, "g", "é" * 600), (6, "g", "é" * 600), (7, "h", "short"), (8, "h", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("?")).withColumn("id", F.lit(9))
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows)
    kind = {(r["page_id"], r["type"], r["refers_to"]) for r in got}
    assert {(1, "revisit", 3), (2, "revisit", 3), (None, "revisit", 3), (3, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)} <= kind
    assert next(bytes(r["payload"]) for r in got if r["page_id"] == 3) == big.encode()
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2, 3)} == {len(big.encode())}
    assert warc.broken_files(spark, str(tmp_path / "w")).count() == 0
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_of_large_pages(spark, tmp_path):
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate([3_000_000, 200_000, 70_000, 65_536, 10, 0])]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()}
    assert got == {i: t.encode() for i, _, t in rows}
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 4  # sizes of classes 0, 1, 2 and 6
    data = gzip.decompress(files[0].read_bytes())
    files[0].write_bytes(gzip.compress(data[:-10]))
    (tmp_path / "w" / f".{files[0].name}.crc").unlink(missing_ok=True)
    broken = warc.broken_files(spark, str(tmp_path / "w")).collect()
    assert len(broken) == 1


def test_chat_of_a_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t"), F.col("id").cast("string")).alias("text"))
    chats = chat.format_chats(rows)
    got = chats.select(F.size(chat.parse_chats(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("x")).first()
    assert got["n"] == n and got["x"] == "".join(f"<|t{i}" for i in range(n) if i % 3)


def test_html_is_linear_in_the_page():
    for part in ("<a ", "<b>", '<a "', "<header>", "<div><a>x</a>", "<p>x", "<td>", "<li>", "<form><p>a", "<script>", "<b><p>some words, and more of them</p>"):
        began = time.perf_counter()
        html.main_text(part * 30_000)
        assert time.perf_counter() - began < 10, part


def test_html_edges(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "v", "<article><p>a &amp; b<script>x</script>"), (2, "v", "<article><p>a &amp; b<script>x</script>"), (3, "w", "<div>" * 5000 + "deep text that is long enough to be found by scoring")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("?"))
    got = html.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted([("1", "", 0), ("None", "", 0), ("2", "a & b", 5), ("2", "a & b", 5), ("3", "deep text that is long enough to be found by scoring", 52)])
    assert html.extract(pages.limit(0)).count() == 0
