"""Extra columns with clashing names, and WARC files of other writers."""

import gzip

import pytest

from attestry.llm import bpe, packing, quality, suffixes, toxicity, urls, warc
from attestry.llm.queries import VOCABULARY
from attestry.llm.shared import apart


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_apart_keeps_names_and_values(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, HELP int, out int")
    made = apart(frame, ["help", "out"], lambda f: f.selectExpr("*", "7 AS help", "8 AS out").drop("help"))
    assert made.columns == ["a", "HELP", "out_input", "out"] and made.first().asDict() == {"a": 1, "HELP": 2, "out_input": 3, "out": 8}
    taken = spark.createDataFrame([(1, 2, 3)], "out int, out_input int, __aside0 int")
    assert apart(taken, ["out"], lambda f: f.selectExpr("*", "8 AS out")).first().asDict() == {"out_input_input": 1, "out_input": 2, "__aside0": 3, "out": 8}


@pytest.mark.parametrize("column", ["score", "__events", "plain_insults", "n_words", "n_bytes"])
def test_scores_leave_columns_of_their_names(spark, column):
    frame = spark.createDataFrame([(1, "some words", "kept"), (2, None, None)], f"doc_id bigint, text string, `{column}` string")
    plain = toxicity.score(frame, toxicity.Model({}, toxicity.PRIOR_WEIGHTS, -3.0))
    back = f"{column}_input" if column in ("score", "plain_insults") else column
    assert rows(plain.fillna("-", [back]), "doc_id", back) == [(1, "kept"), (2, "-")]
    plain = quality.score(frame, quality.Rules([], 0.0))
    back = f"{column}_input" if column == "score" else column
    assert rows(plain.fillna("-", [back]), "doc_id", back, "score") == [(1, "kept", 0.5), (2, "-", 0.5)]


def test_other_operators_leave_columns_of_their_names(spark):
    frame = spark.createDataFrame([(1, "one two", "a", "b", "c")], "doc_id bigint, text string, bin_id string, piece string, ids string")
    packed = packing.pack(frame.selectExpr("*", "2L AS n"), "n", ["doc_id"]).first()
    assert (packed.bin_id_input, packed.piece_input, packed.bin_id, packed.piece, packed.ids) == ("a", "b", 0, 0, "c")
    coded = bpe.encode(frame, "text", VOCABULARY).first()
    assert coded.ids_input == "c" and len(coded.ids) % 4 == 0

    long = " ".join(f"w{k}" for k in range(80))
    frame = spark.createDataFrame([(1, long, 5, "m", "p"), (2, long + " end", 6, None, "q")], "doc_id bigint, text string, doc int, mark string, passages string")
    cut = suffixes.without_repeats(frame)
    assert cut.columns == frame.columns or sorted(cut.columns) == sorted(frame.columns)
    assert [(r.doc_id, r.doc, r.mark, r.passages) for r in cut.orderBy("doc_id").collect()] == [(1, 5, "m", "p"), (2, 6, None, "q")]

    pages = spark.createDataFrame([(1, "http://a.org/fr/x", "h", "b", 1), (2, "http://b.com/", "h", "b", 2), (3, None, None, None, 3)], "page_id bigint, url string, host string, block string, w0 int")
    judged = urls.judge(pages, spark.createDataFrame([("http://b.com",)], "url string"), urls.RULES)
    assert [(r.page_id, r.host, r.verdict, r.host_input, r.block, r.w0) for r in judged.orderBy("page_id").collect()] == [
        (1, "a.org", "allow", "h", "b", 1), (2, "b.com", "block", "h", "b", 2), (3, "", "allow", None, None, 3)]

    source = warc.responses(spark.createDataFrame([(1, "http://a.org/", "<p>x</p>")], "page_id bigint, url string, html string"), "2024-01-01T00:00:00Z").selectExpr("*", "'mine' AS block")
    assert {(r.block_input, r.warc_type) for r in warc.derive(source).collect()} == {("mine", "metadata"), ("mine", "conversion")}


def record(kind, uri, block):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nWARC-Target-URI:http://a.org/{uri}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["plain", "whole", "each"])
def test_responses_of_files_are_derived(spark, tmp_path, packed):
    body = "<html><title>T</title><p>café</p>\r\n\r\n<p>end</p></html>".encode()
    records = [
        record("warcinfo", 0, b"software: x\r\n"), record("response", 1, b"HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\n" + body),
        record("response", 2, b"HTTP/1.1 200 OK\r\n\r\n"), record("request", 3, b"GET / HTTP/1.1\r\n\r\n"),
        record("response", 4, b""), record("response", 5, b"no header \xff"), record("response", 6, b"HTTP/1.1 200 OK\r\n\r\n" + b"word " * 400_000),
    ] + [record("response", 10 + k, b"HTTP/1.1 404 Not Found\r\n\r\n" + b"y" * 300_000) for k in range(60)]
    whole = b"".join(records)
    name, content = {"plain": ("a.warc", whole), "whole": ("a.warc.gz", gzip.compress(whole)), "each": ("a.warc.gz", b"".join(map(gzip.compress, records)))}[packed]
    (tmp_path / name).write_bytes(content)
    read = warc.read_warc(spark, str(tmp_path))
    assert read.count() == len(records)
    found = {r.target_uri.rsplit("/", 1)[1]: r for r in warc.responses_of(read).collect()}
    assert sorted(map(int, found)) == [1, 2, 4, 5, 6, *range(10, 70)]
    assert found["1"].http_header == "HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\n" and found["1"].payload == body.decode() and found["1"].warc_date == "2024-02-03T04:05:06Z"
    assert (found["2"].http_header, found["2"].payload, found["4"].payload, found["5"].http_header, found["5"].payload) == ("HTTP/1.1 200 OK\r\n\r\n", "", "", "", "no header �")
    assert len(found["6"].payload) == 2_000_000
    made = {(r.refers_to, r.warc_type): r for r in warc.derive(warc.responses_of(read)).collect()}
    assert len(made) == 2 * len(found) and "title: T" in made["<urn:uuid:1>", "metadata"].block and "café" in made["<urn:uuid:1>", "conversion"].block
    assert made["<urn:uuid:1>", "metadata"].source_payload_digest == warc.digest(body)
