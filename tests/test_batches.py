"""Python steps over documents: small batches, all tasks, mails as the default policy reads them."""

import email
import email.policy

from awardlake.checks import load
from awardlake.functions import batches
from awardlake.operators import documents, tables

MAILS = [
    b"From: Deals <Deals1@Mail.example>\r\nSubject: =?utf-8?q?caf=C3=A9?= offer\r\nDate: Mon, 2 Aug 1999 10:01:00 +0200\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nonly",
    b"From: Deals <Deals1@Mail.example>\r\nSubject: " + b"long " * 300 + b"\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9",
    b"Subject: \xff\xfe raw\r\nDate: no date\r\nContent-Type: multipart/mixed; boundary=zz\r\n\r\n--zz\r\nContent-Type: text/html; charset=nope\r\n\r\n<p>x</p>\r\n--zz--\r\n",
    b"", b"no headers at all", None,
]


def test_batches_of_documents_end_at_few_bytes(spark):
    before = {s: spark.conf.get(s) for s in batches.SETTINGS}
    try:
        for setting, value in zip(batches.SETTINGS, ("67108864b", "10000")):
            spark.conf.set(setting, value)
        docs = spark.range(3000).selectExpr("id AS doc_id", "concat('<rss><item><title>', id, '</title></item></rss>') AS text")
        nodes = documents.feed_nodes(docs)
        assert [int(spark.conf.get(s)) for s in batches.SETTINGS] == [4 << 20, 1024]
        assert sorted(int(r.nodes[0].fields[0].text) for r in nodes.collect()) == list(range(3000))
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def test_nulls_and_junk_in_all_python_steps(spark):
    docs = spark.createDataFrame([(1, None), (2, "<p>a <b>b</b></p>"), (3, "<table><tr><td>x</td></tr></table>"), (4, "plain")], "doc_id int, text string")
    assert {r.doc_id: len(r.nodes) for r in documents.feed_nodes(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.t for r in docs.select("doc_id", documents.html_to_text(docs["text"]).alias("t")).collect()} == {1: None, 2: "a  b", 3: "x", 4: "plain"}
    assert {r.doc_id: [t.header for t in r.tables or []] for r in tables.with_tables(docs, "text").collect()} == {1: [], 2: [], 3: [["x"]], 4: []}
    assert documents.feed_nodes(docs.limit(0)).collect() == []


def test_mails_are_dealt_to_all_tasks(spark):
    mails = spark.createDataFrame([(i, bytearray(MAILS[0])) for i in range(50)], "doc_id int, raw binary").coalesce(1)
    read = documents.parse_mail_documents(mails)
    sizes = read.rdd.glom().map(len).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(sizes) > 0 and sum(sizes) == 50


def test_headers_parsed_once_read_like_the_default_policy(monkeypatch):
    def plain(raw):
        with monkeypatch.context() as m:
            m.setattr(documents, "_mail_policy", lambda: email.policy.default)
            return result(raw)

    def result(raw):
        try:
            return documents._mail_fields(raw)
        except Exception as x:  # what fails, fails alike
            return type(x)

    for _ in range(2):
        for raw in MAILS:
            assert result(raw) == plain(raw)
    factory = documents._mail_policy().header_factory
    assert factory("Subject", "one") is factory("Subject", "one") and factory("subject", "one") == "one"


def test_followed_mails_and_links_are_not_read_again(spark):
    text = load()[0]["follow_mail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_visible_text" in text and "_mail_fields" not in text and "_anchor_targets" not in text
