"""Golden rows for the message-text functions."""

from pyspark.sql import functions as F

from inboxlake.functions import text as tx


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_sender_domain(spark):
    cases = {"a@B.com": "b.com", "a@b@C.com": "c.com", "nodomain": "", "": ""}
    for src, want in cases.items():
        assert one(spark, tx.sender_domain(F.col("x")), src) == want
    assert one(spark, tx.sender_domain(F.col("x")), None) == ""


def test_thread_id(spark):
    df = spark.createDataFrame([("<a@x> <b@y>", "m1", 7), ("no-brackets", "m2", 8), (None, None, 9)],
                               "refs string, mid string, uid long")
    got = [r.t for r in df.select(tx.resolve_thread_id(F.col("refs"), F.col("mid"), F.col("uid")).alias("t")).collect()]
    assert got == ["a@x", "m2", "9"]


def test_labels_from_flags(spark):
    df = spark.createDataFrame([(["\\Seen", "\\flagged"],), (["\\Seen"],), (None,)], "f array<string>")
    got = [r.l for r in df.select(tx.labels_from_flags(F.col("f")).alias("l")).collect()]
    assert got == [["INBOX", "IMPORTANT"], ["INBOX"], ["INBOX"]]


def test_strip_quoted_replies(spark):
    f = lambda v: one(spark, tx.strip_quoted_replies(F.col("x")), v)
    assert f("Hi there\n\nOn Mon, X wrote:\n> old") == "Hi there"
    assert f("keep\n--- Original Message ---\nold") == "keep"
    assert f("keep\n-----original message-----\nold") == "keep"
    assert f("> q\nabc") == ""
    assert f("  plain text  ") == "plain text"


def test_normalize_whitespace_and_tags(spark):
    f = lambda v: one(spark, tx.strip_tags(tx.normalize_whitespace(F.col("x"))), v)
    assert f("a&amp;nbsp;b") == "a&nbsp;b"          # single-pass decoding
    assert f("x \t\ny") == "x\ny"                  # trailing blanks per line
    assert f("a\n\n\n\nb") == "a\n\nb"             # 3+ newlines -> 2
    assert f("a  b\t\tc") == "a b c"               # blank runs -> 1
    assert f("&lt;b&gt;x&lt;/b&gt;") == "x"        # encoded tags vanish after decoding
    assert f("a b") == "a b"             # non-breaking space is not a blank
    assert f("1 < 2") == "1 < 2"                   # '<' + blank is text, like PHP
    assert f("&amp") == "&amp"                     # no ';' -> not an entity


def test_html_to_text(spark):
    html = ("<html><head><style>p{x}</style><script>var t='</p>';</script></head>"
            "<body><!-- c --><h1>Title &amp; more</h1><p>One<br>Two</p></body></html>")
    got = one(spark, tx.clean_body(F.lit(None).cast("string"), F.col("x")), html)
    assert got == "Title & more\n\nOne\nTwo"


def test_body_choice(spark):
    df = spark.createDataFrame([("plain", "<p>html</p>"), ("", "<p>html</p>"), ("", None)], "p string, h string")
    got = [r.b for r in df.select(tx.clean_body(F.col("p"), F.col("h")).alias("b")).collect()]
    assert got == ["plain", "html", ""]


def test_embedding_text_and_headers(spark):
    assert one(spark, tx.embedding_text(F.col("x"), F.lit(None)), " subj ") == "subj"
    df = spark.createDataFrame([({"References": "<a>", "X-Other": "1", "List-Id": ""},)], "h map<string,string>")
    got = df.select(tx.selected_headers(F.col("h"), ["references", "list-id"]).alias("m")).first()["m"]
    assert got == {"References": "<a>"}


def test_entity_decoding_matches_single_pass(spark):
    from inboxlake.functions.text import _decode
    cases = ["&amp;lt;b&amp;gt;", "&amp;amp;", "a&nbsp;b&copy;c&middot;", "&eacute;t&eacute; &#233; &#xE9;",
             "&amp", "x &unknown; y", "&quot;q&quot; &apos;a&#39;", "&&amp;;"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r.d for r in df.select(tx.decode_entities(F.col("x")).alias("d")).collect()]
    assert got == [_decode(c) for c in cases]
