"""Secret scans: values in places of any width, nested places, long texts, against brute force."""

import random
import re

from pyspark.sql import functions as F

from inboxlake.llm import common, secrets


def brute(text):
    """(start, value, place) by the same rules, a position at a time."""
    placed = set()
    names = re.compile(r"(?i:passw(?:or)?d|pwd|secret|token|api[_\-]?key)")
    for name in names.finditer(text):
        at = name.end()
        if text[at:at + 1] in ('"', "'"):
            at += 1
        while text[at:at + 1].isspace():
            at += 1
        sign = next((x for x in ("=>", ":=", "=", ":") if text.startswith(x, at)), None)
        if sign is None:
            continue
        at += len(sign)
        while text[at:at + 1].isspace():
            at += 1
        quote = text[at:at + 1] if text[at:at + 1] in ('"', "'") and text[at:at + 1] else ""
        at += len(quote)
        value = re.match(rf"[^{quote}\s]+" if quote else r"[^\s\"'=:>]\S*", text[at:])
        value = value and value.group()
        if value and not quote:
            value = value[0] + value[1:].rstrip(".,;")
        if value:
            placed.add((at, value, "assigned"))
    for url in re.finditer(r"://", text):
        rest = re.match(r"\S*", text[url.end():]).group().split("/")[0]
        if "@" in rest:
            user = rest.split("@")[0]
            if ":" in user:
                start = rest.index(":") + 1
                password = re.match(r"(.+)(?=@[^@])", rest[start:])
                if password:
                    placed.add((url.end() + start, password.group(1), "password"))
            elif user:
                placed.add((url.end(), user, "user"))
    pattern = re.compile(secrets.CANDIDATE.replace("*+", "*").replace("}+", "}"))
    runs = {(m.start(), m.group(), None) for m in pattern.finditer(text)
            if not any(s < m.end() and m.start() < s + len(v) for s, v, _ in placed)}
    return placed | runs


def test_places_against_brute_force(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choices("abcdef0123456789", k=n))
    texts = [f"password ={' ' * 30}{key(9)} end", f"PWD:\n\n\t\t   'a b' {key(20)}", f"pg://{'u' * 300}:{key(8)}@host/x",
             f"http://{'v' * 200}@host", "token: password: abc; secret=x=y", 'password="secret=ab"cd', "api-key => 'q1'.",
             "my_long_prefix_of_an_api_key=zz1", "://a:b:c@d@e ://@x ://:p@x", "tokenizer: no, passwords none",
             '{"password": "é1", "n": 5}', "secret==x token:=v1 pwd:'", None, "", "password", "password=", "x" * 50_000,
             f"{key(40)} password={key(40)}", "passwd: a.b,c;., next", " ".join(f"token={i}" for i in range(300))]
    for _ in range(150):
        texts.append("".join(rng.choice(["password", "token", "=", ":", " ", '"', "'", "://", "@", "/", ".", key(3),
                                         key(17), "=>", ":=", "\n", "user", "é"]) for _ in range(rng.randrange(2, 25))))
    schema = "doc_id long, text string, source string, place string, before int"
    docs = spark.createDataFrame([(i, t, "s", "p", 1) for i, t in enumerate(texts)], schema).repartition(4)
    got: dict = {}
    for r in secrets.candidates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.value, r.place))
        assert texts[r.doc_id][r.start:r.start + len(r.value)] == r.value
    for i, t in enumerate(texts):
        assert got.get(i, set()) == (brute(t) if t else set()), t


def test_labels_don_t_depend_on_the_context_kept(spark):
    rows = [(0, f"pg://{'u' * 45}:Abc123x@host", "s"), (1, f"password ={' ' * 60}Abc123x", "s"),
            (2, "pg://u:Abc123x@host", "s"), (3, "the word abcdefghijklmnopqrstuvwx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.label_findings(secrets.candidates(docs)).where("place IS NOT NULL OR doc_id = 3")
    labels = {r.doc_id: r.label for r in found.collect()}
    assert labels == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_overlapping_findings_are_cut_out_once(spark):
    docs = spark.createDataFrame([(0, "a password=secret=abc b", "s")], "doc_id long, text string, source string")
    found = common.stored(secrets.candidates(docs).withColumn("is_secret", F.lit(True)), "f")
    assert sorted((r.start, r.value) for r in found.collect()) == [(11, "secret=abc"), (18, "abc")]
    assert secrets.redact(docs, found).first().text == f"a password={secrets.MARK} b"


def test_texts_are_cut_once(spark):
    """The stored candidates are read for every feature: no second scan of the documents."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    cut = common.stored(secrets.candidates(docs), "cut")
    words = common.stored(secrets.dictionary(docs), "dictionary")
    plan = secrets.describe(cut, words, secrets.bigrams(words))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(text" not in plan and "documents.parquet" not in plan
