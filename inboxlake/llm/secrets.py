"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

DataFrame functions and Spark's ML only.  A candidate's features are its length, kinds of characters, character
transitions under a bigram model of the corpus, the share that dictionary words of the corpus cover, the path it comes
from and its neighbouring words.  The forest learns from labelled findings.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import common

#: A run of 16 or more with a digit, or of 20 or more without.
CANDIDATE = (r"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+|[A-Za-z+/_\-]{20,}+)")
_NAMES = r"(?i:passw(?:or)?d|pwd|secret|token|api[_\-]?key)"
_SIGN = r"[\"']?\s*+(?:=>|:=|[=:])\s*+"
#: Texts that may hold a value assigned to a credential's name or a URL with a user part.
_PLACES = _NAMES + r"[\"']?\s*+[=:]|://[^\s/]*@"
#: Places whose value counts whatever its length and symbols.  What leads to the value is matched, the value itself is
#: looked at (group 1), so a value may lead to the next one.  Unquoted ones end without a comma, semicolon or full stop.
PLACES = {
    "assigned": _NAMES + _SIGN + r"[\"']?(?=((?<=\")[^\"\s]+|(?<=')[^'\s]+"
                                 r"|(?<![\"'])[^\s\"'=:>]\S*?(?=[.,;]*(?:\s|$))))",
    "password": r"://[^\s/@:]*+:(?=([^\s/]+)(?=@[^\s/@]))",
    "user": r"://(?=([^\s/@:]+)@)"}
#: Context characters kept on either side.
CONTEXT = 40
#: Documents that must hold a word of the dictionary.
WORD_DOCS = 3
#: Findings of each label that the forest learns from, about.
TRAIN_ROWS = 20_000
TREES, DEPTH, HASHED, SEED = 20, 6, 64, 7
THRESHOLD = 0.5
MARK = "[REDACTED]"

_ALPHABET = string.ascii_lowercase + string.digits
_STATES = len(_ALPHABET) + 1
_NUMBERS = ["length", "digits", "capitals", "small", "distinct", "switches", "transitions", "coverage", "assigned",
            "quoted"]


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def _sums(lengths: Column) -> Column:
    """Running sums of an array of numbers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(lengths, start, lambda s, x: F.struct(
        (s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"] + x)).alias("all")))["all"]


def _lengths(pieces: Column, matches: Column) -> Column:
    return F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: (
        F.coalesce(F.length(x["p"]), F.lit(0)) + F.coalesce(F.length(x["m"]), F.lit(0))))


def _one(value: Column, start: Column, before: Column, after: Column, place: Column) -> Column:
    return F.struct(value.alias("value"), start.alias("start"), F.right(before, F.lit(CONTEXT)).alias("before"),
                    F.left(after, F.lit(CONTEXT)).alias("after"), place.alias("place"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, path, start (characters from 0), value, before, after, place per candidate of ``docs``
    (doc_id, text, source).

    ``place`` tells a value in one of PLACES; the others are runs (CANDIDATE) that overlap none of those.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"),
                        F.col("text").cast("string").alias("__t"))
    found = (found.withColumn("__placed", F.col("__t").rlike(_PLACES))
             .where(F.col("__placed") | F.col("__t").rlike(CANDIDATE)))
    empty = F.array().cast("array<string>")
    only = lambda c: F.when(F.col("__placed"), c).otherwise(empty)
    cut = {"__m": F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0)), "__p": F.split("__t", CANDIDATE, -1)}
    for place, pattern in PLACES.items():
        cut |= {f"__m_{place}": only(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))),
                f"__v_{place}": only(F.regexp_extract_all("__t", F.lit(pattern), F.lit(1))),
                f"__p_{place}": only(F.split("__t", pattern, -1))}
    parts = found.withColumns(cut)
    parts = parts.withColumns({"__e": _sums(_lengths(F.col("__p"), F.col("__m")))}
                              | {f"__e_{place}": _sums(_lengths(F.col(f"__p_{place}"), F.col(f"__m_{place}")))
                                 for place in PLACES})
    runs = F.transform("__m", lambda m, i: _one(
        m, F.get("__e", i) - F.length(m), F.get("__p", i), F.get("__p", i + 1), F.lit(None).cast("string")))

    def in_place(place: str) -> Column:
        return F.transform(f"__v_{place}", lambda v, i: _one(
            v, F.get(f"__e_{place}", i), F.concat(F.get(f"__p_{place}", i), F.get(f"__m_{place}", i)),
            F.substr(F.get(f"__p_{place}", i + 1), F.length(v) + 1), F.lit(place)))
    placed = F.concat(*[in_place(place) for place in PLACES])
    end = lambda c: c["start"] + F.length(c["value"])
    parts = parts.withColumns({"__placed_values": placed, "__runs": runs})
    free = F.when(F.size("__placed_values") == 0, F.col("__runs")).otherwise(F.filter("__runs", lambda r: ~F.exists(
        "__placed_values", lambda v: (v["start"] < end(r)) & (r["start"] < end(v)))))
    return (parts.select("doc_id", "text_key", "path", F.explode(F.concat("__placed_values", free)).alias("c"))
            .select("doc_id", "text_key", "path", "c.*"))


def dictionary(docs: DataFrame, word_docs: int = WORD_DOCS) -> DataFrame:
    """word, docs: lower-case letter runs that at least ``word_docs`` documents hold, over all texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return (docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
            .where(F.col("docs") >= word_docs))


def _state(char: Column) -> Column:
    """Number of a character's state: a letter, a digit, or anything else (0)."""
    return F.instr(F.lit(_ALPHABET), char)


def bigrams(words: DataFrame) -> list[float]:
    """Log probability of each pair of states, from the dictionary's words weighted by documents, smoothed.

    One number for each pair of states reaches the driver, whatever the corpus.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(
        _state(F.substring("word", i, 1)).alias("a"), _state(F.substring("word", i + 1, 1)).alias("b")))
    counts = (words.select("docs", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("docs").alias("n")))
    table = {(r.a, r.b): r.n for r in counts.collect()}
    from math import log2
    rows = [sum(table.get((a, b), 0) for b in range(_STATES)) for a in range(_STATES)]
    return [log2((table.get((a, b), 0) + 1) / (rows[a] + _STATES)) for a in range(_STATES) for b in range(_STATES)]


def describe(found: DataFrame, words: DataFrame, table: list[float]) -> DataFrame:
    """Candidates with the forest's features."""
    value = F.col("value")
    low = F.lower(value)
    pairs = F.greatest(F.length(value) - 1, F.lit(1))
    at = F.sequence(F.lit(1), pairs)
    steps = F.transform(at, lambda i: F.element_at(F.lit(table), _state(F.substring(low, i, 1)) * _STATES
                                                   + _state(F.substring(low, i + 1, 1)) + 1))
    # by distinct value: copies of a finding are looked up once
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = (runs.join(words.select("word"), "word").groupBy("value")
               .agg(F.sum(F.length("word")).alias("__covered")))
    known = values.join(covered, "value", "left").select(
        "value", (F.coalesce("__covered", F.lit(0)) / F.length(value)).alias("coverage"),
        F.length(value).cast("double").alias("length"), _share(value, "0-9").alias("digits"),
        _share(value, "A-Z").alias("capitals"), _share(value, "a-z").alias("small"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct"),
        (F.regexp_count(value, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])")) / F.length(value)).alias("switches"),
        (F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / pairs).alias("transitions"))
    return found.join(known, "value").select(
        "*", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double").alias("quoted"),
        F.lower(F.regexp_extract("before", r"([\p{L}\p{N}_\-]+)[^\p{L}\p{N}_\-]*$", 1)).alias("previous_word"),
        F.lower(F.regexp_extract("after", r"^[^\p{L}\p{N}_\-]*([\p{L}\p{N}_\-]+)", 1)).alias("next_word"))


def label_findings(found: DataFrame) -> DataFrame:
    """Adds ``label`` from what needs no model: 1 for issued key formats and values with a digit assigned to a
    credential's name or in a URL's user part, 0 for plain numbers and strings without a digit elsewhere, null (to be
    judged) for all others."""
    issued = F.col("value").rlike("^AKIA[0-9A-Z]{16}$")
    named = F.coalesce(F.col("place").isin("assigned", "password"), F.lit(False))
    digit, other = F.col("value").rlike("[0-9]"), F.col("value").rlike("[^0-9]")
    return found.withColumn("label", F.when(issued | (named & digit & other), 1.0)
                            .when(~named & (~digit | ~other), 0.0))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> PipelineModel | None:
    """Forest over ``labelled`` findings with features and label (0, 1; null: not used), or None unless both labels
    occur.  Of a label with more than about ``rows`` findings, those with the smallest hashes are taken."""
    counts = {r["label"]: r["n"] for r in labelled.where("label is not null").groupBy("label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    part = F.pmod(F.xxhash64("doc_id", "start", "value"), F.lit(1_000_000)) / 1_000_000
    bound = F.when(F.col("label") == 1, rows / counts[1.0]).otherwise(rows / counts[0.0])
    chosen = common.stored(labelled.where(F.col("label").isNotNull() & (part < bound)), "findings")
    hasher = FeatureHasher(inputCols=["path", "previous_word", "next_word"], outputCol="hashed", numFeatures=HASHED)
    assembler = VectorAssembler(inputCols=[*_NUMBERS, "hashed"], outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64)
    if chosen.where("label = 1").isEmpty() or chosen.where("label = 0").isEmpty():
        return None
    return Pipeline(stages=[hasher, assembler, forest]).fit(chosen)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings of ``docs`` (doc_id, text, source): doc_id, text_key, start, value, label, score, is_secret.

    ``labelled``: findings with features and label; by default those that ``label_findings`` labels among the
    candidates themselves.  ``score`` is the forest's probability.  Without findings of both labels there is no
    forest: score is null and every candidate not labelled 0 is a secret.  Null and empty texts have no candidates;
    repeated documents give their findings each; an empty table gives no rows; other columns are ignored.
    """
    words = common.stored(dictionary(docs), "dictionary")
    cut = candidates(docs).persist(StorageLevel.DISK_ONLY)  # the texts are cut once; a lost executor's part again
    found = common.stored(label_findings(describe(cut, words, bigrams(words))), "candidates")
    cut.unpersist()
    model = train(found if labelled is None else labelled)
    out = ["doc_id", "text_key", "start", "value", "label"]
    if model is None:
        return found.select(*out, F.lit(None).cast("double").alias("score"),
                            (F.coalesce("label", F.lit(1.0)) > 0).alias("is_secret"))
    score = vector_to_array("probability")[1]
    return model.transform(found).select(*out, score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with the secrets of ``findings`` replaced by ``mark``; all other rows and columns as they are.

    Spans are matched by doc_id and the text's hash and replaced from the left; ``n_chars``, if it is there, is set
    anew for changed texts.
    """
    spans = (findings.where("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
             .agg(F.array_sort(F.collect_set(F.struct("start", F.length("value").alias("n")))).alias("__spans")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    joined = docs.join(spans, same, "left")
    text = F.col("text")
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    # a span that begins within the one before goes with it
    cut = F.aggregate("__spans", first, lambda s, x: F.struct(
        F.when(x["start"] < s["at"], s["out"]).otherwise(
            F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out"),
        F.greatest(s["at"], x["start"] + x["n"]).alias("at")))
    clean = F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))
    out = {"text": F.when(F.col("__spans").isNull(), text).otherwise(clean)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(clean).cast(kind))
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the values themselves stay out of the result."""
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), "label", "score", "is_secret")
