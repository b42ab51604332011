"""Full-text search: weighted inverted index (T6) and boolean AND search.

The index is a plain (term, doc, weight, tf) table: written once clustered by
term, it plays the role of the reference's GIN index.  Search picks, per
query, its rarest term as the pivot: only the pivot's postings become
candidates, and each candidate is verified with an equi-join on (doc, term)
against the index -- the intermediate result is bounded by the rarest
posting list, not the sum of all posting lists.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import porter_stem
from .partitioning import spread, tasks_for

#: Bytes of written postings, sorted by term and so well compressed, that one task frees of repeated stems.
STEM_BYTES = 4 << 20
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# ---- fixed values: English stop words (the classic 127-word list) ----
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# ----------------------------------------------------------------------


def tokens(text: Column, distinct: bool = True) -> Column:
    """Lower-case letter/digit runs without stop words.

    ``distinct=True`` uses ``array_except`` (one hash pass that also drops
    duplicates); otherwise occurrences are kept for term frequencies.
    """
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT)
    if distinct:
        return F.array_except(parts, F.array(F.lit(""), *[F.lit(w) for w in STOP_WORDS]))
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def _stem_series(s: pd.Series) -> pd.Series:
    return s.map(porter_stem)


_UDF = {}


def stem_map(terms: DataFrame) -> DataFrame:
    """term -> stem for the distinct vocabulary (one Python call per batch)."""
    if "stem" not in _UDF:
        _UDF["stem"] = F.pandas_udf(_stem_series, "string")
    vocab = terms.select("term").distinct()
    # AQE would pack the (small) vocabulary into a few partitions; spread it
    # so the Python stemmer runs on every core.
    vocab = vocab.repartition(terms.sparkSession.sparkContext.defaultParallelism * 2)
    return vocab.select("term", _UDF["stem"](F.col("term")).alias("stem"))


def stemmed(postings: DataFrame, key: str) -> DataFrame:
    """Replace ``term`` by its stem (distinct vocabulary stemmed once, joined back).

    Dealt by ``key`` into as many parts as the postings need before repeated stems are dropped, so no task
    holds more pairs when there are more.
    """
    m = stem_map(postings)
    return (postings.join(m, "term").drop("term").withColumnRenamed("stem", "term")
            .repartition(tasks_for(postings, STEM_BYTES), key).dropDuplicates([key, "term"]) if key else postings)


def build_index(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, term, weight, tf) per weighted field, e.g. {'subject': 'A', 'body': 'B'}."""
    out = None
    for col, weight in fields.items():
        p = (spread(docs.select(key, col)).select(key, F.explode(tokens(F.col(col), distinct=False)).alias("term"))
             .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
             .withColumn("weight", F.lit(weight)))
        out = p if out is None else out.unionByName(p)
    return out


def postings(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Distinct (key, term) pairs of one text column."""
    return spread(docs.select(key, text_col)).select(key, F.explode(tokens(F.col(text_col))).alias("term"))


def search_all_terms(index: DataFrame, queries: DataFrame, doc_key: str = "doc_id",
                     query_key: str = "query_id") -> DataFrame:
    """Documents containing every term of each query (boolean AND).

    ``index``: distinct (doc_key, term); ``queries``: distinct (query_key, term).
    A query without terms (only stop words) matches nothing.
    """
    # only postings of terms that some query asks for leave the scan
    index = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    qt = queries.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_q = qt.groupBy(query_key).agg(F.min_by("term", F.struct("df", "term")).alias("pivot"),
                                      F.count(F.lit(1)).alias("n_terms"), F.min("df").alias("min_df"))
    live = per_q.where(F.col("min_df") > 0)  # a term absent from the index matches nothing
    cand = (live.join(index.withColumnRenamed("term", "pivot"), "pivot")
            .select(query_key, doc_key, "n_terms"))
    checks = cand.join(queries, query_key)  # candidate x its query's terms
    hits = checks.join(index, [doc_key, "term"], "left_semi")
    return (hits.groupBy(query_key, doc_key, "n_terms").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == F.col("n_terms")).select(query_key, doc_key))
