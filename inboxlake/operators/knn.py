"""Vector retrieval: cosine similarity (F15), vector literals (F16), exact
top-k over all stored vectors (K1, W1, O9), eligible few-shot examples (K3,
J8, J6) and approximate neighbours by random-hyperplane LSH (K2).

Exact top-k is a blocked matrix product, never a cross join of rows: both
sides are hashed into blocks of bounded size, each (query block, candidate
block) pair meets in a task of its own that multiplies tiles with numpy and keeps
only the best ``m`` candidates per query.  The shuffle carries ``m`` rows per
(query, candidate block), and a ``row_number() <= m`` window (planned as a
WindowGroupLimit) merges the blocks.  LSH reuses the same kernel inside each
(band, bucket), with a bucket split into as many blocks as its size needs,
so a hot bucket is spread over many tasks instead of one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ELIGIBLE_EXAMPLE_STATUSES, RAG_LIMIT, RAG_OVERFETCH, UNCATEGORIZED
from ..sources.store import checkpoint_table

BLOCK_BYTES = 64 << 20   # vector bytes per block side held by one cogroup task
BLOCK_ROWS = 4096        # block rows when the dimension is not known
LSH_BANDS = 24           # signature bands of K2
LSH_BITS = 4             # hyperplanes per band: 2^bits buckets
BLOCKS_PER_CORE = 4      # block pairs that a core gets at least, where there are so many rows
TILE_QUERIES, TILE_ROWS = 512, 8192  # rows scored at once inside a block pair (bounds the score matrix)
TILE_GROUPS = 256        # groups of a tile whose best give the first bound
TILE_SPAN = 128          # neighbouring rows of a tile that are passed over together by their best
SCORED_PAIRS = 1 << 16   # pairs scored in double precision at once
LISTED_QUERIES = 2048    # query rows whose answers of several lists are held at once
PAIR_SCHEMA = "query_id long, email_id long, similarity double"


# ---- column functions ------------------------------------------------------

def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def l2norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); NaN for a zero vector (explicit, ANSI never divides by zero)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    den = l2norm(a) * l2norm(b)
    return F.when(den == 0, F.lit(float("nan"))).otherwise(dot / den)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def vector_literal(vec: Column) -> Column:
    """F16: ``[a,b,c]`` text form."""
    return F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def check_dimension(vec: Column, dims: int) -> Column:
    """T5: vectors of the wrong dimension become null (and are reported by the caller)."""
    return F.when(F.size(vec) == dims, vec)


# ---- blocked top-k kernel -------------------------------------------------

def _unit(vec: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column at length one; a null row or one without direction is NaN."""
    vec = vec.combine_chunks()
    known = vec.is_valid().to_numpy(zero_copy_only=False)
    mat = vec.flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        mat = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    if not known.all():
        full = np.full((len(known), mat.shape[1]), np.nan)
        full[known] = mat
        mat = full
    return mat


def _first(row: np.ndarray, score: np.ndarray, cid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each row, by score, ties by smaller id."""
    order = np.lexsort((cid, -score, row))
    r = row[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    return order[nth < k]


def _scores(qu: np.ndarray, cu: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Double-precision products of the given pairs of rows."""
    out = np.empty(len(r))
    for s in range(0, len(r), SCORED_PAIRS):
        e = s + SCORED_PAIRS
        out[s:e] = np.einsum("ij,ij->i", qu[r[s:e]], cu[c[s:e]])
    return out


def _reaching(sim: np.ndarray, least: np.ndarray):
    """(row, column) of the scores at or above their row's ``least``: spans whose best is below it are not looked into."""
    if sim.shape[1] % TILE_SPAN:
        return np.divmod(np.flatnonzero(sim >= least[:, None]), sim.shape[1])
    spans = sim.reshape(len(sim), -1, TILE_SPAN)
    r, span = np.nonzero(spans.max(axis=2) >= least[:, None])
    at, c = np.nonzero(spans[r, span] >= least[r, None])
    return r[at], span[at] * TILE_SPAN + c


def _top(qu: np.ndarray, qid: np.ndarray, cu: np.ndarray, cid: np.ndarray, k: int, exclude_self: bool):
    """The ``k`` best rows of ``cu`` (finite, by rising ``cid``) for each row of ``qu``: (query row, row, score).

    Tiles are scored in single precision; whatever may be among the best, by the bound of its rounding error, is
    scored again in double precision, so the answer is that of the double-precision product.
    """
    slack = np.float32((cu.shape[1] + 8) * 2.0 ** -22)
    c32 = cu.astype(np.float32)
    copies = int(np.unique(cid, return_counts=True)[1].max()) if exclude_self and len(cid) else 0
    whole = len(cid) - len(cid) % TILE_SPAN  # what is over makes a tile of its own
    tiles = [(a, min(a + TILE_ROWS, whole)) for a in range(0, whole, TILE_ROWS)] + [(whole, len(cid))] * (whole < len(cid))
    held = np.empty(min(TILE_QUERIES, len(qid)) * min(TILE_ROWS, len(cid)), np.float32)  # one matrix for every tile
    rows, cols, scores = [], [], []
    for s in range(0, len(qid), TILE_QUERIES):
        own, ids = qu[s:s + TILE_QUERIES], qid[s:s + TILE_QUERIES]
        q32, bound = own.astype(np.float32), np.full(len(ids), -np.inf)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for a, b in tiles:
            sim = np.matmul(q32, c32[a:b].T, out=held[:len(ids) * (b - a)].reshape(len(ids), b - a))
            least = bound.astype(np.float32)
            wide = sim.shape[1] // TILE_GROUPS
            if a == 0 and wide > 1 and k + copies < TILE_GROUPS:
                # the best of each group: so many different rows reach the smallest of the leading ones
                tops = sim[:, :wide * TILE_GROUPS].reshape(len(ids), wide, TILE_GROUPS).max(axis=1)
                least = np.partition(tops, TILE_GROUPS - k - copies, axis=1)[:, TILE_GROUPS - k - copies]
            r, c = _reaching(sim, least - slack)
            c += a
            if exclude_self:
                other = ids[r] != cid[c]
                r, c = r[other], c[other]
            score = _scores(own, cu, r, c)
            better = score > bound[r]  # ids rise: an equal score found later comes later
            r, c, score = (np.concatenate([x, y[better]]) for x, y in zip(best, (r, c, score)))
            keep = _first(r, score, cid[c], k)
            best = r[keep], c[keep], score[keep]
            full = np.bincount(best[0], minlength=len(ids)) == k
            ends = np.cumsum(np.bincount(best[0], minlength=len(ids))) - 1
            bound[full] = best[2][ends[full]]
        rows.append(best[0] + s)
        cols.append(best[1])
        scores.append(best[2])
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip((rows, cols, scores), (np.int64, np.int64, float)))


def _by_list(qu, qid, lists: pa.ChunkedArray, cu, cid, of: np.ndarray, k: int, exclude_self: bool):
    """As ``_top``, a query compared only with rows of its ``lists`` (null: with all); a row's list is ``of``."""
    lists = lists.combine_chunks()
    if lists.null_count:
        every, some = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (lists.is_null(), lists.is_valid()))
        copies = int(np.unique(cid, return_counts=True)[1].max()) if len(cid) else 1
        parts = []
        for at, (r, c, score) in ((every, _top(qu[every], qid[every], cu, cid, k * copies, exclude_self)),
                                  (some, _by_list(qu[some], qid[some], pa.chunked_array([lists.take(pa.array(some))]), cu, cid, of, k, exclude_self))):
            parts.append((at[r], c, score))
        return tuple(np.concatenate(x) for x in zip(*parts))
    asked, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    order = np.argsort(of, kind="stable")  # within a list the ids still rise
    there, starts = np.unique(of[order], return_index=True)
    stops = np.r_[starts[1:], len(of)]
    copies = int(np.unique(cid, return_counts=True)[1].max()) if len(cid) else 1
    outs = []
    for s in range(0, len(qid), LISTED_QUERIES):
        e = min(s + LISTED_QUERIES, len(qid))
        mine, row = asked[ends[s] - sizes[s]:ends[e - 1]], np.repeat(np.arange(s, e), sizes[s:e])
        live = np.isin(mine, there)
        mine, row = mine[live], row[live]
        if len(mine) == (e - s) * len(there):  # every list asked by every query
            r, c, score = _top(qu[s:e], qid[s:e], cu, cid, k * copies, exclude_self)
            r += s
        else:
            found = []
            by = np.argsort(mine, kind="stable")
            cuts = np.flatnonzero(np.diff(mine[by])) + 1
            for place in np.split(by, cuts) if len(by) else []:
                at = np.searchsorted(there, mine[place[0]])
                own, rows = row[place], order[starts[at]:stops[at]]
                r, c, score = _top(qu[own], qid[own], cu[rows], cid[rows], k * copies, exclude_self)
                found.append((own[r], rows[c], score))
            if not found:
                continue
            r, c, score = (np.concatenate(x) for x in zip(*found))
        first = _first(r, score, cid[c], k * copies)
        outs.append((r[first], c[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*outs)) if outs else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def _block_topk(m: int, exclude_self: bool, listed: bool = False):
    def fn(q: pa.Table, c: pa.Table) -> pa.Table:
        outs = []
        if q.num_rows and c.num_rows:
            c = c.take(pc.sort_indices(c, [("id", "ascending")]))
            cu, cid, qu, qid = _unit(c["vec"]), c["id"].to_numpy(), _unit(q["vec"]), q["id"].to_numpy()
            c_ok, q_ok = np.isfinite(cu).all(axis=1), np.isfinite(qu).all(axis=1)
            if not c_ok.all():
                finite = cu[c_ok], cid[c_ok]
            else:
                finite = cu, cid
            at = np.flatnonzero(q_ok)
            own, ids = (qu, qid) if q_ok.all() else (qu[at], qid[at])
            if listed:  # an index holds and asks vectors with a direction only
                r, col, score = _by_list(own, ids, q["lists"].take(pa.array(at)), *finite, c["list"].to_numpy()[c_ok], m, exclude_self)
            else:
                r, col, score = _top(own, ids, *finite, m, exclude_self)
                # NaN (zero vector) ranks last: only where there is too little else, and by id
                most = m + len(cid) - len(np.unique(cid)) + 1
                bad = np.flatnonzero(~c_ok)[:most] if c_ok.sum() < most else np.empty(0, np.int64)
                for some, last in ((at, bad), (np.flatnonzero(~q_ok), np.arange(min(most, len(cid))))):
                    for s in range(0, len(some) if len(last) else 0, TILE_QUERIES):
                        qq, cc = np.repeat(qid[some[s:s + TILE_QUERIES]], len(last)), np.tile(cid[last], len(some[s:s + TILE_QUERIES]))
                        other = (qq != cc) if exclude_self else np.ones(len(qq), bool)
                        outs.append((qq[other], cc[other], np.full(int(other.sum()), np.nan)))
            outs.append((ids[r], finite[1][col], score))
        q_out, c_out, sim = (np.concatenate(x) for x in zip(*outs)) if outs else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        return pa.table({"query_id": q_out, "email_id": c_out, "similarity": sim})
    return fn


def _blocks(n: int, rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(n / rows))


def block_rows_for(n: int, dims: int, parallelism: int) -> int:
    """Rows per block: as large as the memory budget allows (fewer blocks = less
    replication of the other side), but small enough that every core gets work."""
    cap = max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dims)))
    want = max(BLOCK_ROWS, math.ceil(n / max(1, parallelism)))  # a block must amortise its task overhead
    return int(min(cap, want))


def block_counts(nq: int, nc: int, dims: int, parallelism: int) -> tuple[int, int]:
    """Blocks of the queries and of the candidates.

    Every further block of candidates sends each query, and its best of that block, once more: there are only as many
    as memory asks for, or as keep every core at work.
    """
    qbn = _blocks(nq, block_rows_for(nq, dims, parallelism))
    cbn = _blocks(nc, block_rows_for(nc, dims, parallelism))
    return qbn, max(_blocks(nc, block_rows_for(1 << 62, dims, 1)), min(cbn, -(-BLOCKS_PER_CORE * parallelism // qbn)))


def blocked_topk(queries: DataFrame, candidates: DataFrame, m: int, exclude_self: bool = True,
                 key_cols: list[str] | None = None, block_rows: int | None = None,
                 dims: int | None = None, listed: bool = False, query_rows: int | None = None) -> DataFrame:
    """Top-``m`` candidates by cosine similarity for every query (ties: smaller id).

    ``queries``: (id, vec [, key_cols]); ``candidates``: (id, vec [, key_cols]).
    With ``key_cols`` only rows with equal keys are compared (LSH buckets); with ``listed`` candidates have a ``list``
    besides and queries an array ``lists`` of those that they are compared with, or null for all that have their key.
    Blocks of queries have ``query_rows``, if given, instead of ``block_rows``.
    Output: (query_id, email_id, similarity, rank) with rank 1..m.
    """
    keys = key_cols or []
    par = queries.sparkSession.sparkContext.defaultParallelism
    if keys:
        block_rows = block_rows or BLOCK_ROWS
        # blocks per key from per-key sizes: one row per key (bounded by the key space), broadcast so that
        # never a side with vectors is, whose size after the exploding of keys the planner can't know
        qn = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"))
        cn = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cn"))
        sizes = qn.join(cn, keys).select(
            *keys, F.greatest(F.lit(1), F.ceil(F.col("_qn") / (query_rows or block_rows))).cast("int").alias("_qb_n"),
            F.greatest(F.lit(1), F.ceil(F.col("_cn") / block_rows)).cast("int").alias("_cb_n"))
        tasks, first = None, F.lit(0)
        if listed:  # few keys with many rows: their block pairs are numbered
            own = F.col("_qb_n") * F.col("_cb_n")
            sizes = checkpoint_table(queries.sparkSession, sizes.withColumn(
                "_first", (F.sum(own).over(Window.orderBy(*keys)) - own).cast("int")), "block_sizes")
            tasks, first = sizes.agg(F.sum(own)).first()[0] or 1, F.col("_first")
        q = queries.join(F.broadcast(sizes), keys)
        c = candidates.join(F.broadcast(sizes), keys)
        qb_n, cb_n = F.col("_qb_n"), F.col("_cb_n")
    else:
        nq, nc = queries.count(), candidates.count()
        if block_rows is None:
            d = dims or (candidates.select(F.size("vec")).first() or [BLOCK_ROWS])[0]
            qbn, cbn = block_counts(nq, nc, d, par)
        else:
            qbn, cbn = _blocks(nq, block_rows), _blocks(nc, block_rows)
        q, c = queries, candidates
        qb_n, cb_n, tasks, first = F.lit(qbn), F.lit(cbn), qbn * cbn, F.lit(0)
    # fresh aliases: both sides may come from the same frame (self search)
    fresh = [F.col("id").alias("id"), F.col("vec").alias("vec"), *[F.col(k).alias(k) for k in keys]]
    q = q.select(*fresh, *[F.col("lists").alias("lists")] * listed, F.pmod(F.xxhash64("id"), qb_n).cast("int").alias("qb"),
                 F.explode(F.sequence(F.lit(0), cb_n - 1)).alias("cb"), cb_n.alias("cbn"), first.alias("first"))
    c = c.select(*fresh, *[F.col("list").alias("list")] * listed, F.pmod(F.xxhash64("id"), cb_n).cast("int").alias("cb"),
                 F.explode(F.sequence(F.lit(0), qb_n - 1)).alias("qb"), cb_n.alias("cbn"), first.alias("first"))
    if tasks is None:
        q, c, grp = q.drop("cbn", "first"), c.drop("cbn", "first"), keys + ["qb", "cb"]
    else:  # hashed, several pairs would share a task while other cores wait
        number, grp = F.col("first") + F.col("qb") * F.col("cbn") + F.col("cb"), ["pair"]
        q, c = (x.withColumn("pair", number.cast("int")).drop(*keys, "qb", "cb", "cbn", "first")
                .repartitionById(tasks, "pair") for x in (q, c))
    pairs = (q.groupBy(*grp).cogroup(c.groupBy(*grp))
             .applyInArrow(_block_topk(m, exclude_self, listed), PAIR_SCHEMA))
    if keys:  # the same pair can meet in several bands; one shuffle serves this and the ranking
        pairs = pairs.repartition("query_id").groupBy("query_id", "email_id").agg(F.max("similarity").alias("similarity"))
    return rank_neighbours(pairs, m)


def distinct_topk(queries: DataFrame, candidates: DataFrame, m: int, dims: int | None = None) -> DataFrame:
    """``blocked_topk`` where many queries share a vector: each different vector is searched once, its answer goes to
    every query with it, without itself."""
    spark = queries.sparkSession
    own = candidates.groupBy("id").count().agg(F.max("count")).first()[0] or 0  # rows a query may find of itself
    vectors = checkpoint_table(spark, queries.select("vec").distinct().withColumn("id", F.monotonically_increasing_id()),
                               "query_vectors")
    found = blocked_topk(vectors, candidates, m + own, exclude_self=False, dims=dims).select(
        F.col("query_id").alias("_v"), "email_id", "similarity")
    members = queries.join(vectors.withColumnRenamed("id", "_v"), "vec").select(F.col("id").alias("query_id"), "_v")
    return rank_neighbours(members.join(found, "_v").where("query_id <> email_id").drop("_v"), m)


def rank_neighbours(pairs: DataFrame, m: int) -> DataFrame:
    """Rank per query by similarity desc (NaN last), then email_id; keep m."""
    w = Window.partitionBy("query_id").orderBy(
        F.isnan("similarity").asc(), F.col("similarity").desc(), F.col("email_id").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


# ---- few-shot examples (K1 + K3) ------------------------------------------

def similar_examples(neighbours: DataFrame, emails: DataFrame, triage: DataFrame, categories: DataFrame,
                     k: int = RAG_LIMIT) -> DataFrame:
    """K1 second half + K3: over-fetched neighbours (3k) -> eligible by *latest*
    status (trashed messages included) -> first k in rank order, with original
    and current labels.  ``emails`` holds (id, anonymized_subject): examples go
    into prompts, so the raw subject is never read.  May return fewer than k per
    query."""
    from .latest import latest_per_key
    lt = latest_per_key(triage, "email_id", "id",
                        ["status", "category_id", "llm_category_id", "proposed_category_name", "urgency",
                         "llm_urgency", "suggested_action", "llm_suggested_action"])
    cur = categories.select(F.col("id").alias("_c1"), F.col("name").alias("_n1"))
    org = categories.select(F.col("id").alias("_c2"), F.col("name").alias("_n2"))
    e = emails.select(F.col("id").alias("email_id"), "anonymized_subject")
    j = (neighbours.join(e, "email_id")
         .join(lt.where(F.col("status").isin(*ELIGIBLE_EXAMPLE_STATUSES)), "email_id")
         .join(cur, F.col("category_id") == F.col("_c1"), "left")
         .join(org, F.col("llm_category_id") == F.col("_c2"), "left"))
    w = Window.partitionBy("query_id").orderBy("neighbour_rank")
    return (j.select(
        "query_id", F.col("rank").alias("neighbour_rank"), "email_id", "anonymized_subject",
        F.coalesce("_n1", "proposed_category_name", F.lit(UNCATEGORIZED)).alias("category_name"),
        "urgency", "suggested_action",
        F.coalesce("_n2", "proposed_category_name", F.lit(UNCATEGORIZED)).alias("original_category"),
        F.col("llm_urgency").alias("original_urgency"), F.col("llm_suggested_action").alias("original_action"),
        "similarity", (F.col("status") == "corrected").alias("was_corrected"))
        .withColumn("example_rank", F.row_number().over(w)).where(F.col("example_rank") <= k))


def find_similar(query_vectors: DataFrame, store: DataFrame, emails: DataFrame, triage: DataFrame,
                 categories: DataFrame, k: int = RAG_LIMIT, dims: int | None = None, neighbours=None) -> DataFrame:
    """E4 ``findSimilar`` in bulk: (query_id, vec) x stored (email_id, embedding).

    ``neighbours`` (queries, stored, m) -> K1's output takes the place of the exact search, as ``ivf.searcher`` does
    (its index then holds the stored vectors)."""
    q = query_vectors.select(F.col("query_id").alias("id"), as_double(F.col("vec")).alias("vec"))
    c = store.select(F.col("email_id").alias("id"), as_double(F.col("embedding")).alias("vec"))
    if dims is not None:  # rejected vectors are the caller's to log; they must not reach the kernel
        q, c = (x.where(F.size("vec") == dims) for x in (q, c))
    nb = (neighbours or blocked_topk)(q, c, RAG_OVERFETCH * k)
    return similar_examples(nb, emails, triage, categories, k)


# ---- LSH (K2) ------------------------------------------------------------

def _lsh_fn(dims: int, bands: int, bits: int, seed: int):
    def fn(it):
        planes = np.random.default_rng(seed).standard_normal((dims, bands * bits))
        weights = (1 << np.arange(bits)).astype(np.int64)
        for pdf in it:
            if pdf.empty:
                yield pd.DataFrame({"id": [], "band": [], "bucket": []}).astype("int64")
                continue
            v = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            sig = (v @ planes > 0).reshape(len(v), bands, bits)
            buckets = (sig * weights).sum(axis=2)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(dtype=np.int64), bands),
                                "band": np.tile(np.arange(bands, dtype=np.int64), len(v)),
                                "bucket": buckets.ravel().astype(np.int64)})
    return fn


def lsh_buckets(vectors: DataFrame, dims: int, bands: int = 8, bits: int = 6, seed: int = 17) -> DataFrame:
    """Random-hyperplane signatures cut into ``bands`` of ``bits`` bits -> (id, band, bucket)."""
    return vectors.select("id", "vec").mapInPandas(_lsh_fn(dims, bands, bits, seed),
                                                   "id long, band long, bucket long")


def approx_topk(queries: DataFrame, candidates: DataFrame, m: int, dims: int, bands: int = LSH_BANDS,
                bits: int = LSH_BITS, seed: int = 17) -> DataFrame:
    """K2: exact re-rank of candidates sharing at least one LSH bucket with the query.

    ``bands`` and ``bits`` are the caller's choice and the same for every table
    size, so a row's neighbours don't depend on how many others there are.
    Recall grows with ``bands`` and falls with ``bits`` (measured against K1 by
    ``knn_lsh_recall``); a band costs about n * n / 2^bits comparisons.
    """
    qb = lsh_buckets(queries, dims, bands, bits, seed).join(queries, "id")
    cb = lsh_buckets(candidates, dims, bands, bits, seed).join(candidates, "id")
    # blocks as large as memory allows: every further block of a bucket sends each query's best once more
    return blocked_topk(qb, cb, m, exclude_self=True, key_cols=["band", "bucket"],
                        block_rows=max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dims))))
