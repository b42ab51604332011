"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Each piece goes where the sum of the squared numbers of open sequences per residual gap becomes smallest.  Pieces of
one length are interchangeable, so placement works on the numbers of pieces per length (as many as the capacity,
whatever the data's size) and Spark deals the pieces out to the places by their rank within their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
#: Pieces that the placement handles one by one in a round; larger counts are cut into as many equal groups.
ROUND_PIECES = 40_000
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 400_000

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a byte-level BPE as packed little-endian numbers, word by word.

    A token never reaches over the boundary before a single space between two characters that aren't white space, so
    a text splits there exactly and each word's ids can be remembered.  Other texts are encoded whole.  The added
    tokens of a tokenizer's json are cut out of a text first, as ``tokenizers`` does; a file of ranks has none.
    """

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN
        with open(vocabulary, "rb") as f:
            if vocabulary.endswith(".json"):
                ranks, added = _parse_tokenizer(json.load(f))
            else:
                ranks, added = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}, {}
        self.whole = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.odd = regex.compile(r"^\s|\s$|[^\S ] | [^\S ]|  ")
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not self.added or not self.cut.search(text):
            return self._words(text)
        return b"".join(self.added[part] if i % 2 else self._words(part)
                        for i, part in enumerate(self.cut.split(text)))

    def _words(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known = self.words
        try:
            return self._encode(first) + b"".join([known[w] for w in rest])
        except KeyError:
            out = [self._encode(first)]
            for w in rest:
                ids = known.get(w)
                if ids is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    ids = self._encode(" " + w)
                    if len(w) <= 64:
                        known[w] = ids
                out.append(ids)
            return b"".join(out)


def _parse_tokenizer(tokenizer: dict) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by bytes and ids of the added tokens of a byte-level BPE's json; anything else is refused."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    added = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokenizer["added_tokens"]):
        raise ValueError("added tokens that are matched other than by their text")
    vocab, steps = tokenizer["model"]["vocab"], tokenizer["pre_tokenizer"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in tokenizer["model"]["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if (tokenizer["normalizer"] or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"]
            or order != sorted(order)):
        raise ValueError("not a byte-level BPE with ids in the order of its merges")
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}, added


def _encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = True) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32[, ids binary].

    ``vocabulary``: a tokenizer's json, or a file of BPE ranks alone, at the same path on every machine; texts of the
    json's added tokens are those tokens.  ``end_id`` ends each document.  Documents over ``capacity`` are cut from
    their end into pieces of ``capacity``; the first piece is the rest.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    rows.append((doc, i, a, b - a, zlib.crc32(part), part))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(cols[i], t) for i, t in enumerate(
                [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def place(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences (lists of lengths) for ``counts[length]`` pieces, longest first, by the sum of squares.

    Placing a piece of length s in a gap g changes the sum by 1 - 2 n[g], and by 2 n[g - s] + 1 more unless the
    sequence becomes full; ties take the smallest gap.  A sequence is begun only where no open one has room, for
    fewer sequences than the rule's online form, which may begin one earlier.
    """
    open_at: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    done: list[list[int]] = []
    for s in range(capacity, 0, -1):
        for _ in range(int(counts[s])):
            gaps = n[s:capacity]
            after = 2 * n[:capacity - s] + 1
            if len(after):
                after[0] = 0
            change = np.where(gaps > 0, 1 - 2 * gaps + after, np.iinfo(np.int64).max)
            best = int(change.argmin()) if len(change) else -1
            if best >= 0 and gaps[best] > 0:
                gap = best + s
                sequence = open_at[gap].pop()
                n[gap] -= 1
            else:
                gap, sequence = capacity, []
            sequence.append(s)
            if gap == s:
                done.append(sequence)
            else:
                open_at[gap - s].append(sequence)
                n[gap - s] += 1
    return done + [x for at in open_at for x in at]


def plan(counts: np.ndarray, capacity: int = CAPACITY, round_pieces: int = ROUND_PIECES) -> tuple[list, list]:
    """Places for any numbers of pieces: rounds (round, length, first, last, copies) and slots (round, length,
    slot, sequence, offset).

    A round cuts the counts into equal groups of at most ``round_pieces``, places one group and uses its sequences
    once for every group; a piece of rank r (first <= r < last) takes slot (r - first) // copies, in sequence
    + (r - first) % copies.  While there are several groups, only sequences with almost no gap are used; the gap
    allowed grows from round to round, and what is left over meets in later rounds until one group holds it all.
    """
    left, first = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    rounds, slots, sequences, spare, k = [], [], 0, 0, 0
    while left.sum():
        copies = max(1, -(-int(left.sum()) // round_pieces))
        group = left // copies
        if not group.sum():
            copies, group = 1, np.minimum(left, 1) if left.sum() > round_pieces else left.copy()
        last = copies == 1 and int(group.sum()) == int(left.sum())
        placed = [s for s in place(group, capacity) if last or capacity - sum(s) <= spare]
        used = np.zeros(capacity + 1, np.int64)
        for sequence in placed:
            offset = 0
            for s in sequence:
                slots.append((k, s, int(used[s]), sequences, offset))
                used[s] += 1
                offset += s
            sequences += copies
        for s in np.flatnonzero(used):
            rounds.append((k, int(s), int(first[s]), int(first[s] + used[s] * copies), copies))
        first += used * copies
        left -= used * copies
        spare, k = min(2 * spare + 1, capacity), k + 1
    return rounds, slots


def pack(cut: DataFrame, capacity: int = CAPACITY, round_pieces: int = ROUND_PIECES) -> DataFrame:
    """Adds sequence_id and offset to stored ``cut`` (doc_id, piece, start, length, ids_crc32, ...).

    The driver gets one count per length (at most ``capacity``) and sends back the plan, of about ``round_pieces``
    rows a round and a number of rounds that grows with the logarithm of the data.  Ranks are salted, so one length
    may hold any share of the pieces.  Equal pieces take their places in any order.
    """
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().toLocalIterator():
        counts[r[0]] = r[1]
    rows, full = int(counts.sum()), int(counts[capacity])
    counts[capacity] = 0
    rounds, slots = plan(counts, capacity, round_pieces)
    rounds_df = spark.createDataFrame(pd.DataFrame(rounds, columns=["__k", "length", "__first", "__last", "__copies"]),
                                      "__k long, length long, __first long, __last long, __copies long")
    slots_df = spark.createDataFrame(pd.DataFrame(slots, columns=["__k", "length", "__slot", "__seq", "offset"]),
                                     "__k long, length long, __slot long, __seq long, offset long")
    ranked = common.gapless_rank(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], rows, "__r")
    whole = (ranked.where(F.col("length") == capacity)
             .withColumn("sequence_id", -F.col("__r") - 1).withColumn("offset", F.lit(0).cast("long")))
    rest = (ranked.where(F.col("length") < capacity).join(F.broadcast(rounds_df), "length")
            .where("__first <= __r AND __r < __last")
            .withColumn("__slot", F.expr("(__r - __first) div __copies"))
            .join(F.broadcast(slots_df), ["__k", "length", "__slot"])
            .withColumn("sequence_id", F.expr("__seq + (__r - __first) % __copies")))
    columns = [*cut.columns, "sequence_id", "offset"]
    return rest.select(*columns).unionByName(whole.select(*columns)) if full else rest.select(*columns)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, four bytes a token): the packed sequences themselves, of pieces with ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset.

    Null and empty texts are one piece of the end id alone.  Repeated rows are packed each.  An empty table gives no
    rows; other columns are ignored.
    """
    return pack(common.stored(pieces(docs, vocabulary, with_ids=with_ids), "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 1024 tokens."""
    import public_tokenizers
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
