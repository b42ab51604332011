"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded hierarchically.

The trees (Spark ML) give every block-level node and text run the log-odds that it holds main text if its parent does.
A node kept under a dropped one, or a kept node that keeps nothing below, would be a contradiction, so a page is
decoded as a whole, from the root down (``decode``).  The text is that of the kept runs.

The trees learn from ``TRAIN_PAGES`` generated pages with known labels (``layouts``), the same for every run, so what a
page gives depends on the page alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .dom import FEATURES, TEXT_RUN, Nodes, parse
from .layouts import labelled_page

#: Generated pages to learn from, and the trees.
TRAIN_PAGES, TREES, DEPTH, STEP = 1200, 24, 5, 0.35
#: Pages and characters that are parsed together, about.
BATCH_PAGES, BATCH_CHARS = 256, 1 << 20
SCHEMA = "page_id long, url string, text string, n_chars long"


@dataclass
class Trees:
    """Boosted trees as full binary trees of one depth, level by level: feature, threshold, and values of the leaves."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the columns of ``x`` (features x nodes)."""
        n = x.shape[1]
        out, rows, flat = np.zeros(n), np.arange(n), np.ascontiguousarray(x).ravel()
        for feature, threshold, value in zip(self.feature * n, self.threshold, self.value):
            at = np.zeros(n, np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat[feature[at] + rows] > threshold[at])
            out += value[at - len(feature)]
        return 2 * out  # the trees are fitted to a loss whose odds are exp(2 * sum)


def training_rows(spark: SparkSession, first: int, pages: int) -> DataFrame:
    """Features and labels (1: holds main text) of the nodes of generated pages whose parent holds main text."""
    from pyspark.ml.functions import array_to_vector

    def rows(batches):
        for batch in batches:
            nodes = Nodes([parse(labelled_page(i)) for i in batch.column(0).to_pylist()])
            open_ = (nodes.parent >= 0) & (nodes.labels[nodes.parent] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.features[:, open_].T.tolist(), pa.list_(pa.float32())),
                 pa.array(nodes.labels[open_].astype(float))],
                ["x", "label"])
    return (spark.range(first, first + pages, 1, 4).mapInArrow(rows, "x array<float>, label double")
            .select(array_to_vector("x").alias("features"), "label"))


def fit(spark: SparkSession, pages: int = TRAIN_PAGES) -> Trees:
    """Trees fitted to ``pages`` generated pages; their nodes are read back from the saved model."""
    from pyspark.ml.classification import GBTClassifier  # not at the top: the workers need none of it
    rows = common.stored(training_rows(spark, 0, pages), "html-nodes")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11, maxBins=32).fit(rows)
    return _trees(model, DEPTH)


def _trees(model, depth: int) -> Trees:
    size = (1 << depth) - 1
    feature = np.zeros((len(model.trees), size), np.int64)
    threshold, value = np.full(feature.shape, np.inf), np.zeros((len(feature), size + 1))

    def fill(t, at, node, weight):
        if node.numDescendants():
            feature[t, at], threshold[t, at] = node.split().featureIndex(), node.split().threshold()
            fill(t, 2 * at + 1, node.leftChild(), weight)
            fill(t, 2 * at + 2, node.rightChild(), weight)
        else:
            while at < size:  # a leaf above the last level: down its left side (its threshold is infinite)
                at = 2 * at + 1
            value[t, at - size] = weight * node.prediction()
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        fill(t, 0, tree._call_java("rootNode"), weight)
    return Trees(depth, feature, threshold, value)


def decode(nodes: Nodes, odds: np.ndarray) -> np.ndarray:
    """The nodes to keep, without contradictions between ancestors and descendants.

    ``odds`` are log-odds of keeping a node whose parent is kept.  From the root down, a node's probability is its
    parent's times its own, its own being conditioned on what a kept element implies: that at least one of its
    children is kept.  So no node is likelier than the ones above it.  Runs of text of more than a half are kept, and
    with them the elements that hold them; a page whose parts are all unlikely keeps nothing.
    """
    n = len(odds)
    holds = (nodes.group == TEXT_RUN).astype(np.int64)
    for level in nodes.levels[:0:-1]:
        np.maximum.at(holds, nodes.parent[level], holds[level])
    kept = np.where(holds > 0, -np.logaddexp(0, -odds), -np.inf)
    none = np.zeros(n)  # log-probability that all children are dropped
    below = np.flatnonzero((nodes.parent >= 0) & (holds > 0))
    np.add.at(none, nodes.parent[below], -np.logaddexp(0, odds[below]))
    some = np.where((nodes.parent >= 0) & (none < 0), np.log(-np.expm1(np.minimum(none, -1e-300))), 0)
    likely = np.zeros(n)
    for level in nodes.levels[1:]:
        parent = nodes.parent[level]
        likely[level] = likely[parent] + np.minimum(kept[level] - some[parent], 0)
    keep = (nodes.group == TEXT_RUN) & (nodes.parent >= 0) & (likely > np.log(0.5))
    for level in nodes.levels[:0:-1]:
        np.logical_or.at(keep, nodes.parent[level], keep[level])
    return keep


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """Main text of each page: its kept runs, a line each."""
    nodes = Nodes([parse(p) for p in pages])
    keep = decode(nodes, trees.log_odds(nodes.features)) & (nodes.group == TEXT_RUN)
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(keep):
        out[nodes.page[i]].append(nodes.texts[i])
    return ["\n".join(t) for t in out]


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most BATCH_PAGES pages and, but for a single longer page, about BATCH_CHARS."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + BATCH_PAGES, int(np.searchsorted(sizes, base + BATCH_CHARS, "right"))))
        yield batch.slice(at, end - at)
        at = end


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (its code points).

    A null html is empty, and an empty page has an empty text, as has one without main text.  A page is parsed whole,
    however long.  Repeated rows and null ids or urls stay as they are; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            for part in _bounded(batch):
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(spark))


#: The main text of pages whose article is one ``article`` element of headings and paragraphs, as in the given tables.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, unnest(string_split_regex(
    regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>')) AS b,
  unnest(range(len(string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
    '</?(p|h1)>')))) AS n FROM pages),
t AS (SELECT page_id, url, n, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
    '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS b FROM a),
j AS (SELECT page_id, url, coalesce(string_agg(b, chr(10) ORDER BY n) FILTER (WHERE b <> ''), '') AS text
  FROM t GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""
