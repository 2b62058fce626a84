"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves.  Each node is content or not.  Its
features give a potential of its own, and each parent and child share one that depends on the kind of
the child.  Messages are passed up from the leaves and down from the root (sum-product), all pages of a
slice at once by depth, which gives exact marginals.  Weights maximise the conditional likelihood of
labelled pages, which are made here in varied layouts; the trained model has a fixed size.  No list of
names decides: words of classes, ids and roles are hashed features, and in half of the training pages
names tell nothing, so that element kinds, position in the tree and links must do.

A run is kept if its marginal is 0.5 or more.  Runs are blocks: character references are decoded, white
space becomes one space, ends are trimmed, and blocks are joined by an empty line in page order.  Text
of scripts, styles, titles, templates and form controls is never content.

Defined cases: null, empty and textless pages give the empty text; a page that is plain text is read as
one block; unclosed or wrongly nested elements are read leniently, in time in proportion to the page, and a tag
that the page's end cuts off is dropped; elements nested deeper than 512 count as children of the one there; rows that repeat an id are extracted
row by row; an empty table gives no rows; other columns are ignored, and one with the name of the text gives way to it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text
from fathomix.llm.html_pages import MARK, labelled_pages
from fathomix.llm.html_tree import FEATURES, N_FEATURES, Tree, parse

TRAINING_PAGES = 1200
KEEP = 0.5


@dataclass
class Model:
    """Weights of features for content, and log potentials by child kind, parent state and child state."""

    weight: np.ndarray
    pair: np.ndarray


class Forest:
    """Several trees as arrays, with the nodes of each depth."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.array(t.parent, np.int64) + f for t, f in zip(trees, self.first, strict=False)])
        depth = np.concatenate([np.array(t.depth, np.int64) for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        flat = [f for t in trees for f in t.features]
        self.owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.feature = np.array([x for f in flat for x in f], np.int64)
        self.run = np.zeros(len(flat), np.int64)
        self.run[self.owner[self.feature == FEATURES["run"]]] = 1

    def unary(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weight[self.feature], len(self.parent))


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and P(parent state, child state) of each node with its parent."""
    n = len(forest.parent)
    local = np.zeros((n, 2))
    local[:, 1] = forest.unary(model.weight)
    up = np.zeros((n, 2))  # the message to the parent
    below = local.copy()  # own potential and the messages of all children
    pair = model.pair[forest.run]  # node, parent state, own state
    for nodes in forest.levels[:0:-1]:
        m = np.logaddexp.reduce(pair[nodes] + below[nodes][:, None, :], axis=2)
        up[nodes] = m - m.max(axis=1, keepdims=True)
        np.add.at(below, forest.parent[nodes], up[nodes])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for nodes in forest.levels[1:]:
        p = forest.parent[nodes]
        rest = below[p] + down[p] - up[nodes]
        m = np.logaddexp.reduce(rest[:, :, None] + pair[nodes], axis=1)
        down[nodes] = m - m.max(axis=1, keepdims=True)
        j = rest[:, :, None] + pair[nodes] + below[nodes][:, None, :]
        j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
        joint[nodes] = j / j.sum(axis=(1, 2), keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def labels(tree: Tree) -> np.ndarray:
    """A node's label is the mark of its nearest marked ancestor or itself; ancestors of main text without one count as such."""
    out = np.zeros(len(tree.parent))
    for i in range(1, len(tree.parent)):
        out[i] = float(tree.marks[i]) if tree.marks[i] is not None else out[tree.parent[i]]
    return out


def fit(pages: list[str], rounds: int = 200, l2: float = 0.0003) -> Model:
    """A model of pages whose elements carry MARK attributes."""
    trees = [parse(p, MARK) for p in pages]
    forest = Forest(trees)
    y = np.concatenate([labels(t) for t in trees])
    child = forest.parent >= 0
    child[forest.first[:-1]] = False
    seen = np.zeros((2, 2, 2))
    parents = np.where(child, forest.parent, 0)
    np.add.at(seen, (forest.run[child], y[parents[child]].astype(int), y[child].astype(int)), 1)
    theta = np.zeros(N_FEATURES + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[:-8], theta[-8:].reshape(2, 2, 2))
        p, joint = marginals(forest, model)
        by_feature = np.bincount(forest.feature, (p - y)[forest.owner], N_FEATURES)
        expected = np.stack([joint[child & (forest.run == k)].sum(axis=0) for k in (0, 1)])
        grad = np.concatenate([by_feature, (expected - seen).ravel()]) / len(pages) + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:-8], theta[-8:].reshape(2, 2, 2))


@functools.cache
def train(pages: int = TRAINING_PAGES) -> Model:
    """The model of made pages; they are always the same, so a process trains it once."""
    return fit(labelled_pages(pages))


def extract(pages: list[str | None], model: Model, keep: float = KEEP) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    p = marginals(forest, model)[0]
    return ["\n\n".join(text for i, text in t.runs if len(t.parent) == 2 or p[f + i] >= keep and not t.dead[i]) for t, f in zip(trees, forest.first.tolist(), strict=False)]


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None, model: Model | None = None, name: str = "text") -> DataFrame:
    """``keep`` columns of pages and the main text of each."""
    model = model or train()
    # Plain arrays: a broadcast is pickled by reference, and workers may have no copy of this library.
    shared = pages.sparkSession.sparkContext.broadcast((model.weight, model.pair))

    def make():
        model = Model(*shared.value)

        def run(texts: pa.Array) -> list:
            return [extract(texts.to_pylist(), model)]

        return run

    return map_text(pages, html, [T.StructField(name, T.StringType())], make, ["page_id", "url"] if keep is None else keep, max_bytes=1 << 20)


def with_length(rows: DataFrame, name: str = "text") -> DataFrame:
    return rows.withColumn("n_chars", F.char_length(name).cast("long"))
