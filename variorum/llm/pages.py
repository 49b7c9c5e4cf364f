"""Main text of web pages: a tree-structured model over DOM nodes, solved by sum-product messages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.dom import Node, Tree, parse
from variorum.llm.labelled_pages import labelled_pages
from variorum.llm.tables import in_batches

STEPS = 250
RATE = 1.0
PENALTY = 1e-3
#: Sizes, in bits, from which on texts count as equally large.
LARGE = 9
#: Pages whose trees are solved at once.
BLOCK_CHARS = 4_000_000
SCHEMA = "page_id long, url string, text string, n_chars long"


def node_features(nodes: list[Node], i: int) -> Iterator[str]:
    """What is known of a node by itself: names for the potentials of its own state."""
    node = nodes[i]
    yield "any"
    size = min(node.chars.bit_length(), LARGE)
    dense = 0 if not node.chars else 1 + (4 * node.linked) // node.chars
    if node.text is None:
        yield f"tag {node.tag}"
        yield from (f"name {w}" for w in node.names)
        yield f"element size {size}"
        yield f"element links {dense}"
        yield f"element leaves {node.leaves.bit_length()}"
    else:
        owner = nodes[node.parent]
        yield f"in {owner.tag}"
        yield f"size {size}"
        yield f"links {dense}"
        yield f"ends {node.text[-1] in '.!?:;…'}"


@dataclass(slots=True)
class Forest:
    """Trees of several pages side by side, with what messages need: parents, levels, features and kinds of links."""

    parent: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray
    owner: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree], numbers: dict[str, int], learn: bool = False) -> Forest:
        parent, depth, leaf, owner, feature, base = [], [], [], [], [], 0
        for tree in trees:
            for i, node in enumerate(tree.nodes):
                parent.append(node.parent + base if node.parent >= 0 else -1)
                depth.append(node.depth)
                leaf.append(node.text is not None)
                for name in node_features(tree.nodes, i):
                    k = numbers.setdefault(name, len(numbers)) if learn else numbers.get(name)
                    if k is not None:
                        owner.append(base + i)
                        feature.append(k)
            base += len(tree.nodes)
        deep = np.array(depth, np.int64)
        order = np.argsort(deep, kind="stable")
        cuts = np.flatnonzero(np.diff(deep[order])) + 1
        return cls(
            np.array(parent, np.int64), deep, np.array(leaf, np.int64), np.array(owner, np.int64),
            np.array(feature, np.int64), np.split(order, cuts),
        )


@dataclass(slots=True)
class Model:
    """Potentials: one number a feature for the state "content", and a 2 x 2 table (parent, child) for each kind
    of link, to an element (0) and to a text (1)."""

    numbers: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of each node, and the joint one (parent, child) of each node's link upward."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.owner, self.weights[forest.feature], n)
        table = self.pairs[forest.leaf]  # (n, parent state, child state)
        below, up = own.copy(), np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):  # upward: children tell their parents
            up[level] = np.logaddexp.reduce(table[level] + below[level][:, None, :], axis=2)
            np.add.at(below, forest.parent[level], up[level])
        down = np.zeros((n, 2))
        for level in forest.levels[1:]:  # downward: parents tell each child what all the others say
            parents = forest.parent[level]
            rest = below[parents] + down[parents] - up[level]
            down[level] = np.logaddexp.reduce(table[level] + rest[:, :, None], axis=1)
            down[level] -= down[level].max(axis=1, keepdims=True)
        belief = below + down
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        child = np.flatnonzero(forest.parent >= 0)
        parents = forest.parent[child]
        rest = below[parents] + down[parents] - up[child]
        joint = table[child] + rest[:, :, None] + below[child][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return content, joint / joint.sum(axis=(1, 2), keepdims=True)


def states(trees: list[Tree], contents: list[set[str]]) -> np.ndarray:
    """Labels of nodes: a text is content or not, an element is if most of its characters are."""
    out: list[int] = []
    for tree, known in zip(trees, contents):
        good = [node.chars if node.text is not None and node.text in known else 0 for node in tree.nodes]
        for i in range(len(tree.nodes) - 1, 0, -1):
            good[tree.nodes[i].parent] += good[i]
        out += [int(2 * g > node.chars) for g, node in zip(good, tree.nodes)]
    return np.array(out)


def train(pages: Iterable[tuple[str, set[str]]]) -> Model:
    """Gradient steps on the likelihood of labelled pages (html, texts of their content blocks).

    What a page's labels show less what the model expects, by its marginals, is the slope of each potential.
    """
    given = list(pages)
    trees = [parse(page) for page, _ in given]
    labels = states(trees, [{" ".join(x.split()) for x in known} for _, known in given])
    model = Model()
    forest = Forest.of(trees, model.numbers, learn=True)
    model.weights = np.zeros(len(model.numbers))
    child = np.flatnonzero(forest.parent >= 0)
    kind, shown = forest.leaf[child], np.zeros((2, 2, 2))
    np.add.at(shown, (kind, labels[forest.parent[child]], labels[child]), 1)
    often = np.bincount(forest.feature, minlength=len(model.weights))
    speed_w, speed_p = np.zeros_like(model.weights), np.zeros_like(model.pairs)
    for _ in range(STEPS):
        content, joint = model.marginals(forest)
        slope = np.bincount(forest.feature, (labels - content)[forest.owner], len(model.weights))
        slope = slope / np.sqrt(often * len(given)) - PENALTY * model.weights
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind, joint)
        steep = (shown - expected) / len(child) - PENALTY * model.pairs
        speed_w, speed_p = 0.9 * speed_w + 0.1 * RATE * slope, 0.9 * speed_p + 0.5 * RATE * steep
        model.weights, model.pairs = model.weights + speed_w, model.pairs + speed_p
    return model


def main_texts(pages: list[str], model: Model) -> list[str]:
    """Content blocks of each page, in page order, one line each."""
    trees = [parse(page) for page in pages]
    content, _ = model.marginals(Forest.of(trees, model.numbers))
    out, base = [], 0
    for tree in trees:
        out.append("\n".join(n.text for i, n in enumerate(tree.nodes) if n.text is not None and content[base + i] > 0.5))
        base += len(tree.nodes)
    return out


def extract(
    pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """SCHEMA: the main text of each row's page; a null or empty page has an empty text.

    Text that the model takes for no content is left out and nothing else is; repeated rows give equal
    rows. No shuffle; pages are solved in blocks of about BLOCK_CHARS, a longer page alone.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            start = size = 0
            held = batch.column(2).to_pylist()
            for i in range(len(held) + 1):
                if i == len(held) or (i > start and size + len(held[i]) > BLOCK_CHARS):
                    texts = main_texts(held[start:i], model)
                    yield [*(c.slice(start, i - start) for c in batch.columns[:2]), texts, list(map(len, texts))]
                    start, size = i, 0
                if i < len(held):
                    size += len(held[i])

        return work

    return in_batches(rows, SCHEMA, make)


def main_text(pages: DataFrame) -> DataFrame:
    """`extract` with a model trained on the labelled pages of this package."""
    return extract(pages, train(labelled_pages()))
