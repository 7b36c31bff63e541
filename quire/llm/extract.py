"""Main text of web pages by a tree-structured graphical model (operator 10).

Every block of a page (``dom.read_page``) has a hidden label, content or not.
Its own features give it a potential, and each pair of parent and child has one
of four others.  Sum-product message passing over the tree, first upward from
the leaves, then downward from the root, gives each block's exact marginal; all
pages of a batch pass messages together, level by level.  A second upward pass
with all blocks barred gives the probability that a page has no content at all;
since pages with little beside an article are rarer among labelled pages than in
the web, the odds of any content count ``LIKELY`` times.  Blocks whose marginal
is then above one half are the main text.

The potentials are the maximum-likelihood estimate on labelled pages: the
gradient is the difference between labelled and expected features, expectations
coming from the same messages.  By default the labelled pages are ``TRAINING``
pages of ``labelled.page``, whose content stands in one of several shapes
(``labelled.SHAPES``); others can be given.

Output text: references decoded, white space within a block as one space, blocks
in page order joined by line feeds; nothing is cut.  Defined cases: null or
empty html, or a page without content: the empty text; a page cut off anywhere
reads up to there; repeated rows get a row each; null ids and urls are passed
on.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled, words
from quire.llm.dom import Page, read_page

TRAINING = 1000
#: So many times likelier than among the labelled pages is it that a page with so little else has an article.
LIKELY = 20
FEATURES = 1 << 12
ROUNDS = 120
#: Pages that pass messages together.
PAGES = 128


@lru_cache(1 << 16)
def _column(name: str) -> int:
    return crc32(name.encode()) % FEATURES


def node_features(page: Page) -> list[list[int]]:
    """Columns of each node's features: structure, names and the shape of its
    own text; no words of the text."""
    n = len(page.tag)
    size, ends, blocks = [0] * n, [0] * n, [0] * n
    for node, said in page.runs:
        size[node] += len(said)
        blocks[node] += 1
        ends[node] += said[-1] in ".!?:;\"'"
    below, links_below = size[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        below[page.parent[i]] += below[i]
        links_below[page.parent[i]] += links_below[i]
    out = []
    for i in range(n):
        tag, up = page.tag[i], page.tag[page.parent[i]] if i else ""
        own = ["bias", f"tag {tag}", f"under {up} {tag}"]
        for w in page.names[i]:
            own += [f"name {w}", f"stem {w.rstrip('s')[:5]}"]
        if not page.names[i]:
            own.append(f"nameless {tag}")
        own.append(f"own {min(8, size[i].bit_length())}")
        own.append(f"links {4 * page.linked[i] // max(1, size[i])}")
        own.append(f"links below {4 * links_below[i] // max(1, below[i])}")
        own.append(f"below {min(10, below[i].bit_length()) // 2}")
        if blocks[i]:
            own.append(f"ends {ends[i] > 0}")
        out.append([_column(x) for x in own])
    return out


@dataclass
class Forest:
    """Pages as one forest: parents (-1: root), nodes by depth, features."""
    parent: np.ndarray
    levels: list[np.ndarray]
    row: np.ndarray
    column: np.ndarray


def forest(pages: list[Page]) -> Forest:
    parent, depth, row, column, base = [], [], [], [], 0
    for p in pages:
        for i, (up, own) in enumerate(zip(p.parent, node_features(p), strict=True)):
            parent.append(up + base if up >= 0 else -1)
            depth.append(depth[base + up] + 1 if up >= 0 else 0)
            row += [base + i] * len(own)
            column += own
        base += len(p.tag)
    depths = np.array(depth, np.int64)
    order = np.argsort(depths, kind="stable")
    edges = np.searchsorted(depths[order], np.arange(depths.max(initial=0) + 2))
    return Forest(np.array(parent, np.int64), [order[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], np.array(row, np.int64), np.array(column, np.int64))


@dataclass
class Model:
    weights: np.ndarray
    """Log potential of content for each feature column."""
    pair: np.ndarray
    """(parent's label, child's label) log potentials."""


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def _upward(f: Forest, m: Model, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores with all that lies below, and messages to the parents; nodes in ``barred`` cannot be content."""
    score = np.zeros((len(f.parent), 2))
    score[:, 1] = np.bincount(f.row, m.weights[f.column], len(f.parent))
    if barred is not None:
        score[barred, 1] = -700
    up = np.zeros_like(score)  # message to the parent
    for level in f.levels[:0:-1]:
        up[level] = _log_sum(m.pair + score[level][:, None, :])
        np.add.at(score, f.parent[level], up[level])
    return score, up


def nothing(f: Forest, m: Model, blocks: np.ndarray) -> np.ndarray:
    """Probability of each tree, in root order, that none of its ``blocks`` is content."""
    roots = np.flatnonzero(f.parent < 0)
    return np.exp(_log_sum(_upward(f, m, blocks)[0][roots]) - _log_sum(_upward(f, m)[0][roots]))


def marginals(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(nodes,) probability of content, and (nodes, 2, 2) of the labels of the
    parent and the node (zero for roots)."""
    n = len(f.parent)
    score, up = _upward(f, m)
    joint = np.zeros((n, 2, 2))
    belief = score.copy()
    for level in f.levels[1:]:
        above = belief[f.parent[level]] - up[level]  # what the parent knows without this child
        both = above[:, :, None] + m.pair + score[level][:, None, :]
        belief[level] = _log_sum(both.transpose(0, 2, 1))
        both = np.exp(both - both.max((1, 2), keepdims=True))
        joint[level] = both / both.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def labels(page: Page) -> list[int]:
    """Labels by the `data-main` marks: a node without one is like its parent."""
    out: list[int] = []
    for mark, up in zip(page.mark, page.parent, strict=True):
        out.append(int(mark == "1") if mark is not None else (out[up] if up >= 0 else 0))
    return out


def train(htmls: list[str], rounds: int = ROUNDS, ridge: float = 0.3) -> Model:
    """Maximum-likelihood potentials by gradient steps (Adam)."""
    pages = [read_page(h) for h in htmls]
    f = forest(pages)
    y = np.array([x for p in pages for x in labels(p)], float)
    inner = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parent[inner]].astype(int), y[inner].astype(int)), 1)
    x = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        m = Model(x[:FEATURES], x[FEATURES:].reshape(2, 2))
        p, joint = marginals(f, m)
        slope = np.concatenate([np.bincount(f.column, (y - p)[f.row], FEATURES), (seen - joint.sum(0)).ravel()]) - ridge * x
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        x = x + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Model(x[:FEATURES], x[FEATURES:].reshape(2, 2))


@lru_cache(1)
def default_model() -> Model:
    return train(labelled.pages(TRAINING))


def main_texts(pages: list[Page], m: Model) -> list[str]:
    """The text of the blocks that are more likely content than not."""
    if not pages:
        return []
    f = forest(pages)
    p, _ = marginals(f, m)
    base = np.cumsum([0, *(len(page.tag) for page in pages)])
    none = nothing(f, m, np.array([b + node for b, page in zip(base, pages, strict=False) for node, _ in page.runs], np.int64))
    # Odds of content in a page at all, given what it looks like, times LIKELY.
    out = []
    for b, page, empty in zip(base, pages, none, strict=False):
        scale = LIKELY / (LIKELY * (1 - empty) + empty)
        out.append("\n".join(said for node, said in page.runs if p[b + node] * scale > 0.5))
    return out


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id_col, url_col, text, n_chars) per row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch, "html"):
                for i in range(0, chunk.num_rows, PAGES):
                    part = chunk.slice(i, PAGES)
                    texts = main_texts([read_page(h or "") for h in part["html"].to_pylist()], sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [part["id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
