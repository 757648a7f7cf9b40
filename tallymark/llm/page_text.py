"""Main text of web pages by a tree-structured graphical model.

Every element and text of a page is a node with one of three states: it holds the main
text among other things, it is main text, or it is neither. A node's state depends on
its parent's, and its features (tag, words of class, id and role, words held, share of
links) on its state. Parent-child and feature potentials are counted on labelled pages.
Messages pass from the leaves up and from the root down; their products are the exact
marginals. Texts that are main text with a probability over one half are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.dom import TEXT, Page, parse
from tallymark.llm.tables import map_rows, slices

HOLDS, MAIN, OTHER = range(3)
#: Classes of elements whose states depend on their parents' in the same way.
EDGES = {TEXT: 0, "a": 1, "p": 2, "div": 3, "section": 3, "ul": 4, "ol": 4, "li": 4, "article": 5, "main": 5, "body": 6, "html": 6}
OTHER_EDGE = 7
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Weight of one imagined node of each state in every count.
SMOOTHING = 0.3


@dataclass
class Model:
    """Logarithms: states of the root, states of a child by edge class and parent's state, features by state."""

    root: np.ndarray
    edges: np.ndarray
    features: dict[str, np.ndarray]


@dataclass
class Forest:
    """The nodes of many pages end to end."""

    pages: list[Page]
    starts: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    words: np.ndarray
    linked: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1))
        return np.split(order, cuts)


def plant(pages: list[Page]) -> Forest:
    """Node arrays of the pages, with the words below each node and those of them in links."""
    sizes = np.array([len(p.parent) for p in pages], np.int64)
    starts = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(p.parent, np.int64) + s for p, s in zip(pages, starts)])
    parent[starts] = -1
    depth = np.concatenate([np.array(p.depth, np.int64) for p in pages])
    edge = np.fromiter((EDGES.get(t, OTHER_EDGE) for p in pages for t in p.tag), np.int64, len(parent))
    words = np.zeros(len(parent), np.int64)
    linked = np.zeros(len(parent), np.int64)
    for page, start in zip(pages, starts.tolist()):
        for node, text in page.text.items():
            words[start + node] = text.count(" ") + 1
    forest = Forest(pages, starts, parent, depth, edge, words, linked)
    is_link = np.fromiter((t == "a" for p in pages for t in p.tag), bool, len(parent))
    for level in reversed(forest.levels()[1:]):
        linked[level] = np.where(is_link[level], words[level], linked[level])
        np.add.at(words, parent[level], words[level])
        np.add.at(linked, parent[level], linked[level])
    return forest


def _element_features(tag: str, marks: str, known: dict[str, np.ndarray] | None = None) -> list[str]:
    """The tag and all words of the marks; with ``known`` only what it holds, so that long marks don't fill the tables."""
    found = [f"tag:{tag}"]
    if marks:
        words = {w for w in _WORD.findall(_HUMP.sub(" ", marks).lower()) if not w.isdigit()}
        found += sorted(f for w in words if (f := f"mark:{w}") and (known is None or f in known))
    return found


def _size_features(is_text: np.ndarray, words: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Number of a size class: words held, share of links, text or element."""
    held = np.minimum(np.log2(words + 1).astype(np.int64), 9)
    share = np.where(linked == 0, 0, np.where(2 * linked < words, 1, 2))
    return held * 6 + share * 2 + is_text


def _feature_rows(forest: Forest, known: dict[str, np.ndarray] | None = None) -> tuple[list[list[str]], np.ndarray]:
    """Tables for the marginals: lists of features by kind of element, and each node's kind."""
    kinds: dict[tuple[str, str], int] = {}
    numbers = [kinds.setdefault((t, m), len(kinds)) for p in forest.pages for t, m in zip(p.tag, p.marks)]
    return [_element_features(*kind, known) for kind in kinds], np.array(numbers, np.int64)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(forest: Forest, model: Model) -> np.ndarray:
    """Probability of each state of each node, by messages up and down the trees."""
    known = model.features
    kinds, kind = _feature_rows(forest, known)
    none = np.zeros(3)
    by_kind = np.array([sum((known.get(f, none) for f in k), none) for k in kinds])
    is_text = forest.edge == EDGES[TEXT]
    size = _size_features(is_text, forest.words, forest.linked)
    by_size = np.array([known.get(f"size:{i}", none) for i in range(int(size.max(initial=0)) + 1)])
    up = by_kind[kind] + by_size[size]
    sent = np.zeros_like(up)
    levels = forest.levels()
    for level in reversed(levels[1:]):
        sent[level] = _log_sum(model.edges[forest.edge[level]] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], sent[level])
    belief = up.copy()
    belief[forest.starts] += model.root
    for level in levels[1:]:
        above = belief[forest.parent[level]] - sent[level]
        belief[level] += _log_sum(model.edges[forest.edge[level]] + above[:, :, None], 1)
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def _states(page: Page) -> np.ndarray:
    """States of a labelled page: an element marked ``data-y="main"`` or ``"other"`` gives its state to what it holds."""
    state = np.full(len(page.parent), -1)
    holds = np.zeros(len(page.parent), bool)
    for node in range(len(page.parent)):
        given = page.given[node]
        above = page.parent[node]
        state[node] = MAIN if given == "main" else OTHER if given == "other" else state[above] if node and state[above] >= 0 else -1
    for node in range(len(page.parent) - 1, 0, -1):
        holds[page.parent[node]] |= holds[node] | (state[node] == MAIN)
    return np.where(state >= 0, state, np.where(holds, HOLDS, OTHER))


def train(labelled: DataFrame, html_column: str = "html", most: int = 20_000) -> Model:
    """Potentials counted on labelled pages: at most ``most`` of them, those of smallest hash.

    In a labelled page elements carry ``data-y``. Null and empty pages teach nothing.
    """
    sample = labelled.filter(F.length(html_column) > 0).orderBy(F.xxhash64(html_column), html_column).limit(most)
    # A limit leaves one partition; pages are parsed by many tasks.
    sample = sample.repartition(labelled.sparkSession.sparkContext.defaultParallelism)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for piece in slices(batch, 0):
            pages = [parse(source) for source in piece.column(0).to_pylist()]
            forest = plant(pages)
            kinds, kind = _feature_rows(forest)
            state = np.concatenate([_states(p) for p in pages])
            size = _size_features(forest.edge == EDGES[TEXT], forest.words, forest.linked)
            for node in range(len(state)):
                for feature in kinds[kind[node]]:
                    counts[feature][state[node]] += 1
                counts[f"size:{size[node]}"][state[node]] += 1
                above = forest.parent[node]
                counts["root" if above < 0 else f"edge:{forest.edge[node]}:{state[above]}"][state[node]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *(pa.array([float(c[i]) for c in counts.values()], pa.float64()) for i in range(3))],
            ["name", "holds", "main", "other"],
        )

    counted = map_rows(sample, [html_column], count, "name string, holds double, main double, other double")
    # One row for each feature of a bounded number of pages.
    rows = counted.groupBy("name").agg(F.sum("holds"), F.sum("main"), F.sum("other")).collect()
    counts = {row[0]: np.array(row[1:], float) for row in rows}
    share = lambda c: np.log((c + SMOOTHING) / (c + SMOOTHING).sum())
    nothing = np.zeros(3)
    totals = sum((counts.get(f"tag:{t}", nothing) for t in {k[4:] for k in counts if k.startswith("tag:")}), nothing)
    prior = share(totals)
    edges = np.array([[share(counts.get(f"edge:{e}:{s}", nothing)) for s in range(3)] for e in range(OTHER_EDGE + 1)])
    # What a feature says beyond what the states' own shares say.
    features = {name: share(c) - prior for name, c in counts.items() if name.startswith(("tag:", "mark:", "size:"))}
    return Model(share(counts.get("root", nothing)), edges, features)


def page_texts(sources: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    pages = [parse(source) for source in sources]
    if not pages:
        return []
    forest = plant(pages)
    kept = marginals(forest, model)[:, MAIN] > 0.5
    found = []
    for page, start in zip(pages, forest.starts.tolist()):
        parts = [" " if node < 0 else page.text[node] for node in page.flow if node < 0 or kept[start + node]]
        found.append(" ".join("".join(parts).split()))
    return found


def extract(df: DataFrame, model: Model, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``df``: ``page_id``, ``url``, ``text`` and its code points ``n_chars``.

    A null or empty page, or one without main text, gives an empty text. Null ids and urls stay
    null, repeated rows are extracted each, further columns are left out.
    """
    # Plain values: a broadcast class would be looked up by name, on workers that may lack the package.
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 2_000_000):
            texts = page_texts(piece.column(2).to_pylist(), Model(**shared.value))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_rows(df, [id_column, url_column, html_column], run, "page_id long, url string, text string, n_chars long")
