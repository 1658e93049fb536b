"""Main texts of pages: boosted trees over DOM nodes, decoded down the hierarchy.

Every node of a page, element or text run, gets the log-odds that main text lies in
it. A kept node needs a kept parent, so the page's best choice is found from the
leaves up: a node's gain is its own log-odds and the gains of those children that
have any. From the root down, nodes with a gain below kept parents stay. So neither
a text inside a menu nor an article above kept paragraphs can contradict the rest.

The trees are trained on invented layouts (``page_layouts``); they lie beside this
module. ``python -m strandmill.llm.extraction`` trains them anew.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandmill.llm import boosting, dom, page_layouts
from strandmill.llm.common import numbered, restored, ship_library, tidy

MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "extraction_trees.npz")
#: Pages whose nodes are scored together, and bytes of their markup at most.
PAGES_EACH, BYTES_EACH = 200, 1 << 20
_OWN_KINDS = [dom.KINDS.index(k) for k in dom.KINDS if k != "root"]
_ABOVE_KINDS = [dom.KINDS.index(k) for k in ("article", "main", "nav", "header", "footer", "aside", "form", "item", "cell", "quote")]


def node_features(pages: list[dom.Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, and the place of each page's root.

    Own and inherited kinds and attribute words, depth, sibling statistics, density of
    words, links and stops in the subtree, and shares of the parent's and page's text.
    """
    sizes = np.array([len(p.parent) for p in pages])
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(pages) else np.zeros(0, int)
    base = np.repeat(roots, sizes)
    joined = lambda name: np.fromiter(itertools.chain.from_iterable(getattr(p, name) for p in pages), np.int64)
    total = len(base)
    at = np.arange(total)
    parent = joined("parent")
    is_root = parent < 0
    parent = np.where(is_root, at, parent + base)
    end = joined("end") + base
    kind, above_kinds, groups, above_groups = joined("kind"), joined("above_kinds"), joined("groups"), joined("above_groups")
    texts = [t for p in pages for t in p.texts]
    leaf = np.array([t is not None for t in texts])
    counts = np.array([(len(t), t.count(" ") + 1, t.count(". ") + t.count(", ") + t.endswith((".", "!", "?"))) if t is not None else (0, 0, 0) for t in texts], dtype=np.float64).reshape(total, 3)
    own = np.column_stack([counts, joined("linked"), leaf])
    sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    below = sums[end] - sums[at]
    whole, up = below[base], below[parent]
    before = (sums[at] - sums[base])[:, 0]
    depth = joined("depth")
    children = np.bincount(parent[~is_root], minlength=total)
    # Places among siblings: in document order within a parent.
    order = np.argsort(parent + is_root * total, kind="stable")
    sorted_parent = (parent + is_root * total)[order]
    fresh = np.concatenate([[True], sorted_parent[1:] != sorted_parent[:-1]]) if total else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, at, 0)) if total else at
    place = np.empty(total)
    place[order] = at - first
    left, right = np.full(total, -1), np.full(total, -1)
    left[order[1:]] = np.where(fresh[1:], -1, order[:-1])
    right[order[:-1]] = np.where(fresh[1:], -1, order[1:])
    alike = np.bincount(parent * len(dom.KINDS) + kind, weights=~is_root, minlength=total * len(dom.KINDS))
    word_density = below[:, 1] / np.maximum(below[:, 4], 1)
    link_share = below[:, 3] / np.maximum(below[:, 0], 1)
    stop_share = below[:, 2] / np.maximum(below[:, 1], 1)
    neighbour = lambda values, of: np.where(of >= 0, values[of], -1.0)
    columns = [
        leaf, depth, place, children, np.log1p(children[parent]), alike[parent * len(dom.KINDS) + kind] / np.maximum(children[parent], 1), joined("level"),
        np.log1p(below[:, 0]), np.log1p(below[:, 1]), np.log1p(below[:, 4]), np.log1p(word_density), link_share, stop_share,
        below[:, 0] / np.maximum(up[:, 0], 1), below[:, 0] / np.maximum(whole[:, 0], 1), before / np.maximum(whole[:, 0], 1), np.log1p(whole[:, 0]),
        link_share[parent], np.log1p(word_density[parent]), stop_share[parent], link_share[parent[parent]], np.log1p(word_density[parent[parent]]),
        neighbour(np.log1p(word_density), left), neighbour(np.log1p(word_density), right), neighbour(link_share, left), neighbour(link_share, right),
        neighbour(kind, left), neighbour(kind, right),
        *[kind == k for k in _OWN_KINDS], *[(above_kinds >> k) & 1 for k in _ABOVE_KINDS],
        *[(groups >> g) & 1 for g in range(len(dom.GROUPS))], *[(above_groups >> g) & 1 for g in range(len(dom.GROUPS))],
    ]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1) if total else np.zeros((0, len(columns)), np.float32), roots


def decoded(page: dom.Page, log_odds: list[float]) -> list[bool]:
    """The best choice of nodes in which every kept node has a kept parent."""
    n = len(page.parent)
    gain = list(log_odds)
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    kept = [False] * n
    for i in range(n):
        kept[i] = gain[i] > 0 and (i == 0 or kept[page.parent[i]])
    return kept


class Extractor:
    """Main texts of pages by a fitted model."""

    def __init__(self, trees: boosting.Trees) -> None:
        self.trees = trees

    def __call__(self, markups: list[str]) -> list[str]:
        pages = [dom.parse(markup) for markup in markups]
        x, roots = node_features(pages)
        scores = self.trees.log_odds(x).astype(float).tolist() if len(x) else []
        out = []
        for page, root in zip(pages, roots.tolist(), strict=True):
            kept = decoded(page, scores[root : root + len(page.parent)])
            out.append(" ".join(t for t, k in zip(page.texts, kept, strict=True) if k and t is not None))
        return out


@functools.cache
def trained() -> Extractor:
    """The model that lies beside this module."""
    return Extractor(boosting.Trees.load(MODEL))


def examples(seeds: range) -> tuple[list[dom.Page], list[np.ndarray], list[str]]:
    """Invented pages without their marks, whether nodes hold main text, and the main texts."""
    pages, labels, wanted = [], [], []
    for seed in seeds:
        page = dom.parse(page_layouts.Layout(seed).page())
        marked = [t is not None and page_layouts.MARK in t for t in page.texts]
        page.texts = [t if t is None else t.replace(page_layouts.MARK, "") for t in page.texts]
        ahead = np.concatenate([[0], np.cumsum(marked)])
        labels.append(ahead[np.array(page.end)] > ahead[:-1])
        pages.append(page)
        wanted.append(" ".join(t for t, m in zip(page.texts, marked, strict=True) if m))
    return pages, labels, wanted


def train(pages: int = 6000, trees: int = 90) -> boosting.Trees:
    """Trees fitted to invented pages; a page's nodes weigh as much as another's."""
    found, labels, _ = examples(range(pages))
    x, _ = node_features(found)
    weight = np.concatenate([np.full(len(y), 20 / np.sqrt(20 * len(y))) for y in labels])
    return boosting.boost(x, np.concatenate(labels).astype(float), trees=trees, weight=weight)


def main_texts(pages: DataFrame, column: str = "html", carry: list[str] | None = None, extractor: Extractor | None = None) -> DataFrame:
    """``carry`` columns (all but the markup by default), then ``text`` and ``n_chars`` of each page.

    The whole markup is read; a null one is empty, and a page without main text has an
    empty text and 0 code points. Bytes that are no UTF-8 become U+FFFD. White space
    inside a block is one space, blocks are joined by one, in page order. Repeated rows
    have the same text. Columns called text or n_chars are not handed on unless they
    are named in ``carry``, where they precede the results of the same name.
    """
    spark = pages.sparkSession
    ship_library(spark)
    carry = [c for c in pages.columns if c not in (column, "text", "n_chars")] if carry is None else carry
    own = numbered(carry)
    rows = pages.select(*own, F.col(column).cast("binary").alias("_sm_html"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor or trained()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(len(kept))).fill_null(0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                bound = BYTES_EACH + (sizes[at - 1] if at else 0)
                until = min(max(at + 1, int(np.searchsorted(sizes, bound))), at + PAGES_EACH, batch.num_rows)
                part = batch.slice(at, until - at)
                texts = extract([(m or b"").decode("utf-8", "replace") for m in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])
                at = until

    schema = StructType([*rows.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())])
    return restored(rows.mapInArrow(tidy(run), schema), carry)


if __name__ == "__main__":
    train().save(MODEL)
