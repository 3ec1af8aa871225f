"""Main text of HTML pages by a tree-structured graphical model.

Every block of the DOM is a binary variable, content or not. Weights of its
features are its own potential; a table for the pair of groups ties it to its
parent. Sum-product messages go up from the leaves and down from the root and
give each block's marginal. The weights maximise the likelihood of labelled
pages, whose gradient needs the same messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import name, small_batches
from tessera.llm.html_pages import labelled
from tessera.llm.html_tree import Block, blocks

PAGES, SEED, ROUNDS = 160, 11, 45  # labelled pages, their seed and passes over them


def _softplus(x: float) -> float:
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def _key(found: list[Block], k: int) -> str:
    """Which pair table ties block k to its parent."""
    return f"{found[found[k].parent].group}>{found[k].group}"


def messages(found: list[Block], own: dict[str, float], pair: dict[str, tuple[float, float, float, float]]):
    """Log-odds that each block is content, and for each its log-odds without the parent's part, and the parent's without its.

    pair: log potentials of (parent, child) = (0,0), (0,1), (1,0), (1,1); messages
    are differences of logarithms, so that one number stands for each.
    """
    n = len(found)
    up = [sum(own.get(f, 0.0) for f in b.features) for b in found]
    sent = [0.0] * n
    tables = [None] + [pair.get(_key(found, k), (0.0, 0.0, 0.0, 0.0)) for k in range(1, n)]
    for k in range(n - 1, 0, -1):
        t00, t01, t10, t11 = tables[k]
        b = up[k]
        sent[k] = (t10 + _softplus(t11 - t10 + b)) - (t00 + _softplus(t01 - t00 + b))
        up[found[k].parent] += sent[k]
    whole, rest = up[:], [0.0] * n
    for k in range(1, n):
        t00, t01, t10, t11 = tables[k]
        a = rest[k] = whole[found[k].parent] - sent[k]
        whole[k] += (t01 + _softplus(t11 - t01 + a)) - (t00 + _softplus(t10 - t00 + a))
    return whole, up, rest


def train(pages: list[str], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> tuple[dict, dict]:
    """Weights (own, pair) by gradient ascent on the pages' log-likelihood; a block without a label has its parent's."""
    trees = [blocks(p) for p in pages]
    for found in trees:
        for b in found:
            if b.label is None:
                b.label = found[b.parent].label if b.parent >= 0 and found[b.parent].label is not None else 0
    own: dict[str, float] = {}
    pair: dict[str, tuple[float, float, float, float]] = {}
    past: dict = {}

    def step(key, gradient: float) -> float:
        past[key] = past.get(key, 1e-6) + gradient * gradient
        return rate * gradient / past[key] ** 0.5

    for _ in range(rounds):
        slope_own: dict[str, float] = {}
        slope_pair: dict[str, list[float]] = {}
        for found in trees:
            whole, up, rest = messages(found, own, pair)
            for k, b in enumerate(found):
                miss = b.label - 1 / (1 + exp(-max(-40.0, min(40.0, whole[k]))))
                for f in b.features:
                    slope_own[f] = slope_own.get(f, 0.0) + miss
                if k:
                    key = _key(found, k)
                    t = pair.get(key, (0.0, 0.0, 0.0, 0.0))
                    logs = [t[0], t[1] + up[k], t[2] + rest[k], t[3] + up[k] + rest[k]]
                    top = max(logs)
                    odds = [exp(x - top) for x in logs]
                    total = sum(odds)
                    slope = slope_pair.setdefault(key, [0.0] * 4)
                    for i in range(4):
                        slope[i] -= odds[i] / total
                    slope[2 * found[b.parent].label + b.label] += 1
        for f in sorted(slope_own):
            w = own.get(f, 0.0)
            own[f] = w + step(f, slope_own[f] / len(trees) - decay * w)
        for key in sorted(slope_pair):
            w = pair.get(key, (0.0, 0.0, 0.0, 0.0))
            pair[key] = tuple(w[i] + step((key, i), slope_pair[key][i] / len(trees) - decay * w[i]) for i in range(4))
    return own, pair


@cache
def model() -> tuple[dict, dict]:
    """The weights fitted to the seeded training pages; the same on every run."""
    return train(labelled(PAGES, SEED))


def extract(html: str, weights: tuple[dict, dict], least: float = 0.5) -> str:
    """The runs of text in blocks whose content marginal is at least `least`, in page order, one a line."""
    found = blocks(html)
    whole, _, _ = messages(found, *weights)
    limit = float(np.log(least / (1 - least)))
    runs = [run for b, odds in zip(found, whole, strict=True) if odds >= limit for run in b.runs]
    return "\n".join(text for _, text in sorted(runs))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages, in one pass and without a shuffle.

    Null, empty and blank html, and pages without content, give an empty text.
    Ids and urls may be null or repeat; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    weights = model()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    picked = pages.select(name(id_col).alias("page_id"), name(url_col).alias("url"), name(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
