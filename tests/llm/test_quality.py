import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.quality import COUNTS, kept, quality, repeated_words
from tessera.llm.trees import fit

from .helpers import clashing, docs, sample_rows


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + j for k in range(len(words) - 7) for j in range(8) if windows[tuple(words[k : k + 8])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_repeated_windows(ids):
    windows = Counter(tuple(ids[k : k + 8]) for k in range(len(ids) - 7))
    hit = {k + j for k in range(len(ids) - 7) for j in range(8) if windows[tuple(ids[k : k + 8])] > 1}
    assert repeated_words(np.array(ids, dtype=np.int64), 3) == len(hit)
    assert repeated_words(np.array(ids, dtype=np.int64), 10**6) == len(hit)


def labelled(spark):
    """Good texts and shouting ones with their labels."""
    rows = [(k, "plain words of a calm text that goes on for a while " * (2 + k % 3) + " ".join(f"w{k}x{j}" for j in range(40)), "s") for k in range(40)]
    rows += [(100 + k, " ".join(f"W{k}X{j}!! ###" for j in range(40)), "s") for k in range(40)]
    labels = [(i, int(i < 100), 0) for i, _, _ in rows] + [(None, 1, 0), (3, None, 0), (999, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_and_verdicts(spark):
    rows, labels = labelled(spark)
    rows += sample_rows()[-12:] + [(300, "## dup\nx\nx\n \n\nx\n" + "a b c d e f g h " * 4, "s")]
    found = quality(clashing(docs(spark, rows)).drop(*COUNTS), labels).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in COUNTS)) for r in found), key=repr)
    assert got == sorted(((i, *plain_counts(t)) for i, t, _ in rows), key=repr)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 140 and r["n_words"] > 20 and r["n_symbols"] > 50:
            assert not r["kept"]


def test_kept_rows_are_unchanged(spark):
    rows, labels = labelled(spark)
    df = clashing(docs(spark, rows))
    stays = kept(df, labels)
    assert stays.columns == df.columns
    assert {r["doc_id"] for r in stays.collect()} <= {i for i, _, _ in rows if i < 100}
    assert kept(docs(spark, []), labels).count() == 0


def test_without_labels_base_limits_decide(spark):
    rows, labels = labelled(spark)
    found = quality(docs(spark, rows), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


def test_monotone_and_held_out_accuracy():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + 0.1 * rng.standard_normal(3000) < 0.6).astype(int)
    forest = fit(x[:2000], y[:2000], np.array([-1, 0, 0]))
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
    assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    again = fit(x[:2000], y[:2000], np.array([-1, 0, 0]))
    assert np.array_equal(again.score(x), forest.score(x))
