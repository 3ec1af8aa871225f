import hashlib
import random
import re
from collections import Counter

import numpy as np

from tessera.llm.weighted_sampling import fingerprints

from .helpers import clashing, docs, sample_rows


def words(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    top = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / top if top else 1.0


def compared(spark, rows):
    """Gaps between likeness and generalised Jaccard similarity of each row to its edited text and to the next."""
    found = {r["doc_id"]: r for r in fingerprints(clashing(docs(spark, rows))).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    gaps = []
    for k, (i, text, _) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1] or ""
        text = text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, want in ((r["near_edited"], jaccard(text, edited)), (r["near_next"], jaccard(text, following))):
            assert 0 <= near <= 1 and (near == 1 or want < 1) and (near <= 1 / 64 or want > 0)  # 16-bit names may agree by chance
            gaps.append((near - want, (want * (1 - want) / 64) ** 0.5))
    same = {}
    for i, text, _ in rows:
        same.setdefault(text or "", set()).add(found[i]["fingerprint"])
    assert all(len(prints) == 1 for prints in same.values())
    gap, spread = np.array([g for g in gaps if g[1]]).T
    # 64 independent samples: unbiased, and as far off as a binomial share is
    assert abs(gap.mean()) < 4 * (spread**2).sum() ** 0.5 / len(gap) + 0.002
    assert 0.85 < (gap**2).mean() ** 0.5 / (spread**2).mean() ** 0.5 < 1.15


def test_likeness_of_made_up_texts(spark):
    rows = list({r[0]: r for r in sample_rows(900, seed=6) if r[0] is not None}.values())
    compared(spark, rows)


def test_likeness_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    compared(spark, [(r["doc_id"], r["text"], r["source"]) for r in table])


def test_likeness_of_short_and_heavy_texts(spark):
    rng = random.Random(4)
    said = ["ärger", "Élan", "漢字", "ñu", "a", "b", "c", "d", "e"]
    short = [(k, " ".join(rng.choices(said, k=rng.randint(3, 9))), "s") for k in range(600)]
    heavy = [(1000 + k, " ".join(w for w in said for _ in range(rng.randint(0, 60))), "s") for k in range(300)]
    compared(spark, short + heavy)


def test_hard_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b c", "s"), (3, "a b c", "s"), (None, "x y z", "s"), (None, None, "s")]
    found = fingerprints(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_next"] == 0
    by = {r["doc_id"]: r for r in found}
    assert by[2]["near_next"] == 1.0 and by[1]["near_next"] == 0.0  # after the last comes the first
    assert fingerprints(docs(spark, [])).count() == 0
    alone = fingerprints(docs(spark, [(9, "one two three", "s")])).collect()[0]
    assert alone["near_next"] == 1.0


def test_plan_has_no_python(spark):
    plan = fingerprints(docs(spark, sample_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
