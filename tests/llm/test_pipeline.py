from collections import Counter

import corpus_pipeline
from tessera.functions.session import table, written
from tessera.llm.quality import quality

from .test_line_dedup import expected
from .test_mixing import plain_mix
from .test_near_copies import plain_heads

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_equal_brute_force(spark):
    docs = table(spark, DIR, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], DIR), name.replace(" ", "-")))
    rated, lines, near, drawn, packed = steps[1:]
    assert all(s.columns == docs.columns for s in steps[1:-1])

    keeps = {r["doc_id"] for r in quality(docs, table(spark, DIR, "labels")).collect() if r["kept"]}
    assert {r[0] for r in rows_of(rated)} == keeps and len(keeps) > 100

    want = {i: x for i, x in expected(rows_of(rated))}
    got = {i: [x for x in t.split("\n") if len(x.split()) >= 5] for i, t, _ in rows_of(lines)}
    assert all(want[i] == x for i, x in got.items())
    assert all(not want[i] for i in want if i not in got)

    assert sorted(r[0] for r in rows_of(near)) == sorted(plain_heads(rows_of(lines)))

    taken = Counter()
    for i, t, _ in rows_of(drawn):
        taken[i] += len(t.split())
    # the document at the cut is taken whole or not at all
    whole = {i: size * (words // size + (2 * (words % size) >= size)) for i, size, _, _, words in plain_mix(rows_of(near)) if size}
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in whole.items() if n}

    by = {}
    for r in packed.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 4096
    assert Counter(r[0] for r in rows_of(drawn)) == Counter(r["doc_id"] for r in packed.filter("piece = 0").collect())
    assert sum(n for s in by.values() for _, n in s) == sum(r["length"] for r in packed.collect())
