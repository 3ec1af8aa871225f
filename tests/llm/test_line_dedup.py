import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.line_dedup import deleted, line_dedup, patience

from .helpers import clashing, docs, records, sample_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_rises_and_matches(a, b):
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_long_lines_go_wherever_they_stand(a, b):
    assert deleted(a, [9] * len(a), b, 5) == [i for i, x in enumerate(a) if x in b]


def test_short_lines_go_in_blocks_only():
    assert deleted(list("xabcy"), [9, 2, 2, 2, 9], list("abc"), 5) == [1, 2, 3]
    assert deleted(list("xaybz"), [9, 2, 9, 2, 9], list("ab"), 5) == []


def expected(rows, least=5):
    """Lines of enough words stay only in the first document that has them."""
    first = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(line.split()) >= least:
                key = (i is None, i if i is not None else 0)
                first[line] = min(key, first.get(line, key))
    found = []
    for i, t, _ in rows:
        if t is None:
            found.append((i, None))
        else:
            key = (i is None, i if i is not None else 0)
            found.append((i, [x for x in t.split("\n") if len(x.split()) >= least and first[x] == key]))
    return sorted(found, key=repr)


def test_equals_brute_force(spark):
    rows = [r for r in sample_rows() if r[0] != 104]
    shared = "one line of text that many documents share word for word"
    rows += [(300 + k, f"start {k} of its own with five words\n{shared}\nend {k} of it with more words", "s") for k in range(40)]
    rows += [(400, "\n".join([shared] * 12), "s"), (None, shared, "s")]
    found = line_dedup(clashing(docs(spark, rows)))
    got = sorted(((r["doc_id"], None if r["text"] is None else [x for x in r["text"].split("\n") if len(x.split()) >= 5]) for r in found.collect()), key=repr)
    assert got == expected(rows)


def test_clean_documents_stay_as_they_are(spark):
    rows = [(1, "alone with words of its own here\n\nand more", "s"), (2, None, "s"), (3, "", "s"), (4, "a b\nc", "s"), (5, "a b\nd", "s")]
    assert records(line_dedup(docs(spark, rows)), "doc_id", "text") == sorted([(i, t) for i, t, _ in rows], key=repr)
    assert line_dedup(docs(spark, [])).count() == 0


def test_emptied_documents_can_go(spark):
    rows = [(1, "five words are in here", "s"), (2, "five words are in here", "s"), (3, "", "s")]
    assert [r[0] for r in records(line_dedup(docs(spark, rows), drop_emptied=True), "doc_id")] == [1, 3]


def in_common_blocks(later, earlier, least=5):
    """Positions of lines with words in any stretch of `least` words that both have, by trying all."""
    gone = set()
    for i in range(len(later)):
        for j in range(len(earlier)):
            k = 0
            while i + k < len(later) and j + k < len(earlier) and later[i + k] == earlier[j + k]:
                k += 1
            if sum(len(x.split()) for x in later[i : i + k]) >= least:
                gone.update(x for x in range(i, i + k) if later[x].split())
    return gone


def left_of(rows):
    """Lines with words that no earlier document has in a common block."""
    found = []
    for i, t, _ in rows:
        lines = t.split("\n")
        gone = set().union(*(in_common_blocks(lines, u.split("\n")) for j, u, _ in rows if j < i))
        found.append((i, [x for k, x in enumerate(lines) if k not in gone and x.split()]))
    return found


def lines_left(spark, rows):
    found = records(line_dedup(docs(spark, rows)), "doc_id", "text")
    return [(i, [x for x in t.split("\n") if x.split()]) for i, t in sorted(found)]


LICENSE = "all rights reserved by the owner"


def test_blocks_of_short_lines_go(spark):
    verse = "\n".join(f"four words in {k}" for k in range(20))
    rows = [(1, f"a start\n{verse}\nb", "s"), (2, f"c\n{verse}\nan end", "s")]
    assert lines_left(spark, rows)[1] == (2, ["c", "an end"])


def test_a_block_is_found_behind_an_older_holder_of_its_long_line(spark):
    rows = [(1, f"x\n{LICENSE}", "s"), (2, f"y\n{LICENSE}\nhome\nnews\nq", "s"), (3, f"z\n{LICENSE}\nhome\nnews\nr", "s")]
    assert lines_left(spark, rows)[2] == (3, ["z", "r"])


def test_a_repeated_block_goes_each_time():
    chorus = ["two words", "two more", "and two"]
    later = [x for k in range(30) for x in [*chorus, f"verse {k}"]]
    words = [len(x.split()) for x in later]
    assert deleted(later, words, chorus, 5) == [i for i, x in enumerate(later) if x in chorus]
    turned = [x for k in reversed(range(20)) for x in (f"a b {k}", f"c d {k}", f"only here {k}")]
    earlier = [x for k in range(20) for x in (f"a b {k}", f"c d {k}", "")]
    assert deleted(turned, [3] * 60, earlier, 5) == [i for i in range(60) if i % 3 < 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_every_common_block_goes(a, b):
    lines = ["", "a", "b b", "c c c", "d d d d", "e e e e e"]
    later, earlier = [lines[k] for k in a], [lines[k] for k in b]
    gone = deleted(later, [len(x.split()) for x in later], earlier, 5)
    assert {i for i in gone if later[i]} == in_common_blocks(later, earlier)


def test_short_blocks_equal_brute_force(spark):
    rng = random.Random(2)
    lines = ["", LICENSE, "one", "two", "a b", "c d", "e f g", "h i j k", "long line of six words here"]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 7))), "s") for k in range(60)]
    assert lines_left(spark, rows) == left_of(rows)
