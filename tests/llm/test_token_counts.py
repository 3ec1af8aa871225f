import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.token_counts import _Counts, merged_count, token_counts

from .helpers import clashing, docs, records, sample_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return _Counts(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    text = text.encode("utf-8", "ignore").decode()
    assert both[0].of(text) == len(both[1].encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "I'LL", "9", "!", "<|endoftext|>", "é", " ", "the", "\x1c", "\x85"]), max_size=20))
def test_odd_mixtures(both, parts):
    text = "".join(parts)
    assert both[0].of(text) == len(both[1].encode(text, add_special_tokens=False).ids)


def test_long_runs(both):
    for text in ("a" * 20_000, " " * 5000 + "x", "ab" * 5000, "\n" * 3000):
        assert both[0].of(text) == len(both[1].encode(text, add_special_tokens=False).ids)


def test_lowest_rank_goes_first():
    assert merged_count(list("abc"), {("b", "c"): 0, ("a", "b"): 1}) == 2
    assert merged_count(list("aaaa"), {("a", "a"): 0, ("aa", "aa"): 1}) == 1
    assert merged_count([], {}) == 0


def test_table(spark, both):
    rows = sample_rows()
    found = records(token_counts(clashing(docs(spark, rows)), PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, t, _ in rows:
        n = len(both[1].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert found == sorted(want, key=repr)
    assert token_counts(docs(spark, []), PATH).count() == 0


def test_small_memory(both):
    few = _Counts(PATH)
    few.most = few.pieces.most = 5
    for text in ["one two three four five six seven eight nine ten", "one two eleven twelve one two"]:
        assert few.of(text) == both[0].of(text)
    assert json.load(open(PATH))["model"]["type"] == "BPE"
