"""Tree encoding against encoding at once."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.llm.bpe import Tree, encode

CHARS = "abcAB'sré ñ\n\t  1%$ 　\x85\x1c"
TREES = {(v, leaf, long): Tree(v, leaf=leaf, long=long) for v in ("byte_bpe_50k", "byte_bpe_multi_50k") for leaf, long in ((4, 3), (17, 8))}


@pytest.mark.parametrize("key", list(TREES))
@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(CHARS, max_size=80), st.text(max_size=60), st.text("ab", max_size=200), st.text("theinrgaon", max_size=200)))
def test_tree_is_direct_encoding(key, text):
    tree = TREES[key]
    ids = np.frombuffer(tree.encode(text), tree.dtype).tolist()
    assert ids == tree.words.encoding.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


def test_long_run_of_letters():
    tree = Tree()
    for text in ("漢字" * 9000, "é" * 9000 + "ab1" * 5000, "12345" * 4000, "!?" * 8000, " " * 20_000 + "x" + "\n" * 9000, "ab" * 9000 + "'s" * 900, "\u3000" * 5000 + "語" * 5000, "a" * 50_000, "theontion" * 4000, "x " + "Wq" * 9000 + "\n\ny"):
        assert np.frombuffer(tree.encode(text), tree.dtype).tolist() == tree.words.encoding.encode_ordinary(text)


def test_cases(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "x"), (3, None), (4, ""), (5, "wort " * 60_000)]
    got = {(r.doc_id, r.n_tokens): r for r in encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(1 for _ in encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 6
    assert all(r.round_trip and len(r.tokens) == r.n_tokens for r in got.values())
    assert (3, 0) in got and (4, 0) in got
    odd = spark.createDataFrame([("a-1", "x y", 1, True), ("7", None, 2, False)], "doc_id string, text string, n_tokens int, round_trip boolean")
    assert sorted((str(r.doc_id), r.n_tokens, r.round_trip) for r in encode(odd).collect()) == [("7", 0, True), ("None", 2, True)]
    assert encode(spark.createDataFrame([], "doc_id long, text string, tokens int")).collect() == []
