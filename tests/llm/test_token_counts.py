import base64

import pytest
from hypothesis import given, settings, strategies as st
from llm_odd import documents, empty, frame, split_words

from tiltmeter.llm import token_counts as T


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        k = next((k for k in range(len(word), at, -1) if word[at:k] in vocabulary), None)
        if k is None:
            return -1
        n, at = n + 1, k
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab c", min_size=1, max_size=5), min_size=1, max_size=14), st.lists(st.text("ab c", max_size=14), max_size=12))
def test_automaton_equals_greedy_search(vocabulary, found):
    tokens = {v.encode() for v in vocabulary}
    automaton = T.Automaton.build(sorted(tokens))
    for w in found:
        assert automaton.count(w.encode()) == greedy(w.encode(), tokens)


def test_whole_texts(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    vocabulary = set(T.read_vocabulary(path))
    rows = [r for r in documents() if len(r[1] or "") < 5000]
    got = T.token_counts(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        each = [greedy(b" " + w, vocabulary) for w in split_words(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(max(n, 1) for n in each), 0)


def test_unknown_words(spark, tmp_path):
    path = tmp_path / "few.ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([b" a", b"a", b"b", b"ab", b" ab"])))
    got = T.token_counts(spark.createDataFrame([(1, "ab abab xa a b"), (2, None), (3, " \n"), (4, "x" * 100_000)], "doc_id bigint, text string"), str(path)).collect()
    # " ab" 1, " ab"+"ab" 2, " xa" unknown, " a" 1, " b" unknown: a blank alone is no token here
    assert {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in got} == {1: (5, 6, 2), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 1)}


def test_empty_table(spark, tmp_path):
    path = tmp_path / "few.ranks"
    path.write_text(f"{base64.b64encode(b'a').decode()} 0\n")
    assert T.token_counts(empty(spark), str(path)).count() == 0
