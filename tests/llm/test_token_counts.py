import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from textloom.llm.common import table
from textloom.llm.token_counts import _runs, counter, n_bytes, safe_pieces, token_counts, vocabulary

VOCAB = vocabulary()
WHOLE = Tokenizer.from_str(VOCAB)
COUNT = counter(VOCAB)


def slow(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("rows", [None, []])
def test_edges(spark, rows):
    docs = cases.docs(spark, rows)
    got = sorted((tuple(r) for r in token_counts(docs, VOCAB, 5).collect()), key=repr)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), n := slow(r.text), n > 5) for r in docs.collect()), key=repr)


def test_whole_table(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, VOCAB).collect()} == {r.doc_id: slow(r.text) for r in docs.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB9é'sll!.,-_ \n\t 　​<|endoftext|>中İ́😀", max_size=80))
def test_any_text(text):
    assert COUNT([text, text + " " + text]) == [slow(text), slow(text + " " + text)]
    assert "".join(safe_pieces(text)) == text


def test_long_texts_are_cut_at_safe_places():
    text = ("word, it's 12  spaced\n\n line <|endoftext|> é à " * 400) + "x" * 3000
    assert counter(VOCAB, batch_bytes=500)([text, "", text[:100]]) == [slow(text), 0, slow(text[:100])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB9é'sll!.,-_| \n　<中文。，İ́😀", max_size=60), st.sampled_from(["", "<|endoftext|>"]), st.integers(1, 12))
def test_runs_of_any_text(text, special, size):
    text = text + special + text
    runs = list(_runs(text, size, ["<|endoftext|>"]))
    assert "".join(runs) == text and sum(map(slow, runs)) == slow(text)


def test_texts_without_spaces_are_cut():
    for text in ("aGVsbG8gd29ybGQ0" * 3000, "中文字符，很长的文章。" * 3000):
        runs = list(_runs(text, 1000))
        assert max(map(n_bytes, runs)) < 1100 and counter(VOCAB, batch_bytes=1000)([text]) == [slow(text)]


def test_memo_is_bounded():
    few = counter(VOCAB, memo=10)
    texts = [" ".join(f"w{i * j % 101}" for j in range(30)) for i in range(40)]
    assert [few([t])[0] for t in texts] == [slow(t) for t in texts]
