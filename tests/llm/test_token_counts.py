import pytest

from kinweave.llm import token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
ODD = ["a  b", "a \n b", " a", "a ", "a  ", "\n a \n", "x\t y", "x \ty", "<|endoftext|> a", "a<|endoftext|>b", "é  b", "a  b", "a\x85 b \x1f c", "日本 語 。", "don't we're", "x" * 5000, "\U0001f600 \U0001f600"]


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(docs, prose):
    texts = ODD + [prose(i, 60) for i in range(30)]
    rows = list(enumerate(texts)) + [(900, None), (901, "")]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(rows), PATH).collect()}
    for i, n in enumerate(library(texts)):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(texts[i].encode()), n > 1024)
    assert [(got[k]["n_bytes"], got[k]["n_tokens"]) for k in (900, 901)] == [(0, 0)] * 2


def test_tiers_agree_when_the_cache_is_tiny(prose):
    texts = [prose(i, 50) for i in range(20)]
    for frequent, limit in (({}, 1), (dict.fromkeys([], 0), 10_000)):
        count = token_counts.Counting(PATH, frequent, ["<|endoftext|>"], limit)
        assert [count(t) for t in texts] == library(texts)


def test_empty_table_repeated_rows_and_other_columns(docs):
    assert token_counts.count_tokens(docs([]), PATH).collect() == []
    twice = docs([(1, "a b"), (1, "a b")]).selectExpr("*", "3 AS n_tokens")
    assert [r["n_tokens"] for r in token_counts.count_tokens(twice, PATH).collect()] == library(["a b"] * 2)
