import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.llm.common import table
from wireloom.llm.token_counts import count_tokens, op3_token_counts, pre_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\t▁é漢<s>/x00", max_size=60))
def test_pre_tokens_add_up(text):
    assert sum(len(sp.encode(x[1:])) if x != " " else 1 for x in pre_tokens(text)) == len(sp.encode(text))


def test_against_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in op3_token_counts(spark, sf).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a  b ", "x"), (6, "  ", ""), (3, "<s> a </s> " * 3000, "x"), (3, "same", None), (3, "same", None), (4, "y" * 200_000, "")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, len(sp.encode(t or ""))) for i, t, _ in rows]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_pre_tokens_are_joined_by_broadcast_or_shuffle(spark, monkeypatch):
    from wireloom.llm import token_counts as tc

    texts = ["the cat  sat", "the the the dog", "a\nb the cat", "x" * 100, None, "x" * 100 + " the"] * 3
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    for broadcast in (0, 64 * 1, 131_072):
        monkeypatch.setattr(tc, "BROADCAST_TOKENS", broadcast)
        frequent = [r.token for r in tc.frequent_tokens(docs).collect()]
        assert len(frequent) == len(set(frequent)) <= broadcast and set(frequent) <= {x for t in texts for x in pre_tokens(t or "")}
        assert sorted(r.n_tokens for r in count_tokens(docs, MODEL).collect()) == sorted(len(sp.encode(t or "")) for t in texts)


def test_a_pre_token_is_cut_once(spark):
    from wireloom.llm import token_counts as tc

    rows = [(i, f" w{i % 7}", 1 + i % 3) for i in range(3000)]
    got = {r.row: r.rest for r in tc._joined_counts(spark.createDataFrame(rows, "row long, token string, n long"), MODEL).collect()}
    assert got == {i: n * len(sp.encode(t[1:])) for i, t, n in rows}
