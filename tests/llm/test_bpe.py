import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wireloom.llm import bpe
from wireloom.llm.common import table
from wireloom.llm.transducer import Transducer, compile_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(PATH)
codec = bpe.Codec(open(PATH, encoding="utf-8").read())


def encode(text):
    out = []
    for part, special in codec.segments(text):
        out += [special] if special is not None else [i for w in bpe.split_words(part) for i in codec.merge(w.encode())]
    return out


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_merges_as_the_library(text):
    assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_words_split_as_the_library_on_every_code_point():
    cps = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    off = []
    for at in range(0, len(cps), 64):
        text = "".join(f"a{c} {c}1{c}{c} " for c in cps[at : at + 64])
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        if bpe.split_words(text) != want:
            off += [c for c in cps[at : at + 64] if bpe.split_words(t := f"a{c} {c}1{c}{c} ") != [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]]
    assert not off, [hex(ord(c)) for c in off[:50]]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=60), st.binary(max_size=6))
def test_transducer(words, other):
    entries = {w: [len(w), *w] for w in words}
    t = Transducer(compile_words(entries))
    assert all(t.lookup(w) == ids for w, ids in entries.items())
    assert t.lookup(other) == entries.get(other)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcehtinos éß", max_size=80))
def test_both_merges_agree(text):
    ids = [codec.base[b] for b in text.encode()]
    assert codec._merge_short(list(ids)) == codec._merge_long(list(ids))


def test_every_low_code_point_splits_alike():
    for a in range(0x250):
        for text in (f"x{chr(a)}1{chr(a)} {chr(a)}{chr(a)}!", f"'s{chr(a)}'ll {chr(a)}"):
            assert bpe._LATIN.findall(text) == bpe.word_pattern().findall(text)


def test_suffixes_are_shared():
    t = Transducer(compile_words({p + b"ation": [i] for i, p in enumerate([b"n", b"st", b"rel", b"cre"])}))
    assert t.states < 16
    with pytest.raises(ValueError):
        Transducer(b"none")


def test_against_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in bpe.op9_bpe(spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_edges(spark):
    texts = [None, "", "a<|endoftext|> b", "x" * 100_000, " \n\t  é漢🙂 ", "it's  12", "same", "same"]
    rows = [(i if i != 4 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode_documents(docs, PATH, bpe.frequent_lexicon(docs, PATH)).collect()
    assert [r.ids for r in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    back = bpe.decode_ids(spark.createDataFrame([(r.doc_id, r.ids) for r in got] + [(1, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert [r.text for r in back] == [t or "" for t in texts] + [None]
    empty = docs.limit(0)
    assert bpe.encode_documents(empty, PATH, bpe.frequent_lexicon(empty, PATH)).count() == 0
