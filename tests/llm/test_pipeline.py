import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from reference_spans import secrets
from test_jaccard_join import brute
from test_mixing import targets
from tokenizers import Tokenizer

import corpus_pipeline as cp
from wireloom.llm.common import materialize, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, f in cp.STAGES:
        out.append((docs, docs := materialize(f(spark, docs, sf), "test")))
    return out


def rows(df):
    return df.collect()


def test_columns(stages, spark, sf):
    for _, out in stages[:-1]:
        assert out.columns == table(spark, sf, "documents").columns


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    ids = {r.doc_id: r for r in rows(before)}
    kept = {r.doc_id: r for r in rows(after)}
    assert len(kept) >= 0.97 * len(ids)
    assert all(kept[i].text == ids[i].text for i in kept)
    assert sum(kept[i].lang == ids[i].lang for i in kept) >= 0.97 * len(kept)


def test_one_of_each_group(stages):
    before, after = stages[1]
    want = brute([(r.doc_id, r.text) for r in rows(before)], 5, 80)
    assert {r.doc_id for r in rows(after)} == {i for i, (_, c) in want.items() if i == c}


def test_secrets_go(stages):
    before, after = stages[2]
    texts = {r.doc_id: r.text for r in rows(after)}
    for r in rows(before):
        spans, at, out = sorted((a, b) for a, _, b in secrets(r.text)), 0, ""
        for a, b in spans:
            if a >= at:
                out += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        assert texts[r.doc_id] == out + r.text[at:]


def test_mixture_meets_its_targets(stages):
    before, after = stages[3]
    size = {r.doc_id: len(r.text.split()) for r in rows(before)}
    source = {r.doc_id: r.source for r in rows(before)}
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in rows(after))
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += n * times[i]
    want = targets(dict(sizes))
    assert max(times.values()) <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s)


def test_ids_as_the_library(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in rows(before))
    got = sorted((r.doc_id, list(r.ids)) for r in rows(after))
    assert got == want
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows(after))


def test_run(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(cp.run(spark, sf)) == key(stages[-1][1])


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, found string"


def odd_documents(spark, sf):
    """Rows with nulls, empty and very long texts, repeats and clashing names, among clean ones to learn a language from."""
    clean = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "i", 1, "k", None) for r in table(spark, sf, "documents").where("doc_id < 60").collect()]
    text = next(t for _, t, lang, *_ in clean if lang == "en" and len(t) > 500)
    odd = [(None, text, "en", "web", None, None, None, None, None), (None, text + " secret=zyxwvutsrqponml", None, None, 3, "", 0, "", "x"), (None, None, None, None, None, None, None, None, None), (900, "", "en", "", 0, "", 0, "", ""),
           (901, text[:300], "en", "web", 300, "a", 1, "b", "c"), (901, text[:300], "en", "web", 300, "a", 1, "b", "c"), (901, text[200:500] + " token: abcdefghijklmnop", "en", "web", 1, "a", 2, "b", "c"), (902, (text + " ") * 300, "en", "web", 5, "z", 3, "z", "z")]
    return spark.createDataFrame(clean + odd, ODD), odd


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, sf, k):
    docs, odd = odd_documents(spark, sf)
    out = cp.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, want = rows(out), Counter(map(tuple, rows(docs)))
    texts = Counter((r.doc_id, r.text) for r in got)
    if cp.STAGES[k][0] == "secret scans":
        assert len(got) == sum(want.values()) and not any("zyxwv" in (t or "") or "abcdefghijklmnop" in (t or "") for _, t in texts)
        assert {(None, odd[0][1]), (None, None), (900, "")} <= set(texts) and texts[901, odd[4][1]] == 2
        assert all(r.n_chars == len(r.text) for r in got if "[SECRET]" in (r.text or ""))
        return
    plain = Counter((i, t) for (i, t, *_), n in want.items() for _ in range(n))
    assert set(texts) <= set(plain)
    if cp.STAGES[k][0] == "language ID":
        assert not [t for _, t in texts if not t] and texts[901, odd[4][1]] == 2 and texts[None, odd[0][1]] == 1
    elif cp.STAGES[k][0] == "n-gram Jaccard join":
        assert texts[None, None] == 1 and texts[900, ""] == 1 and sum(n for (i, _), n in texts.items() if i == 901) <= 1 and texts[None, odd[0][1]] == 1
    else:
        assert not [t for _, t in texts if not t] and all(n <= 2 * plain[key] for key, n in texts.items())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, sf, k):
    empty = table(spark, sf, "documents").limit(0)
    out = cp.STAGES[k][1](spark, empty, sf)
    assert out.count() == 0 and (k == 4 or out.columns == empty.columns)
