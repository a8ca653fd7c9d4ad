import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.llm import repeats
from wireloom.llm.common import table
from wireloom.llm.deep_shallow import intervals, lcp, sort_strings


def brute(rows):
    """doc_id and text -> the rows that are wanted, by counting every string."""
    n, raws = repeats.LENGTH, [(i, (t or "").encode()) for i, t in rows]
    starts = defaultdict(int)
    for _, raw in raws:
        for p in range(len(raw) - n + 1):
            starts[hashlib.blake2b(raw[p : p + n], digest_size=12).digest()] += 1
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - n + 1):
            if starts[hashlib.blake2b(raw[p : p + n], digest_size=12).digest()] > 1:
                gone[p : p + n] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        out.append((-1 if i is None else i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 9))) for _ in range(n))


def made_up(seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.choice([60, 80, 100, 200])) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [rng.choice([prose(rng, rng.randint(1, 120)), rng.choice(shared), (s := rng.choice(shared))[rng.randint(0, 90) : len(s) - rng.randint(0, 90)]]) for _ in range(rng.randint(1, 5))]
        out.append(rng.choice(["", " ", "\0"]).join(parts))
    return out + [out[0], out[1] + "x", "y" + out[2], "ab" * 450, "ab" * 300 + "c" + "ba" * 210, "z" * 1200, "z" * 401, "q" * 400, "abc" * 134 + "\0", "abc" * 134]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_made_up_texts(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rows = list(enumerate(made_up(bucket)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(docs, keep_text=False)) == brute(rows)


def test_without_broadcasts_and_with_bytes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_ITEMS", -1)
    rows = list(enumerate(made_up(9)))
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())


def test_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert got(repeats.op8_repeats(spark, sf)) == brute(rows)


def test_edges(spark):
    p = "0123456789" * 45
    rows = [(1, None, 0), (2, "", 0), (None, p + "!", 0), (3, p + "?", 0), (4, "short", 0), (4, "short", 0), (5, "x" + p, 1), (5, "x" + p, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    assert got(repeats.remove_repeats(docs)) == brute([(i, t) for i, t, _ in rows])
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: (b"a" * 70 + b).ljust(96, b"\0")), max_size=25))
def test_sorted_with_prefixes(strings):
    order, prefixes = sort_strings(strings, 96)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for p, a, b in zip(prefixes[1:], order, order[1:]):
        assert p == next((k for k in range(96) if strings[a][k] != strings[b][k]), 96)
    for depth, first, last in intervals(prefixes, 1) if strings else []:
        assert last > first and min(prefixes[first + 1 : last + 1]) == depth


def test_lcp():
    assert lcp(int.from_bytes(b"abc", "big"), int.from_bytes(b"abd", "big"), 3) == 2


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40), st.binary(max_size=40), st.binary(max_size=40), st.integers(0, 336), st.integers(0, 400))
def test_two_contexts_as_three(a, b, c, d, left, right):
    middle = bytes(i % 251 for i in range(left)), bytes(i % 241 for i in range(64 + right))
    contexts = []
    for before, after in ((a, b), (c, d)):
        l_, r_ = (before + middle[0])[-repeats.LEFT :], (middle[1] + after)[: repeats.LENGTH]
        contexts.append((l_ + r_, len(l_), len(r_)))
    # a third one that has nothing in common with them sends the two through the sorting
    other = (b"\xff" * 500, 200, 300)
    assert repeats.covered(contexts) == repeats.covered([*contexts, other])[:2]
