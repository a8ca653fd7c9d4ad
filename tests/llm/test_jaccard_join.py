import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.llm import jaccard_join as jj
from wireloom.llm.common import table
from wireloom.llm.components import components
from wireloom.llm.shingles import Bands, fold, mix, parity_sketch, shingle_hashes


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent):
    """doc_id -> (n, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    where, root = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed, n=12, copies=14):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([2, 4, 9, 30, 80, 200, 600]))]
        for _ in range(copies):
            words = list(rng.choice([base, out[-1].split() if out else base]))
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 5000)}"
            out.append(" ".join(words[: len(words) - rng.randint(0, len(words) // 20)]))
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_families(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 5)
    rows = families(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(rows, k, percent)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.op4_jaccard(spark, sf).collect()}
    assert got == brute(rows, 3, 90)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None, 1), (6, "", 1), (7, " \t\n", 1), (8, "A b", 1), (3, "a B", 1), (9, "a b", 1), (None, "a b", 1), (2, long, 1), (11, long + " end", 1), (12, "q r s t", 1), (12, "q r s t", 2), (13, "É b c", 1), (14, "é b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jj.jaccard_components(docs).collect())
    want = brute([(i, t) for i, t, _ in rows if i is not None], 3, 90)
    assert got == sorted([((False, i), *want[i]) for i, _, _ in rows if i is not None] + [((True, 0), 1, None)])
    assert jj.jaccard_components(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(i, t, "s") for i, t in families(7)] + [(None, "kept", "s"), (500, None, "s"), (501, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i for i, (_, c) in brute([(i, t) for i, t, _ in rows if i is not None], 5, 80).items() if i == c}
    out = jj.one_of_each(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want | {None}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([50, 80, 90, 95]), st.integers(0, 1 << 30))
def test_linked_sets_share_a_key(common, a, b, percent, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, common + a + b).astype(np.uint64))
    rng.shuffle(h)
    x, y = np.sort(h[: common + a]), np.sort(np.concatenate((h[:common], h[common + a :])))
    bands = Bands(percent)
    if jj.linked(common, len(x), len(y), percent) and not np.array_equal(x, y):
        assert len(np.intersect1d(bands.keys(x), bands.keys(y)))
    p, q = parity_sketch(x, 256), parity_sketch(y, 512)
    assert np.array_equal(fold(q, 4), parity_sketch(y, 256))
    assert np.bitwise_count(p ^ fold(q, 4)).sum() <= len(x) + len(y) - 2 * common


def test_empty_sets_and_mix():
    assert len(shingle_hashes(None, 3)) == len(shingle_hashes(" ", 3)) == 0
    x = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(mix(x))) == 1000


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def test_one_of_each_of_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(40)]
    text = " ".join(base)
    near = " ".join([*base[:-1], "other"])
    rows = [(5, text, "a"), (3, near, "b"), (3, near, "b"), (4, text, "c"), (None, text, "d"), (None, text, "d"), (6, None, "e"), (7, "", "f"), (8, "alone in the world now", "g"), (8, "alone", "h"), (9, None, "i"), (9, "nine", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = jj.one_of_each(docs)
    assert out.columns == docs.columns
    want = [(3, near, "b"), (None, text, "d"), (None, text, "d"), (6, None, "e"), (7, "", "f"), (8, "alone", "h"), (9, None, "i")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert jj.one_of_each(docs.limit(0)).count() == 0


def test_keys_in_slices(spark, monkeypatch):
    rows, written, tables = families(11), [], {}
    plain = jj.materialize

    def watched(df, label, keep=False):
        out = plain(df, label, keep)
        written.append(label)
        if label == "jaccard-hits":
            tables[len(tables)] = {r.key for r in out.collect()}
        return out

    monkeypatch.setattr(jj, "materialize", watched)
    monkeypatch.setattr(jj, "SLICE_KEYS", 100, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    # no slice holds most of the keys, and each key is in one
    sizes = [len(x) for x in tables.values()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes) and sum(sizes) == len(set().union(*tables.values()))
    assert written.count("jaccard-shared") == 4


def test_written_tables_leave_no_shuffle_files(spark):
    from wireloom.llm.common import materialize

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = set()
        while found.hasNext():
            out.add(found.next().getName())
        return {x for x in out if x.startswith("shuffle_")}

    df, before = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count(), files()
    out = materialize(df, "test")
    assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6 and not files() - before
    assert sum(r["count"] for r in df.collect()) == sum(r["count"] for r in df.collect()) == 1000


@pytest.mark.parametrize("most", [500_000, -1])
def test_one_of_each_moves_no_texts_that_need_not(spark, monkeypatch, most):
    monkeypatch.setattr(jj, "BROADCAST_IDS", most)
    rows = [*families(7, 6), (None, "kept"), (500, None), (501, "b"), (501, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, (_, c) in brute(rows[:-4], 5, 80).items() if i == c}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jj.one_of_each(docs)
        joins = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("SortMergeJoin" in joins or "ShuffledHashJoin" in joins) == (most < 0)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got if r.doc_id is None or r.doc_id >= 500))) == sorted(map(str, [(None, "kept"), (500, None), (501, "a")]))
    assert {r.doc_id for r in got} - {None, 500, 501} == want
