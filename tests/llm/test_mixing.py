from collections import defaultdict

from wireloom.llm.mixing import mix_sources, mixed_documents, op10_mixing

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; what is above twice the size is shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, got = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            got |= share
            break
        for s in full:
            got[s] = 2 * sizes[s]
            left -= got[s]
        free -= full
    return got


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r, source in rows:
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets(dict(sizes))
    for r, source in rows:
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r["size"] for r, x in rows if x == s)


def test_targets_and_words(spark, sf):
    from wireloom.llm.common import table

    source = {r.doc_id: r.source for r in table(spark, sf, "documents").collect()}
    rows = op10_mixing(spark, sf).collect()
    assert len(rows) == len(source)
    check([(r, source[r.doc_id]) for r in rows])
    assert sorted(rows) == sorted(op10_mixing(spark, sf).collect())


def test_edges(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3], "") for i in range(60)] + [(None, "one two", None, ""), (99, None, None, ""), (102, "x y", "a", ""), (102, "x y", "a", ""), (77, "long " * 50_000, "z", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    check([(r, source[r.doc_id]) for r in got])
    assert mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mix_sources(spark.createDataFrame([(1, None, "s", "")], SCHEMA)).collect()} == {0}


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), "ab"[i % 2], "") for i in range(40)], SCHEMA)
    taken = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    out = defaultdict(int)
    for r in mixed_documents(docs).collect():
        out[r.doc_id] += len(r.text.split())
    assert out == {k: v for k, v in taken.items() if v}


def test_quality_is_preferred(spark):
    docs = spark.createDataFrame([(i, "word", "a", "") for i in range(4000)] + [(9000 + i, "word", "b", "") for i in range(40000)], SCHEMA)
    quality = spark.createDataFrame([(9000 + i, i % 2) for i in range(40000)], "doc_id long, quality int")
    got = [r for r in mix_sources(docs, quality).collect() if r.doc_id >= 9000]
    extra = [r.doc_id % 2 for r in got if r.selected]
    assert sum(extra) / len(extra) > 0.55


def test_rows_of_one_id_are_mixed_one_by_one(spark):
    rows = [(None, "one two", "a", "x"), (None, "three four five", "a", "y"), (7, "six", "a", "x"), (7, "seven eight", "b", None), (7, "six", "a", "x"), (8, "", "a", ""), (9, None, None, None)]
    rows += [(i, "word " * (1 + i % 4), "ab"[i % 2], "") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    times, taken = defaultdict(int), defaultdict(int)
    for r in out.collect():
        times[tuple(r)] += 1
    for r in mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    words = defaultdict(int)
    for r, n in times.items():
        assert r in rows and r[1]
        words[r[0]] += n * len(r[1].split())
    assert words == {i: n for i, n in taken.items() if n}
    assert sorted(map(str, mixed_documents(docs).collect())) == sorted(map(str, out.collect()))
