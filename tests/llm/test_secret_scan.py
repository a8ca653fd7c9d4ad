import random

from reference_spans import joined, secrets, sha

from wireloom.llm.common import fresh_path, table
from wireloom.llm.secret_scan import KINDS, Ledger, op2_secrets, redact_secrets, scan_secrets


def spans(r):
    return [(s.start, KINDS[s.kind], s.end) for s in r.found]


def test_against_plain_python(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op2_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = secrets(docs[r.doc_id])
        assert r.spans == joined(want, KINDS) and r.base_sha256 == sha(r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in KINDS]


def test_made_up_texts(spark):
    rng = random.Random(3)
    parts = ["token", "API_KEY", "apikey", "pAssWord", "secret", "passwd", " ", "=", ":", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "🙂", "x", "\n", "==", "-/+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    got = scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert joined(spans(r), KINDS) == joined(secrets(texts[r.doc_id]), KINDS), texts[r.doc_id]


def test_edges(spark):
    secret = 'token = "abcdefghijkl"'
    rows = [(1, None, 0), (2, "", 0), (None, secret, 0), (3, secret, 0), (3, secret, 1), (4, "a" * 300_000, 0), (5, "token" + " " * 100_000, 0), (6, "password " * 20_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = scan_secrets(docs).collect()
    want = sorted((-1 if i is None else i, joined(secrets(t or ""), KINDS)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, joined(spans(r), KINDS)) for r in got) == want
    assert scan_secrets(docs.limit(0)).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    ledger = Ledger(fresh_path(spark, "ledger-test"))
    first = spark.createDataFrame([(1, "AKIA" + "A" * 20), (2, "AKIA" + "A" * 20), (3, "clean")], "path long, text string")
    ledger.scan(first)
    size = lambda: spark.read.parquet(ledger.path).count()
    assert size() == 2
    more = first.union(spark.createDataFrame([(4, "clean"), (5, "new")], first.schema))
    ledger.scan(more)
    assert size() == 3
    ledger.scan(more, 2)
    assert size() == 6
    assert {r.path: len(r.found) for r in ledger.findings(more).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_redaction(spark):
    rows = [(1, 'é token = "abcdefghijkl0123456789abcdef" end', "a", 9), (2, None, "b", 0), (3, "clean", None, 5)]
    out = {r.doc_id: r for r in redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()}
    assert out[1].text == 'é [SECRET]" end' and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[3].source) == (None, "clean", None)


def test_redaction_is_by_row(spark):
    rows = [(None, "secret=zyxwvutsrqponml", 1), (None, "clean words", 2), (None, "password: 'abcdefghijkl' é", 3), (7, "token=abcdefghijklmnop end", 4), (7, "clean words stay whole", 5), (7, "clean words stay whole", 5), (8, "", 0), (8, None, None)]
    out = redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, found long")).collect()
    want = [(None, "[SECRET]", 1), (None, "clean words", 2), (None, "[SECRET]' é", 3), (7, "[SECRET] end", 4), (7, "clean words stay whole", 5), (7, "clean words stay whole", 5), (8, "", 0), (8, None, None)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_many_secrets_in_one_text(spark):
    text = "é ".join(f"token={i:016d}" for i in range(20_000))
    out = redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert out[0].text == "é ".join(["[SECRET]"] * 20_000)
