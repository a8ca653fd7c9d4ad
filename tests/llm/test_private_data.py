import random

from pyspark.sql import functions as F
from reference_spans import joined, private, sha

from wireloom.llm.common import table
from wireloom.llm.private_data import KINDS, _patterns, base_spans, candidate_spans, find_private, learn, op1_private
from wireloom.llm.spans import touched


def base(r):
    return [(s.start, KINDS[s.kind], s.end) for s in r.base]


def test_against_plain_python(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = op1_private(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = private(docs[r.doc_id])
        assert r.base_sha256 == sha(joined(want, KINDS))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in KINDS]
        assert set(joined(want, KINDS).split(",")) - {""} <= set(r.spans.split(","))


def test_made_up_texts(spark):
    rng = random.Random(4)
    parts = ["a", "_", "%", "@", "@b", ".", ".c", "x@y.z", "-", " ", "1", "25", "256", "1.2.3.4", "0.0", "+1", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "é", "🙂", "\n", "000255", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    got = find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert joined(base(r), KINDS) == joined(private(texts[r.doc_id]), KINDS), texts[r.doc_id]


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a@b.c", 0), (3, "me@x.org", 0), (3, "me@x.org", 1), (4, "a" * 20_000, 0), (5, "1" * 20_000 + ".1", 0), (6, "a@b.c " * 3_000, 0), (7, "a@b" + ".c" * 100_000, 0), (8, "+1" + "(" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = find_private(docs).collect()
    want = sorted((-1 if i is None else i, joined(private(t or ""), KINDS)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, joined(base(r), KINDS)) for r in got) == want
    assert find_private(docs.limit(0)).count() == 0


def test_contexts_lead_to_unseen_identifiers(spark):
    rng = random.Random(5)
    seeds = [f"reach them under phone number +1 (212) 555-{rng.randint(1000, 9999)} on weekdays" for _ in range(40)]
    unseen = [f"again: phone number 0{rng.randint(1000000, 9999999)} at night" for _ in range(3)]
    clean = [f"the order number {rng.randint(10**7, 10**8)} was sent" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen + clean)), "doc_id long, text string")
    got = {r.doc_id: [KINDS[s.kind] for s in r.added] for r in find_private(docs).collect()}
    assert {i for i, kinds in got.items() if kinds} == {40, 41, 42} and got[40] == ["phone"]


def test_contexts_lead_to_whole_spaced_and_digit_free_identifiers(spark):
    rng = random.Random(6)
    last = lambda: rng.randint(1000, 9999)
    seeds = [f"reach them under phone number +1 (212) 555-{last()} on weekdays" for _ in range(120)]
    seeds += [f"please write to mailbox u{last()}@example{last()}.com soon" for _ in range(40)] + [f"seen from host 10.{last() % 250}.{last() % 250}.{last() % 250} today" for _ in range(40)]
    unseen = [("phone number", x, "phone") for x in ("555 123 4567", "(030) 123 45 67", "(030)123 45 67", "0171 2345678", "030/123-4567", "0301234567")]
    unseen += [("to mailbox", x, "email") for x in ("jane.doe@localhost", "jane(at)example.com", "jane at example dot com", "jane [at] example.com")]
    unseen += [("from host", x, "ip") for x in ("fe80::1", "2001:db8:0:0:8:800:200c:417a", "::1", "10-20-30-40-50")]
    texts = seeds + [f"again: {context} {x} at night 12 times" for context, x, _ in unseen]
    clean = [f"the order number {last()} {last()} was sent" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r.doc_id: [((texts + clean)[r.doc_id][s.start : s.end], KINDS[s.kind]) for s in r.added] for r in find_private(docs).collect()}
    assert {i: x for i, x in got.items() if x} == {len(seeds) + i: [(x, kind)] for i, (_, x, kind) in enumerate(unseen)}


def test_a_lettered_number_is_one_candidate(spark):
    row = spark.createDataFrame([("account DE89 3704 0044 0532 0130 00 with bank",)], "t string").select(candidate_spans(F.col("t"), base_spans(F.col("t"))).alias("c")).first()
    assert [s.hit for s in row.c] == ["DE89 3704 0044 0532 0130 00"]


def test_many_hits_in_one_text(spark):
    text = " ".join(f"a{i}@b.cd 10.0.{i % 300}.1" for i in range(20_000))
    got = find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert joined(base(got[0]), KINDS) == joined(private(text), KINDS)


def test_touched_as_by_every_pair(spark):
    rng = random.Random(7)
    made = lambda n: sorted((a := rng.randint(0, 80), a + rng.randint(1, 9)) for _ in range(n))
    rows = [(made(rng.randint(0, 30)), made(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(rows, "spans array<struct<start:int,end:int>>, others array<struct<start:int,end:int>>")
    for r in df.select("*", touched(F.col("spans"), F.col("others")).alias("t")).collect():
        assert sorted((x.span.start, x.span.end, x.hit) for x in r.t) == sorted((s.start, s.end, any(o.start < s.end and s.start < o.end for o in r.others)) for s in r.spans)


def learnt_plainly(found, rounds=3, support=4, precision=0.8, accept=0.9):
    """The scoring of patterns and instances again, over (instance, kind or -1, patterns)."""
    edges, seeds = {(p, i) for i, _, ps in found for p in ps}, {(i, k) for i, k, _ in found if k >= 0}
    known, learnt = {x: 1.0 for x in seeds}, {}
    for _ in range(rounds):
        score = {}
        for p in {p for p, _ in edges}:
            mine = {i for q, i in edges if q == p}
            for k in range(4):
                confident = [c for (i, kind), c in known.items() if kind == k and i in mine]
                share = sum(confident) / len(mine)
                if len(confident) >= support and share >= precision:
                    score[p, k] = share * len(confident) / (len(confident) + 1)
        miss = {}
        for (p, k), s in score.items():
            for i in (i for q, i in edges if q == p):
                miss[i, k] = miss.get((i, k), 1.0) * (1 - s)
        best = {}
        for (i, k), m in miss.items():
            if 1 - m >= accept and i not in {x for x, _ in seeds} and (i not in best or (1 - m, -k) > best[i]):
                best[i] = (1 - m, -k)
        learnt = {i: -k for i, (_, k) in best.items()}
        known = {x: 1.0 for x in seeds} | {(i, -k): c for i, (c, k) in best.items()}
    return learnt


def test_scores_as_by_a_plain_version(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(7)]
    texts = []
    for i in range(400):
        name = rng.choice([f"u{rng.randint(0, 60)}@ex.org", f"+1 212 555 {rng.randint(1000, 1900)}", f"+1 212 556 {rng.randint(1000, 1900)}", f"0{rng.randint(1000000, 1000030)}", f"10.0.0.{rng.randint(1, 60)}"])
        left = {"u": "mail", "+": "call", "0": rng.choice(["call", "order"]), "1": "host"}[name[0]]
        texts.append(f"{rng.choice(words)} {left} {name} {rng.choice(['now', 'at night', 'please', left])} {rng.choice(words)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", base_spans(F.col("text")))
    found = docs.withColumn("candidates", candidate_spans(F.col("text"), F.col("base")))
    both = found.select(F.explode(F.concat("base", "candidates")).alias("s")).select(F.lower("s.hit").alias("i"), "s.kind", _patterns(F.col("s")).alias("p")).collect()
    want = learnt_plainly([(r.i, r.kind, r.p) for r in both])
    assert want and {r.instance: r.kind for r in learn(found).collect()} == want


def test_words_after_lead_to_unseen_identifiers(spark):
    seeds = [f"w{i} u{i}@example{i}.com is the address of somebody" for i in range(30)]
    texts = [*seeds, "ask jane.doe@localhost is the rule", "at 12345678 was sent"]
    got = {r.doc_id: [KINDS[s.kind] for s in r.added] for r in find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: k for i, k in got.items() if k} == {30: ["email"]}
