"""Personal data: fixed shapes as seeds, and contexts learnt from them that lead to identifiers of other shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import count_kind, digest_text, let, spans_of, touched

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier of another shape, each as a whole: words around an @ or an "at"; colon groups; groups of letters
#: and digits after a country's two letters; four or more dotted groups; digit groups joined by single separators, six digits
#: or more; and else a run of such characters with six digits or more. A number that is long by itself takes no further groups.
AT = r"(?=[0-9._%+-]*+[A-Za-z])[A-Za-z0-9._%+-]++(?:(?:@|\x20?[(\[](?i:at)[)\]]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|\x20at\x20(?=[A-Za-z])[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)++)"
COLONS = r"(?<!:)(?=[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){2})[0-9A-Fa-f]{0,4}+(?::{1,2}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z]))++"
LETTERED = r"[A-Z]{2}[0-9]{2}(?:\x20(?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4}(?![A-Za-z0-9]))++"
DOTTED = r"[0-9]{1,5}(?:\.[0-9]{1,5}){3,}+(?![0-9A-Za-z@_%])"
GROUPS = r"(?=(?:[\x20()./+-]{0,3}[0-9]){6})\+?(?:\([0-9]{1,5}\)|[0-9]{1,5}(?![0-9A-Za-z@_%]))(?:(?:[\x20./-]|(?<=\)))(?:\([0-9]{1,8}\)|[0-9]{1,8}(?![0-9A-Za-z@_%])))++"
RUN = r"(?=(?:[A-Za-z@._%+()-]*+[0-9]){6})[A-Za-z0-9@._%+()-]++"
CANDIDATE = r"(?<![A-Za-z0-9@._%+()-])(?:" + "|".join((AT, COLONS, LETTERED, DOTTED, GROUPS, RUN)) + ")"

#: Rounds of scoring; distinct known instances that a pattern needs, and the share of its instances that must be known.
ROUNDS, SUPPORT, PRECISION = 3, 4, 0.8
#: Confidence at which an instance joins the known ones.
ACCEPT = 0.9


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the fixed shapes in a text that is not null. The patterns never look at a character more than a few times."""
    email = spans_of(text, 0, EMAIL, text.contains("@"), context=True)
    ip = F.filter(spans_of(text, 1, IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), context=True), lambda s: F.regexp_like(s["hit"], F.lit(IP_VALID)))
    numbers = spans_of(text, 2, CARD, F.regexp_like(text, F.lit("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), context=True)
    card = F.filter(numbers, lambda s: (F.length(_digits(s["hit"])) <= 19) & F.when(F.length(_digits(s["hit"])) <= 19, _luhn(_digits(s["hit"]))).otherwise(False))
    phone = F.filter(spans_of(text, 3, PHONE, text.contains("+"), context=True), lambda s: F.length(_digits(s["hit"])).between(10, 15))
    return F.concat(email, ip, card, phone)


def candidate_spans(text: Column, base: Column) -> Column:
    """Token sequences that may be identifiers and do not touch a base span; kind is -1."""
    runs = spans_of(text, -1, CANDIDATE, F.regexp_like(text, F.lit("[0-9@:]|[aA][tT]")), context=True)

    def trimmed(s: Column) -> Column:
        hit = F.regexp_replace(s["hit"], r"[@._%+(-]+$", "")
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (s["start"] + F.length(hit)).alias("end"), hit.alias("hit"), s["before"].alias("before"), s["after"].alias("after"))

    free = F.filter(touched(F.transform(runs, trimmed), base), lambda t: ~t["hit"])
    return F.transform(free, lambda t: t["span"])


def _patterns(span: Column) -> Column:
    """The lexical patterns around a span, in lower case: the word before it, the two words before it, the word after it, and
    the words on both sides."""

    def of(x: Column) -> Column:
        one, two, after = F.element_at(F.split(x["before"], " "), -1), x["before"], x["after"]
        both = F.when((one != "") & (after != ""), F.concat(F.lit("3 "), one, F.lit(" _ "), after)).otherwise("")
        return F.filter(F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two), both, F.concat(F.lit("> "), after)), lambda p: F.length(p) > 2)

    return let(F.struct(F.lower(F.regexp_replace(span["before"], r"\s+", " ")).alias("before"), F.lower(span["after"]).alias("after")), of)


def learn(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, precision: float = PRECISION, accept: float = ACCEPT) -> DataFrame:
    """found (base, candidates) -> instance, kind of the unseen identifiers.

    The graph has an edge from each pattern to each instance (lower-cased text) that stands beside it. A round scores every
    pattern and kind by the confidence of its known instances over the number of all its instances, keeps those with enough
    support and precision, and gives every unknown instance the noisy-or of its patterns' scores. Edges are distinct and
    counts are taken before they move, so a frequent pattern or instance is a few rows for each task.
    """
    hit = lambda s: F.lower(F.col(s)["hit"])
    seeds = found.select(F.explode("base").alias("s")).select(hit("s").alias("instance"), F.col("s.kind").alias("kind"), _patterns(F.col("s")).alias("patterns"))
    others = found.select(F.explode("candidates").alias("s")).select(hit("s").alias("instance"), F.col("s.kind").alias("kind"), _patterns(F.col("s")).alias("patterns"))
    graph = materialize(seeds.unionByName(others).select("instance", "kind", F.explode("patterns").alias("pattern")).distinct(), "private-graph")
    edges = graph.select("pattern", "instance").distinct()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeded = graph.where("kind >= 0").select("instance", "kind").distinct()
    seed_names = seeded.select("instance").distinct()
    known = seeded.withColumn("confidence", F.lit(1.0))
    learnt = None
    for _ in range(rounds):
        scored = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("sum"), F.count("*").alias("known"))
        scored = scored.where(F.col("known") >= support).join(sizes, "pattern").withColumn("precision", F.col("sum") / F.col("size")).where(F.col("precision") >= precision)
        scored = scored.select("pattern", "kind", (F.col("precision") * F.col("known") / (F.col("known") + 1)).alias("score"))
        votes = edges.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("confidence"))
        votes = votes.join(seed_names, "instance", "left_anti").where(F.col("confidence") >= accept)
        best = votes.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
        learnt = materialize(best.select("instance", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence")), "private-learnt")
        known = seeded.withColumn("confidence", F.lit(1.0)).unionByName(learnt)
    return learnt.select("instance", "kind")


def find_private(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base, added: arrays of kind, start, end; one row per input row. Built-in functions only.

    base holds the fixed shapes, added what the learnt contexts lead to; offsets are code points, end is exclusive.

    Null or empty text: no spans. Null doc_id stays null, repeated rows repeat (their spans count once for learning), an
    empty table gives an empty result, other columns are not looked at. Very long texts are searched whole. An instance that
    scores alike for two kinds takes the one listed first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("candidates", candidate_spans(F.col("text"), F.col("base"))).drop("text")
    found = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "private-found")
    learnt = learn(found, **options)
    at = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("s")).withColumn("instance", F.lower("s.hit"))
    added = at.join(learnt, "instance").groupBy("row").agg(F.collect_list(F.struct("kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"))).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(added, "row", "left").select("doc_id", plain.alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added"))


def op1_private(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    rows = find_private(table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(digest_text(F.col("base"), KINDS), 256).alias("base_sha256"), digest_text(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
