"""Regular-expression spans with code point offsets, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span: kind is its place in the operator's list of kinds; end is exclusive; offsets are in code points.
SPAN = "struct<kind:int,start:int,end:int,hit:string,before:string,after:string>"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is computed once however often body uses it (SQL expressions have no names of their own)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_blocks(values: Column) -> Column:
    """An array that is not empty as an array of blocks, each about as long as there are blocks."""
    side = lambda x: F.ceil(F.sqrt(F.size(x))).cast("int")
    cut = lambda x, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda b: F.slice(x, b * n + 1, n))
    return let(values, lambda x: let(side(x), lambda n: cut(x, n)))


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each value of an array of ints op over all values before it, zero for the first; op is associative.

    A fold copies what it has gathered in every step. So blocks are folded on their own, then what comes before each block,
    and both are put together: a text of 100,000 spans costs some 100,000 * 300 copied ints, not their square.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(folded: Column) -> Column:
        before = F.aggregate(F.transform(folded, lambda b: b["at"]), start, step)["out"]
        return F.flatten(F.zip_with(folded, before, lambda b, base: F.transform(b["out"], lambda x: op(base, x))))

    folded = lambda x: F.transform(_in_blocks(x), lambda b: F.aggregate(b, start, step))
    return let(values, lambda x: F.when(F.size(x) > 0, let(folded(x), joined)).otherwise(F.array().cast("array<int>")))


def spans_of(text: Column, kind: int, pattern: str, gate: Column, group: int = 0, context: bool = False) -> Column:
    """Leftmost non-overlapping matches of a pattern in a text that is not null.

    gate must hold wherever there is a match; it spares the search. hit is the group. The text between the matches and the
    matches themselves give the offsets: SQL has no function for them. The pattern must not match the empty string. context:
    before has the last two words of the text since the match before, after the first word of the text up to the next one.
    """
    none = F.array().cast(f"array<{SPAN}>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    found = F.struct(hits.alias("hits"), parts.alias("parts"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        # what stands before each match and the match itself
        lengths = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda gap, hit: F.length(gap) + F.length(hit))
        after = F.slice(x["gaps"], 2, F.size(x["hits"]))
        return F.arrays_zip(running(lengths, lambda a, b: a + b, 0).alias("at"), x["hits"].alias("hit"), x["parts"].alias("part"), F.slice(x["gaps"], 1, F.size(x["hits"])).alias("gap"), after.alias("after"))

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        hit = x["part"] if group else x["hit"]
        before = F.reverse(F.regexp_extract(F.reverse(x["gap"]), r"^\s*+(\S++(?:\s++\S++)?)", 1)) if context else F.lit("")
        after = F.regexp_extract(x["after"], r"^\s*+(\S++)", 1) if context else F.lit("")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["hit"])).alias("end"), hit.alias("hit"), before.alias("before"), after.alias("after"))

    return F.when(gate, let(found, lambda x: F.when(F.size(x["hits"]) > 0, F.transform(placed(x), span)).otherwise(none))).otherwise(none)


def touched(spans: Column, others: Column) -> Column:
    """For each span, in order of start, whether it overlaps one of the others: an array of structs of span and hit.

    Sorted together, a span overlaps another if one that starts no later ends after its start, or the next that starts later
    starts before its end.
    """
    last = (1 << 31) - 1

    def events(x: Column) -> Column:
        theirs = F.transform(x["others"], lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("mine"), s["end"].alias("end"), F.lit(-1).alias("i")))
        mine = F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), F.lit(1).alias("mine"), s["end"].alias("end"), i.alias("i")))
        return F.array_sort(F.concat(theirs, mine))

    def told(x: Column) -> Column:
        ends = running(F.transform(x, lambda e: F.when(e["mine"] == 0, e["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
        starts = running(F.transform(F.reverse(x), lambda e: F.when(e["mine"] == 0, e["start"]).otherwise(last)), lambda a, b: F.least(a, b), last)
        both = F.arrays_zip(x.alias("e"), ends.alias("before"), F.reverse(starts).alias("next"))
        return F.transform(F.filter(both, lambda z: z["e"]["mine"] == 1), lambda z: F.struct(z["e"]["i"].alias("i"), ((z["before"] > z["e"]["start"]) | (z["next"] < z["e"]["end"])).alias("hit")))

    def out(x: Column) -> Column:
        return F.transform(let(events(x), told), lambda t: F.struct(F.get(x["spans"], t["i"]).alias("span"), t["hit"].alias("hit")))

    return let(F.struct(spans.alias("spans"), others.alias("others")), out)


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark in place of each span, one for spans that overlap. spans: start and end, at least one.

    Texts are cut in two levels, as finding a place in a text takes time in its distance from the start.
    """

    def runs(sorted_: Column) -> Column:
        # a span that starts before the last end only moves that end
        ends = running(F.transform(sorted_, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        return F.filter(F.arrays_zip(sorted_.alias("s"), ends.alias("from")), lambda z: z["s"]["start"] >= z["from"])

    def pieces(block: Column, text: Column) -> Column:
        # a block of runs needs the text from the first one's gap to the last one's start alone
        begin, stop = F.get(block, F.lit(0))["from"], F.element_at(block, F.lit(-1))["s"]["start"]
        one = lambda part: F.transform(block, lambda z: F.concat(F.substr(part["t"], z["from"] - part["at"] + 1, z["s"]["start"] - z["from"]), F.lit(mark)))
        return F.array_join(let(F.struct(F.substr(text, begin + 1, stop - begin).alias("t"), begin.alias("at")), one), "")

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    head = F.array_join(F.transform(_in_blocks(let(ordered, runs)), lambda b: pieces(b, text)), "")
    return F.concat(head, F.substr(text, end + 1, F.length(text)))


def digest_text(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start, then kind in the listed order, joined by commas."""
    listed = F.array(*[F.lit(n) for n in names])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(listed, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
