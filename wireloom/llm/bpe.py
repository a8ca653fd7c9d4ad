"""Byte-level BPE encoding and decoding with a lexicon of frequent words and exact merges for all others."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import arrow_rows, table
from .transducer import Transducer, compile_words

#: Most frequent words of the corpus that the lexicon holds, and their largest size; all others are merged.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 48
#: Words that a worker remembers in each of two generations, and words that a task counts before it hands its counts on.
MEMO_WORDS, COUNT_WORDS = 250_000, 500_000
#: The same where the ids themselves are kept, in workers that other stages of a pipeline use, too.
MEMO_WITH_IDS = 60_000

#: Words of so many bytes at most are merged by scanning their pairs, longer ones with a heap.
SHORT, NO_MERGE = 24, 1 << 62
#: The lexicon is the union of the most frequent words of so many hash buckets, so that no task sends more than its share.
LEXICON_BUCKETS = 64

#: Fixed value: the split into words that the byte-level vocabularies were made with; L and N stand for the two classes.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^\sLN]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def word_pattern() -> regex.Pattern:
    """WORD with letters and numbers as the tokenizer library's Unicode version has them.

    The regex module may know later versions, in which unassigned code points have become letters or numbers. Those that
    Python's own tables lack are put to the library: a letter joins an "a", a number a "1".
    """
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    late: list[list[int]] = []
    for m in regex.finditer(r"(\p{L})|\p{N}", "".join(chr(c) for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) == "Cn")):
        if len(split(("a" if m[1] else "1") + m[0])) == 1:
            continue
        if late and ord(m[0]) == late[-1][1] + 1:
            late[-1][1] += 1
        else:
            late.append([ord(m[0])] * 2)
    gone = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in late)
    letters, numbers = (rf"[\p{{{x}}}--[{gone}]]" if gone else rf"\p{{{x}}}" for x in "LN")
    return regex.compile(WORD.replace("L", "{letters}").replace("N", "{numbers}").format(letters=letters, numbers=numbers), regex.V1)


#: The same split for texts below U+0250, with the classes written out: the plain engine is several times faster there.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


def split_words(text: str) -> list[str]:
    """The words of a text without special strings."""
    return (word_pattern() if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class Codec:
    """The vocabulary, merges and special strings of a tokenizer file, and the exact merge."""

    def __init__(self, raw: str) -> None:
        spec = json.loads(raw)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(back.__getitem__, t)) for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.written = {str(i): raw for i, raw in self.bytes_of.items()}
        self.base = [vocab[c] for c in letters]
        #: pair -> rank, and the id that a merge of that rank makes
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special strings, and those with their ids."""
        at = 0
        for m in self.special_split.finditer(text) if self.special_split else ():
            yield text[at : m.start()], None
            yield m[0], self.specials[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: Iterable[str]) -> bytes:
        """The text of ids in decimal, as UTF-8, with the replacement character for bytes that are none."""
        raw = b"".join(map(self.written.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.base[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, made = self.ranks.get, self.made
        pairs = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NO_MERGE:
            at = pairs.index(best)
            ids[at : at + 2] = (made[best],)
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """n log n in the word's length."""
        n, get = len(ids), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i] = self.made[r]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x, on in zip(ids, alive) if on]


@lru_cache(2)
def _codec(raw: str) -> Codec:
    return Codec(raw)


class WordCache:
    """What a worker process knows of words: their ids as text. It outlives a task.

    Two generations: a full one becomes the old one, and words of the old one that are met again move back.
    """

    def __init__(self, codec: Codec, automaton: Transducer, words: int) -> None:
        self._codec, self._automaton, self._words = codec, automaton, words
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}

    def _ids(self, raw: bytes, known: list[int] | None) -> str:
        return ",".join(map(str, self._codec.merge(raw) if known is None else known))

    def ids(self, words: list[str]) -> list[str]:
        young = self._young
        out = list(map(young.get, words))
        if None not in out:
            return out
        if len(young) > self._words:
            self._old, self._young = young, {}
            young = self._young
        old, large, lookup = self._old, {}, self._automaton.lookup
        for i, got in enumerate(out):
            if got is not None:
                continue
            word = words[i]
            if (got := young.get(word) or large.get(word)) is None:
                if (got := old.get(word)) is not None:
                    young[word] = got
                elif len(raw := word.encode()) > LEXICON_BYTES:
                    got = large[word] = self._ids(raw, None)
                else:
                    got = young[word] = self._ids(raw, lookup(raw))
            out[i] = got
        return out


@lru_cache(1)
def _cache(raw: str, lexicon: bytes, words: int) -> WordCache:
    return WordCache(_codec(raw), Transducer(lexicon), words)


def word_counts(docs: DataFrame, raw: str) -> DataFrame:
    """Words of all texts with their frequencies: counted in each task, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, counts = _codec(raw), Counter()

        def out() -> pa.RecordBatch:
            # characters, not bytes: the driver leaves out what is still too long
            for w in [w for w in counts if len(w) > LEXICON_BYTES]:
                del counts[w]
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for part, special in codec.segments(text or ""):
                    if special is None:
                        counts.update(split_words(part))
            if len(counts) > COUNT_WORDS:
                yield out()
                counts.clear()
        yield out()

    arrow_rows(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> bytes:
    """The compiled automaton of frequent words with their ids; at most `words` words come to the driver, and no task's list."""
    raw = open(tokenizer_path, encoding="utf-8").read()
    first = Window.partitionBy("bucket").orderBy(F.desc("n"), "word")
    counts = word_counts(docs, raw).where("n > 1").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(LEXICON_BUCKETS)))
    top = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= words // LEXICON_BUCKETS).select("word").collect()
    codec = _codec(raw)
    return compile_words({w: codec.merge(w) for r in top if len(w := r.word.encode()) <= LEXICON_BYTES})


def encode_documents(docs: DataFrame, tokenizer_path: str, lexicon: bytes, keep_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids array<int>.

    One row per input row, no shuffle. A word's ids come from the mapped lexicon, else from exact merges; each worker
    remembers a bounded number of words. ids_sha256 is over the decimal ids joined by commas; decoded_sha256 is over the
    text that each document's ids are decoded to.

    Null or empty text: no ids. Special strings in a text become their ids, as the library does by default. Very long
    texts and words are encoded whole. Null doc_id stays null, repeated rows repeat, an empty table gives an empty result,
    other columns are not looked at. tokenizer_path is read on the driver only.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast((open(tokenizer_path, encoding="utf-8").read(), lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cache = _codec(shared.value[0]), _cache(*shared.value, MEMO_WITH_IDS if keep_ids else MEMO_WORDS)
        special = codec.special_split
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                if special is None or not special.search(text):
                    found = cache.ids(split_words(text))
                else:
                    found = []
                    for part, token in codec.segments(text):
                        found += cache.ids(split_words(part)) if token is None else [str(token)]
                joined = ",".join(found)
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(array("i", map(int, ids)).tobytes())
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(kept))])
                out["ids"] = pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text. Null ids: null text; an id out of the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _codec(shared.value).bytes_of
        for batch in batches:
            texts = [None if ids is None else b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    arrow_rows(encoded.sparkSession)
    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(docs, path, frequent_lexicon(docs, path), keep_ids=False)
