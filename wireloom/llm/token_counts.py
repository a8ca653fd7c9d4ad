"""Token counts: pieces are counted once per distinct pre-token of the corpus, joined to each document's frequencies, and summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, table

#: Longest sequence a document may have before over_limit.
TOKEN_LIMIT = 4096
#: Pre-tokens that are joined by broadcast, the most frequent ones, and their longest; all others are joined by a shuffle.
BROADCAST_TOKENS, BROADCAST_CHARS = 131_072, 64
#: Tasks that a pre-token too long for the broadcast is dealt to, as it may be frequent, too.
SALTS = 16
#: The broadcast part is the union of the most frequent pre-tokens of so many hash buckets, so that no task sorts them all.
BUCKETS = 64
#: Distinct pre-tokens that a task counts before it hands its counts on.
COUNT_TOKENS = 500_000

_CHUNK = re.compile(" +[^ ]*")

FREQUENCIES = "doc_id long, n_bytes long, known long, others array<struct<token:string,n:long>>"


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: each run of spaces with the word after it.

    The model puts a space before the text, writes spaces as U+2581 and has no piece in which that mark follows another
    character, so no merge crosses from a word to the next space: the pieces of a text are those of its pre-tokens.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " not in text and text[0] != " ":
        return [" " + x for x in text.split(" ")]
    return _CHUNK.findall(" " + text)


def frequent_tokens(docs: DataFrame) -> DataFrame:
    """docs (text) -> token: the most frequent pre-tokens of all texts, BROADCAST_TOKENS at most.

    Counted in each task, then summed. What a task met once is left out: these sums only say what is worth a broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= BROADCAST_CHARS]
            return pa.RecordBatch.from_pydict({"token": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(pre_tokens(text or ""))
            if len(counts) > COUNT_TOKENS:
                yield out()
                counts.clear()
        yield out()

    arrow_rows(docs.sparkSession)
    counted = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    first = Window.partitionBy(F.pmod(F.xxhash64("token"), F.lit(BUCKETS))).orderBy(F.desc("n"), "token")
    return counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= BROADCAST_TOKENS // BUCKETS).select("token")


def _pieces(model, tokens: list[str]) -> list[int]:
    """How many pieces the model cuts each pre-token into."""
    # the library gives an empty text no pieces, so a lone space is counted after a word
    lone = len(model.encode("x ")) - len(model.encode("x"))
    return [lone if w == " " else len(p) for w, p in zip(tokens, model.encode([w[1:] for w in tokens], num_threads=1))]


def piece_counts(tokens: DataFrame, model_path: str) -> DataFrame:
    """tokens (token) -> token, pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"token": batch.column("token"), "pieces": pa.array(_pieces(model, batch.column("token").to_pylist()), pa.int64())})

    return tokens.mapInArrow(run, "token string, pieces long")


def _joined_counts(rest: DataFrame, model_path: str) -> DataFrame:
    """rest (row, token, n) -> row, rest: pieces of each distinct token, counted once, times the frequencies, summed by row.

    Rows are dealt and sorted by token, so a task meets a token's rows one after another, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, last, known = sentencepiece.SentencePieceProcessor(model_file=model_path), None, 0
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            tokens = coded.dictionary.to_pylist()
            if tokens:
                new = tokens[1:] if tokens[0] == last else tokens
                sizes = [known] * (len(tokens) - len(new)) + _pieces(model, new)
                last, known = tokens[-1], sizes[-1]
                pieces = np.array(sizes, np.int64)[coded.indices.to_numpy()] * batch.column("n").to_numpy()
                yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "rest": pa.array(pieces)})

    salt = F.when(F.length("token") > BROADCAST_CHARS, F.pmod("row", F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rest.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token")
    return dealt.select("row", "token", "n").mapInArrow(run, "row long, rest long").groupBy("row").agg(F.sum("rest").alias("rest"))


def count_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; one row per input row. Ids are not kept.

    1. The most frequent pre-tokens of the corpus, a bounded number; their pieces are counted once and broadcast.
    2. Each document's pre-token frequencies are joined to them where the document is. What a document has beside them goes
       through a shuffle, one row for each document and pre-token: there the pieces of each distinct one are counted once
       and joined to its rows. (Pre-tokens too long for the broadcast are dealt to SALTS tasks, once in each.)
    3. Counts times frequencies are summed by document.

    Null or empty text: 0 bytes, 0 tokens. Very long texts and words are counted whole. Null doc_id stays null. Repeated rows
    give repeated rows. Empty table: empty result. Other columns are not looked at. model_path must exist on every executor.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    shared = spark.sparkContext.broadcast({r.token: r.pieces for r in piece_counts(frequent_tokens(docs), model_path).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sums, places, tokens, counts = [], [0], [], []
            for text in texts:
                total = 0
                for token, n in Counter(pre_tokens(text)).items():
                    if (pieces := known.get(token)) is not None:
                        total += n * pieces
                    else:
                        tokens.append(token)
                        counts.append(n)
                sums.append(total)
                places.append(len(tokens))
            others = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "known": pa.array(sums, pa.int64()), "others": pa.ListArray.from_arrays(pa.array(places, pa.int32()), others),
            })

    arrow_rows(spark)
    # the number of a row is written with it, so that it stays the same for all readers
    rows = materialize(docs.mapInArrow(run, FREQUENCIES).withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    rest = _joined_counts(rows.select("row", F.explode("others").alias("o")).select("row", "o.token", "o.n"), model_path)
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    # merged by the row number, which also keeps the order of rows in a partition
    return rows.drop("others").join(rest.hint("merge"), "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
