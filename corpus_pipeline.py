"""From documents to token ids in five stages, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. run(spark, sf_dir) applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import bpe, jaccard_join, language_id, mixing, secret_scan
from wireloom.llm.common import discard, materialize, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; lang says which. Texts without letters and of unknown languages go.

    Each row is judged by its own text and source. Null and empty texts go, null and repeated ids and repeated rows are judged
    like any others, very long texts whole; ties go to the language first in code point order. Empty table: empty result.
    Extra columns go through untouched, whatever their names.
    """
    return language_id.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id: shingles of five words, similarity of 0.8 or more.

    Null and empty texts and rows with null id are linked with nothing and stay; of the rows of one id the one with the least
    text stays (ties: any one, they are alike in id and text). Very long texts count whole. Empty table: empty result. Extra
    columns go through untouched.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked out.

    Each row is redacted by its own text, whatever its id. Null stays null, empty stays empty, repeated rows repeat, very long
    texts are scanned whole, overlapping secrets become one mark. Empty table: empty result. Extra columns go through untouched.
    """
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands as often as it is taken.

    Rows are decided one by one. Null and empty texts have no words and go; null sources are one source, the last; null ids
    are sampled by the hash of "". Equal keys go by id, size and the text's hash; repeated rows are as many documents. Very
    long texts are taken whole. Empty table: empty result. Extra columns go through untouched.
    """
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document of the mix.

    Null and empty texts have no ids; null ids stay null, repeated rows repeat, very long texts are encoded whole. Empty
    table: empty result. Extra columns are not looked at.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(docs, path, bpe.frequent_lexicon(docs, path))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("BPE encoding", tokens)]

#: SQL has no expression for the language model, so the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark):
            docs = materialize(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"), keep=True)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
