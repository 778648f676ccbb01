"""The queries of this subpackage and their SQL; ``__spark_entry__.py`` adds them if it can import this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from riskloom.llm import bpe, embeddings, fingerprint, lexical, minhash, mixing, pii, quality, repeats, secrets, toxicity, turntrie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and what they decode to, as digests."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the lists, else of the patterns, for every page's url."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.LISTED + urls.PATTERNS)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the patterns' spans and those that the field adds."""
    docs = _table(spark, sf_dir, "documents")
    return pii.counted(pii.find_spans(docs, pii.learn(docs)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's uses in a mixture of sources, each repeated up to four times."""
    return mixing.mixed(_table(spark, sf_dir, "documents"), repeats=4.0)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the patterns' spans and strings that look random."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: three words, a likeness of 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors of a label, by a cosine of 0.93."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learnt from labelled ones outside of the held-out fold."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learnt from labelled ones outside of the held-out fold."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that lie in a string of 200 bytes which starts twice."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), length=200)


def op12_turntrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, with shared beginnings."""
    return turntrie.shared_turns(_table(spark, sf_dir, "conversations"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_pii": op2_pii,
    "op3_fingerprint": op3_fingerprint,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_minhash": op7_minhash,
    "op8_embeddings": op8_embeddings,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_repeats": op11_repeats,
    "op12_turntrie": op12_turntrie,
    "op13_lexical": op13_lexical,
    "pipeline": corpus_pipeline.run,
}

#: Where SQL can express a query.
ORACLES: dict[str, str] = {"op1_urls": urls.SQL, "op7_minhash": minhash.SQL, "op8_embeddings": embeddings.SQL, "op12_turntrie": turntrie.SQL, "op13_lexical": lexical.SQL}
