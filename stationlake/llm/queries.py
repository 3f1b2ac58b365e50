"""The operators as registered queries over the supplied tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import (
    bpe,
    chat,
    fim,
    langid,
    licenses,
    mixing,
    neardup,
    quality,
    suffix,
    topk,
    toxicity,
    unigram,
    vectorcodes,
)
from stationlake.sources.shared import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(job: Callable[[SparkSession, str], DataFrame], sql: str | None = None):
    QUERIES[job.__name__] = job
    if sql:
        ORACLES[job.__name__] = sql
    return job


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, as a location that Spark reads."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def local_bytes(path: str) -> bytes:
    """A vocabulary file; it lies with the driver and goes to the tasks inside the job."""
    with open(path, "rb") as f:
        return f.read()


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    return unigram.pieces_of(local_bytes(path))


def byte_bpe() -> tuple[bytes, str, dict[str, int]]:
    """Vocabulary, pattern and special tokens of the byte-level tokenizer."""
    import public_tokenizers

    return local_bytes(tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def op1_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversations(table(spark, folder, "conversations"))


register(op1_quotation_links, chat.ORACLE)


@register
def op2_unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return unigram.token_counts(docs, unigram_pieces(tokenizer_file("piece_bpe_32k.model")))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no paths: a document lies in source/lang/hundred, the first of a hundred is its LICENSE."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), name)
    found = licenses.scanned(docs.select("doc_id", path.alias("path"), "text"))
    return found.withColumn("own_score", F.round("own_score", 6))


register(op3_license_scan, licenses.oracle(
    "concat_ws('/', source, lang, cast(doc_id // 100 AS VARCHAR), "
    "CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END)"
))


@register
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.named(neardup.classes(docs))


@register
def op5_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encoded(docs, *byte_bpe(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op6_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return quality.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lost_words",
    )


#: Target mixture: a domain is every fourth source; weights of languages hold within each domain.
MIX_DOMAINS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
MIX_LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.concat(F.lit("d"), F.when(number == "", 0).otherwise(number.cast("int") % 4)))


def mix_weights() -> dict[tuple, float]:
    weights: dict[tuple, float] = {(d,): w for d, w in MIX_DOMAINS.items()}
    weights |= {(d, x): w for d in MIX_DOMAINS for x, w in MIX_LANGUAGES.items()}
    return weights


@register
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_domain(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))
    picked = mixing.mixed(docs, ["domain", "lang", "source"], mix_weights(), max_epochs=4)
    return picked.select("doc_id", "domain", "lang", "source", "epoch", mixing.word_tokens().alias("n_tokens"))


@register
def op8_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.scaled(
        topk.usable(table(spark, folder, "embeddings"), "vec_id", "embedding"), 64.0
    )
    queries = vectors.where(F.col("vec_id") % 20 == 0)
    return topk.top_k(queries, vectors, 20)


@register
def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What 400-byte strings remove; the columns ``with_words_`` tell the same when repeated runs of over 50 words go as well."""
    docs = table(spark, folder, "documents").select("doc_id", "text")

    def told(found: dict[str, list]) -> dict[str, list]:
        out = {}
        for of, name in (("byte_", ""), ("", "with_words_")):
            kept, begins, ends = (found[of + c] for c in ("kept", "begins", "ends"))
            out[f"{name}n_removed"] = [sum(e) - sum(b) for b, e in zip(begins, ends)]
            out[f"{name}n_spans"] = [len(b) for b in begins]
            out[f"{name}kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
        return out | {"n_bytes": [len(k) + n for k, n in zip(found["kept"], out["with_words_n_removed"])]}

    columns = "n_removed bigint, n_spans bigint, kept_sha256 string"
    more = ", ".join(f"with_words_{c}" for c in columns.split(", "))
    return suffix.without_repeats(docs, ["doc_id"], told, f"n_bytes bigint, {columns}, {more}", words=True)


@register
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.scored(docs, lexicon)
    return scored.select(
        "doc_id",
        F.coalesce(~toxicity.in_training(), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = fim.filled(table(spark, folder, "documents").select("doc_id", "text"), with_restored=True)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("output"), digest("restored")
    )


register(op12_fill_in_middle, fim.ORACLE)


@register
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identified(docs.select("doc_id", "text"), found).select(
        "doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected"
    )


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vectorcodes.compressed(table(spark, folder, "embeddings"))
    done = vectorcodes.with_label_error(staged(coded, "vector-codes"))
    return done.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


register(op11_vector_codes, vectorcodes.ORACLE)
