"""A corpus pipeline of five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; its result is written as
Parquet and read again as the next stage's documents. Rows of ``documents`` go in; all
stages but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import bpe, mixing, neardup, queries, suffix, toxicity
from stationlake.sources.shared import staged


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    lexicon = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, lexicon).where("toxic_score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, of 400 bytes or of over 50 words; documents that had words and have none left go."""
    names = [c for c in docs.columns if c != "text"]

    def as_text(found):
        # Half a character may be left where a passage was cut out.
        return {"text": [b.decode("utf-8", "ignore") for b in found["kept"]], "_lost": [len(b) > 0 for b in found["begins"]]}

    texts = suffix.without_repeats(docs, names, as_text, "text string, _lost boolean", words=True).where(~(F.col("_lost") & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")))
    shown = texts.withColumn("n_chars", F.when(F.col("_lost"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return shown.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt out to domains, languages and sources by weight."""
    picked = mixing.mixed(queries.with_domain(docs), ["domain", "lang", "source"], queries.mix_weights(), max_epochs=2)
    return picked.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of what they decode to."""
    coded = bpe.encoded(docs, *queries.byte_bpe(), keep=["doc_id", "lang", "source"])
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Learned weights, samples of shingles and tokenizer ids are beyond SQL; tests/llm has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
