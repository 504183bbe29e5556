"""A corpus pipeline in five stages; each stage's result is written as Parquet and read again as the next one's docs.

All stages take nulls in any column, empty and very long texts, repeated rows and further columns, whatever their names;
an empty table stays empty. A null or empty text has no words and goes in the first stage; each operator's docstring
says what the others do with one. Ties: of equal or near documents the smallest doc_id stays, null ids last."""

from __future__ import annotations

import uuid

from goldvein.llm import decontaminate, jaccard, pieces, pii, quality
from goldvein.llm.common import work_dir
from goldvein.llm.queries import tokenizer


def keep_good(spark, docs, sf_dir):
    """Quality rules: documents that fail the base rules or their group's fences go."""
    return quality.filter_quality(docs)


def keep_one_of_each(spark, docs, sf_dir):
    """N-gram Jaccard join: of each class of near duplicates, the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Decontamination: documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark, docs, sf_dir):
    """PII: every span found in a text becomes its kind in angle brackets."""
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    """SentencePiece: the ids of each text with their checks."""
    return pieces.encode_frame(docs, tokenizer("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("sentencepiece", encode),
]

#: SQL can't express the MinHash join, the contextual extraction or the tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
