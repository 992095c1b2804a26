"""Corpus pipeline: raw documents to packed token sequences.

Five stages, each a training-data operator whose decisions take effect:

1. quality rules - documents that the rules reject go;
2. line dedup - later occurrences of repeated three-line windows go from the
   texts; a document that loses every line with a word goes;
3. n-gram Jaccard join - of each group of near-duplicates (five-word shingles,
   similarity of 0.8 or more) the row with the smallest (doc_id, row hash) stays;
4. personal data - protected entities and disclosing terms are replaced;
5. packing - what is left is laid along the space-filling curve and cut into
   sequences of 2048 tokens.

Every stage reads all rows of its predecessor, works on whole texts and returns
the columns of ``documents`` (n_chars follows the text); the last returns the
pieces of sequences.  Null and empty texts fail the quality rules, so they do
not reach the later stages through ``run``; each stage alone keeps them (they
have no lines, no shingles and no entities) and the last packs an empty text as
its end token.  Rows that are equal in all columns are judged alike; of equal
rows one stays after stage 3.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import jaccard_join, line_dedup, packing, pii, quality_rules
from sitelens.llm.common import Scratch, read, shared_dir

#: Not expressible in SQL: a trained model, a tokenizer and a space-filling curve decide.
ORACLE_SQL = None


#: Scratch tables of the stage at hand, when stages are called one by one; ``run`` has its own.
_STAGE = Scratch()


@contextmanager
def _scratch(spark: SparkSession):
    """Deletes the tables of the stage before, whose result is written by now, and collects those of this one."""
    mine = _RUN.get() or _STAGE
    mine.release(spark)
    with mine.open():
        yield


_RUN: ContextVar[Scratch | None] = ContextVar("run", default=None)


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order; n_chars is counted anew where the texts have changed."""
    kinds = dict(docs.dtypes)
    return changed.select(*(F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _scratch(spark):
        return quality_rules.keep_quality(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _scratch(spark):
        return _like(docs, line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _scratch(spark):
        return jaccard_join.keep_one(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _scratch(spark):
        return _like(docs, pii.sanitise(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _scratch(spark):
        return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/sitelens-pipeline-{uuid.uuid4().hex}"
    mine = Scratch()
    token = _RUN.set(mine)
    try:
        for k, (name, stage) in enumerate(STAGES):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    finally:
        _RUN.reset(token)
        mine.release(spark)
    return docs
