"""A training corpus from raw documents, in five stages.

Toxic documents go; lines that repeat earlier ones go; one document of each group of near
duplicates stays (five words, similarity 0.8); the sources are mixed to their target
weights, documents repeating as the mix asks; the mix is encoded as byte-level BPE ids.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, the last one
doc_id, ids, n_tokens and the digest of the decoded bytes. Null and empty texts pass the
filters; the mix takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transcurve.llm import bpe, common, jaccard, line_dedup, mixing, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard", jaccard.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: Stages learn, hash and draw: no SQL states their rows. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents; what a stage returns is materialised for the next."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
