"""The corpus pipeline: toxicity, language, exact copies, near copies, packing. Each stage's rows are written
as Parquet in the shared folder and read again as the next one's documents.

Defined cases: null and empty texts are kept by toxicity (if clean) and rejected by language, which finds no
letter in them; very long texts pass every stage whole; of equal texts the row with the largest id stays, of near
copies that whose id names the component, and one row where such a row is repeated or ids tie; rows of a null id
give way to others; an empty table gives no sequences; columns beyond those of documents, whatever their names,
stay until packing, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelode.llm import exact_dedup, language_id, packing, simhash, toxicity
from sourcelode.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash", simhash.stage),
    ("packing", packing.stage),
]

#: Toxicity, language, fingerprints and token ids are beyond SQL: the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
