"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents; the
last adds the shard. Mixing returns a row for each pass over a document, with the stretches of its
text that the mix takes. Extra columns of the documents pass through all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fablespark.llm._spark import staged
from fablespark.llm.decontaminate import pipeline_decontaminate
from fablespark.llm.mixing import pipeline_mixing
from fablespark.llm.quality_mcd import pipeline_quality
from fablespark.llm.setsketch import pipeline_near_dedup
from fablespark.llm.sharding import pipeline_sharding

STAGES = [
    ("quality", pipeline_quality),
    ("near_dedup", pipeline_near_dedup),
    ("decontaminate", pipeline_decontaminate),
    ("mixing", pipeline_mixing),
    ("sharding", pipeline_sharding),
]

#: The stages fit models and draw at random, which SQL does not express; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
