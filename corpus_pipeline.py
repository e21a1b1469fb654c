"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.bpe import stage_bpe
from threadloom.llm.minhash import stage_near_dups
from threadloom.llm.mixing import stage_mixing
from threadloom.llm.quality import stage_quality
from threadloom.llm.secrets import stage_secrets
from threadloom.storage import remove, shared_dir

STAGES = [("quality rules", stage_quality), ("near duplicates", stage_near_dups), ("secret scans", stage_secrets), ("source mixing", stage_mixing), ("bpe encoding", stage_bpe)]

#: Forests, trained taggers and encodings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote goes as soon as the next one is written; the last one's stays for whoever reads the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
