"""What the operators of this folder share: written intermediate tables and texts as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import scratch_path

# White space that ends a word in the size and fingerprint contracts: fixed values.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back.

    Lineage ends here: a lost executor costs the tasks that read the table, not the work that made it.
    The sizes that the planner sees afterwards are the true ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))
