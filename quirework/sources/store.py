"""Documents as folders of Parquet tables: new, open, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def new_document(spark: SparkSession, doc_id: int = 0) -> dict[str, DataFrame]:
    """A document with one default page; other tables are empty."""
    tables = {name: spark.createDataFrame([], ddl) for name, ddl in schema.TABLES.items()}
    page = new_pages(spark.range(1).select(F.lit(doc_id).alias("doc_id")))
    document = spark.range(1).select(F.lit(doc_id).cast("long").alias("id"), F.lit(2).cast("long").alias("next_id"), F.lit(False).alias("modified"))
    return tables | {"page": page, "document": tables["document"].unionByName(document, allowMissingColumns=True)}


def new_pages(documents: DataFrame) -> DataFrame:
    """documents: doc_id. The default page of each new document, in the page table's columns: letter size, an inch of margin, white."""
    return documents.select(
        F.lit(1).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("page_idx"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
        *[F.lit(72.0).alias(f"margin_{side}") for side in ("top", "bottom", "left", "right")],
        F.struct(*[F.lit(1.0).alias(c) for c in "rgba"]).alias("background"), F.lit(False).alias("modified"), F.lit(None).cast(schema.METADATA).alias("metadata"),
    )


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def open_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in schema.TABLES.items()}
