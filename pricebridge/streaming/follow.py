"""Product documents as they arrive. The batch engine does not need this; it saves reading old files again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricebridge.sources import products


def follow_products(spark: SparkSession, folder: str, out: str, checkpoint: str, ingested_at: str) -> StreamingQuery:
    """Validate the documents of folder that no earlier run has seen: kept rows go to out/products, the others to
    out/rejects, each under the number of its batch, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = products.checked(products.product_rows(batch)).persist()
        good, bad = products.split(rows, ingested_at)
        good.write.mode("overwrite").parquet(f"{out}/products/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        rows.unpersist()

    files = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    documents = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.upper(F.sha2("value", 256)).alias("sha256"))
    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
