"""Predictions for images as they arrive: the batch plan of ``plans.inference`` on the files of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.inference import Bundle, predict_images

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files of a micro-batch at most; their paths pass through the driver.
AT_ONCE = 1000


def predict_arrivals(spark: SparkSession, folder: str, bundle: Bundle, out: str, checkpoint: str, suffix: str = ".jpg", once: bool = True, at_once: int = AT_ONCE) -> StreamingQuery:
    """Write ``path, pred, probabilities`` of new images under ``folder`` to Parquet files at ``out``, one folder
    ``batch=n`` for each micro-batch, overwritten if the batch is run again: each image is reported once. The stream
    carries paths; images are read by Spark's image source, which can't be a stream itself. An image that can't be
    decoded ends the stream with an error that names it."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", at_once).load(folder).select("path")

    def predict(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            images = batch.sparkSession.read.format("image").option("dropInvalid", False).load(paths)
            found = predict_images(images.select(F.col("image.origin").alias("path"), "image"), bundle)
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(predict).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
