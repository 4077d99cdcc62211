"""The stateless Column functions on a streaming DataFrame.

The source pipeline is batch-only (no stream, watermark or stateful
operator), so nothing here is a new operator: the same cleaning and
extraction Columns run unchanged on ``readStream`` input, with a
checkpointed ``foreachBatch``/file sink for exactly-once output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.functions import text as TX
from talentflow.plans import presets as P
from talentflow.session import checkpoint_dir


def clean_text_stream(spark: SparkSession, src_dir: str, schema: str, id_col: str,
                      text_col: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming read of Parquet text rows -> cleaned text, counts and skills."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(src_dir))
    return s.select(id_col,
                    TX.light_clean(text_col, drop_contact=True).alias("text_clean"),
                    TX.word_count(text_col).alias("word_count"),
                    X.dict_extract(text_col, P.SKILL_PATTERNS).alias("skills"))


def run_to_parquet(stream: DataFrame, out_dir: str, name: str) -> None:
    """Drain all available input into Parquet with a checkpoint in the shared folder."""
    ck = os.path.join(checkpoint_dir(stream.sparkSession), "streams", name)
    q = (stream.writeStream.format("parquet").option("path", out_dir)
               .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
