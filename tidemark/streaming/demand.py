"""Extension: the row-level stages and monthly demand on streams.

The keyword stages are column expressions, so they run on a stream as they are; demand is a watermarked window sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keywords as K


def scored(stream: DataFrame, config: K.Config = K.Config()) -> DataFrame:
    """A stream of canonical keywords, enriched, scoped and scored; clustered is known only in batch."""
    return K.scores(K.scopes(K.enrich(stream, config), config).withColumn("clustered", F.lit(False)), config)


def demand(stream: DataFrame, key: str, value: str, at: str = "ts", window: str = "30 days", late: str = "7 days") -> DataFrame:
    """(key, window start, demand) of event-time windows; events later than `late` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.sum(value).alias("demand"), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "demand", "n")
