"""Vectors by content: a table keyed by a hash of model and text, so that a text is embedded once, wherever it stands."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Provider
from ..shared import list_names, remove_path
from .store import NUMBER, picked

LAYOUT = "key string, made array<float>"
#: Keys that are looked up as literals, which reach the scan.
MOST_LITERALS = 10


class VectorTable:
    """Vectors of texts under root/vectors, added to and never changed: one text and model always give one vector.

    Of vectors that two writers add for one text, either serves. What a crashed writer leaves is whole files of right
    vectors, or nothing. Files are sorted by key, with Bloom filters on it.
    """

    def __init__(self, spark: SparkSession, root: str, provider: Provider):
        self.spark, self.path, self.provider = spark, f"{root.rstrip('/')}/vectors", provider

    def key(self, text: Column) -> Column:
        name = getattr(self.provider, "name", type(self.provider).__name__)
        return F.sha2(F.concat(F.lit(f"{name}|{self.provider.dim}|"), F.coalesce(text, F.lit(""))), 256)

    def known(self) -> DataFrame:
        names = list_names(self.spark, self.path)
        if not names:
            return self.spark.createDataFrame([], LAYOUT)
        return self.spark.read.schema(LAYOUT).parquet(*[f"{self.path}/{n}" for n in names])

    def embed(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """rows (text and others; cheap to read, as they are read again) with made, the vector of text; null: of the empty text.

        The provider sees each text that has no vector yet once: different ones are found first, and what it makes is
        written before anything is joined with it. few: keys of a few rows go to the scan as literals. Others must be
        numbered (store.at_rest): one row of each new text is picked by its number and embedded where it is read, so that
        only keys are dealt to find them.
        """
        keyed = rows.withColumn("_key", self.key(F.col("text")))
        known = self.known()
        if few:
            keys = [r[0] for r in keyed.select("_key").distinct().limit(MOST_LITERALS + 1).collect()]
            if len(keys) <= MOST_LITERALS:
                known = known.where(F.col("key").isin(keys))
        texts = keyed.groupBy(F.col("_key").alias("key"))
        if few:
            texts = texts.agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
            missing = texts.join(known.select("key"), "key", "left_anti").coalesce(1)
        else:
            texts = texts.agg(F.min(NUMBER).alias(NUMBER))
            missing = picked(keyed, texts.join(known.select("key"), "key", "left_anti")).select(F.col("_key").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        seen, target = Observation(), f"{self.path}/{uuid.uuid4().hex}"
        made = missing.sortWithinPartitions("key").select("key", self.provider.column(F.col("text")).alias("made")).observe(seen, F.count(F.lit(1)).alias("n"))
        made.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(target)
        if seen.get["n"]:
            known = known.unionByName(self.spark.read.schema(LAYOUT).parquet(target))
        else:
            remove_path(self.spark, target)
        # two writers may have added one key; only keys that are asked for are brought together
        wanted = known.join(texts.select("key"), "key", "left_semi").groupBy("key").agg(F.first("made").alias("made"))
        return keyed.join(wanted, keyed["_key"] == wanted["key"]).drop("_key", "key")
