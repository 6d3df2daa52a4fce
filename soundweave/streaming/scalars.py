"""The stateless functions over streams.

Nothing here keeps state: each row of a stream gets its sound, or its distance from a fixed word, as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import phonology as P


def with_pronunciation(stream: DataFrame, reading: str = "reading") -> DataFrame:
    """Adds codes, phonemes, ipa, mora_count and vowel_skeleton; built-in functions only."""
    code = F.col("codes")
    return stream.withColumn("codes", P.codes(F.col(reading))).withColumns({"phonemes": P.phoneme_string(code), "ipa": P.ipa(code), "mora_count": P.mora_count(code), "vowel_skeleton": P.vowel_skeleton(code)})


def with_similarity(stream: DataFrame, query: str, reading: str = "reading") -> DataFrame:
    """Adds distance and similarity to the query's reading."""
    asked = P.codes(F.lit(query))
    df = stream.withColumn("_a", asked).withColumn("_b", P.codes(F.col(reading)))
    df = df.withColumn("distance", D.edit_distance(F.col("_a"), F.col("_b")))
    return df.withColumn("similarity", P.round4(D.similarity(F.col("distance"), F.length("_a"), F.length("_b")))).drop("_a", "_b")
