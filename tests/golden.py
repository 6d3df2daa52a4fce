"""The rows of FIXTURES.md, part A1, that the known answers of the tests rest on."""

from pyspark.sql import functions as F

from soundweave.sources.vocabulary import with_sound

ROWS = [
    ("チョコビ", "チョコビ", "固有名詞", "product", 15000, 0.101),
    ("チョコボール", "チョコボール", "固有名詞", "product", 8000, 0.250),
    ("チョコパイ", "チョコパイ", "固有名詞", "product", 8000, 0.250),
    ("地球儀", "チキュウギ", "普通名詞", "common", 7000, 0.250),
    ("手首", "テクビ", "普通名詞", "common", 4000, 0.654),
    ("仕組み", "シクミ", "普通名詞", "common", 4500, 0.500),
    ("竹輪", "チクワ", "普通名詞", "common", 6000, 0.281),
    ("ラーメン", "ラーメン", "普通名詞", "common", 1400, 0.692),
    ("ローメン", "ローメン", "普通名詞", "common", 9000, 0.115),
    ("電車", "デンシャ", "普通名詞", "common", 3000, 0.865),
    ("松茸", "マツタケ", "普通名詞", "common", 6500, 0.369),
    ("空", "ソラ", "普通名詞", "common", 3000, 0.855),
    ("科学", "カガク", "普通名詞", "common", 2000, 0.965),
    ("価格", "カカク", "普通名詞", "common", 2000, 0.866),
    ("東京", "トウキョウ", "固有名詞", "place", 2800, 1.000),
    ("田中", "タナカ", "固有名詞", "person", 3000, 0.858),
    ("仕組", "シクミ", "普通名詞", "common", 5000, 0.500),
    ("し組み", "シクミ", "一般", "common", 12000, 0.250),
]


def lexicon(spark):
    df = spark.createDataFrame(ROWS, "surface string, reading string, pos string, category string, cost int, familiarity double")
    return with_sound(df.withColumn("familiarity", F.col("familiarity").cast("float")).withColumn("normalized", F.col("surface")))
