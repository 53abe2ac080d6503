"""Generated product documents, for load tests: every column is an expression of the row number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRANDS = ["Nordhof", "Talgrund", "Sonnacker", "Birkenau", "Riedmühle", "Kornlieb"]
KINDS = ["Apfelmus", "Dinkelbrot", "Haferdrink", "Joghurt", "Linsensuppe", "Müsli", "Olivenöl", "Quark", "Reiswaffeln", "Tomatensoße"]
TRAITS = ["natur", "fein", "mild", "kräftig", "ungesüßt", "cremig"]
SIZES = ["100 g", "250 g", "500 g", "1 kg", "330 ml", "0,5 l", "1,5%"]
CATEGORIES = ["bakery", "dairy", "drinks", "pantry", "snacks", "spreads"]


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``(title, category, organic, price)`` for n products; the same for the same seed, whatever the partitions."""

    def draw(salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 31))

    def pick(words: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(draw(salt), F.lit(len(words))) + 1).cast("int"))

    organic = F.pmod(draw(5), F.lit(3)) == 0
    title = F.concat_ws(" ", pick(BRANDS, 1), F.when(organic, "Bio"), pick(TRAITS, 2), pick(KINDS, 3), pick(SIZES, 4))
    price = F.round(F.lit(0.49) + F.pmod(draw(7), F.lit(1_951)) / 100, 2)
    return spark.range(n).select(title.alias("title"), pick(CATEGORIES, 6).alias("category"), organic.alias("organic"), price.alias("price"))
