"""Titles whose files need a profile of their own, by the names of their folders and programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Normalized name and profile.
TITLES = {
    "NevernessToEverness": "NevernessToEverness",
    "NevernessToeEverness": "NevernessToEverness",
    "HT": "NevernessToEverness",
    "AshEchoes": "AshEchoes",
    "WutheringWaves": "WutheringWaves",
    "KuroGames": "WutheringWaves",
    "InZOI": "InZOI",
    "MarvelRivals": "MarvelRivals",
    "MarvelsSRivals": "MarvelRivals",
    "DeadByDaylight": "DeadByDaylight",
    "FragPunk": "FragPunk",
    "InfinityNikki": "InfinityNikki",
    "Snowbreak": "Snowbreak",
    "SnowbreakContainmentZone": "Snowbreak",
}


def titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TITLES.items()), "name string, title string")
