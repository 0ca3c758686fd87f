"""lokalith: localization-catalog engine on Spark DataFrames."""
