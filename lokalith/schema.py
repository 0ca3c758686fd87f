"""The one record type: a localization catalog row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG = "key string, namespace string, source string, translation string, url string, hash string, ns_hash bigint, key_hash bigint, src_path string, container string, ord bigint"


def catalog_from(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as a catalog: given columns by name, empty strings, 0 and null for the rest. Null text becomes ''."""
    empty = {"translation": F.lit(""), "namespace": F.lit(""), "ns_hash": F.lit(0), "key_hash": F.lit(0)}
    out = []
    for field in CATALOG.split(", "):
        name, kind = field.split(" ")
        c = columns.get(name, empty.get(name, F.lit(None))).cast(kind)
        out.append((F.coalesce(c, F.lit("")) if name in ("key", "namespace", "source", "translation") else c).alias(name))
    return df.select(*out)
