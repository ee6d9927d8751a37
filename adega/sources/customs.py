"""Customs export table (country, state, product group, transport mode, kg, US$ FOB).

The original is a spreadsheet sheet; spreadsheets are not a Spark source, so the
table is read from parquet or CSV with a fixed schema (export the sheet first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Column headers of the customs sheet, in sheet order of use.
CUSTOMS_HEADER = {
    "Países": "country",
    "UF do Produto": "state",
    "Código CUCI Grupo": "group_code",
    "Via": "via",
    "Quilograma Líquido": "net_kg",
    "Valor US$ FOB": "fob_usd",
}

CUSTOMS_SCHEMA = StructType([
    StructField("country", StringType(), True),
    StructField("state", StringType(), True),
    StructField("group_code", IntegerType(), True),
    StructField("via", StringType(), True),
    StructField("net_kg", DoubleType(), True),
    StructField("fob_usd", DoubleType(), True),
])


def scan_customs(spark: SparkSession, path: str, fmt: str = "parquet",
                 original_headers: bool = False) -> DataFrame:
    """Read the customs table.  With ``original_headers=True`` the file carries
    the sheet's Portuguese headers (CSV export); they are renamed to the API names
    and typed with ``try_cast`` so a bad cell becomes null instead of failing."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path) if original_headers else \
            spark.read.option("header", True).schema(CUSTOMS_SCHEMA).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if original_headers:
        df = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in CUSTOMS_HEADER.items()])
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CUSTOMS_SCHEMA.fields])
