"""What the queries share: reading tables, and the transliteration fixture.

The tables hold Latin text. One fixed translation of letters gives every
operator of the script real work and both engines the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import read_table

# Letters and their stand-ins.
LATIN = "abcdefghijklmnopqrstuvwxyz .,"
SCRIPT = "འབཅདེཕགཧིཇཀལམནོཔངརསཏུཝྱཞཡཟ་།༎"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def script_text(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, SCRIPT)


SCRIPT_SQL = f"translate(lower(text), '{LATIN}', '{SCRIPT}')"
#: White space of Python's str.split, as DuckDB's patterns spell it.
WHITE_SQL = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQUEEZED_SQL = f"trim(regexp_replace(text, '[{WHITE_SQL}]+', ' ', 'g'))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with nothing for null texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null and text <> ''")


def script_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", script_text(F.col("text")))
