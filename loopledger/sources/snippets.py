"""Snippets in tables: request rows and scripts embedded in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

# fixed values: error texts
NO_CODE = "No code provided"
NO_DATA = "No data provided"
NOT_JSON = "Request body is not JSON"

REQUEST_SCHEMA = "code string, language string"


def snippets(df: DataFrame, code: str = "code", language: str | None = "language") -> DataFrame:
    """Source units from a table of snippets; blank ones carry an error.

    ``auto`` is no language name, so it leads to detection like any other such text.
    """
    declared = F.col(language) if language else F.lit(None).cast("string")
    others = [c for c in df.columns if c not in (code, language)]
    text = F.coalesce(F.col(code), F.lit(""))
    return df.select(
        *others, text.alias("code"), declared.alias("declared_language"),
        F.when(is_blank(text), F.lit(NO_CODE)).alias("error"),
    )


def parse_requests(df: DataFrame, body: str = "value") -> DataFrame:
    """Snippets from JSON texts ``{"code": ..., "language": ...}``.

    A body that is no JSON object, an empty one and one with blank code are told apart.
    """
    others = [c for c in df.columns if c != body]
    text, broken = F.col(body), "_broken"
    schema = f"{REQUEST_SCHEMA}, {broken} string"
    read = F.from_json(text, schema, {"columnNameOfCorruptRecord": broken})
    no_data = text.isNull() | text.rlike(r"^\s*(null|false|0|\"\"|\[\s*\]|\{\s*\})?\s*$")
    parsed = df.select(*others, read.alias("r"), no_data.alias("no_data")).select(
        *others, "r.code", "r.language",
        F.when(F.col("no_data"), F.lit(NO_DATA)).when(F.col(f"r.{broken}").isNotNull(), F.lit(NOT_JSON)).alias("refused"),
    )
    units = snippets(parsed)
    return units.withColumn("error", F.coalesce("refused", "error")).drop("refused")


def embedded_scripts(pages: DataFrame, html: str = "html") -> DataFrame:
    """One snippet per ``<script>`` element: the other columns, ``script_no``, ``code``."""
    others = [c for c in pages.columns if c != html]
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>"), F.lit(1))
    return pages.select(*others, F.posexplode(found).alias("pos", "code")).select(
        *others, (F.col("pos") + 1).alias("script_no"), "code"
    )
