"""Domains that the labelled table tells apart, and their target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic documents, else by quality; null without either label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
