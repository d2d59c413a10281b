"""Names of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyspark.llm import chat, decontaminate
from tallyspark.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = sorted((n for n in vars(q) if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))
    return {n: getattr(q, n) for n in names} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "op2_decontaminate": decontaminate.ORACLE}
