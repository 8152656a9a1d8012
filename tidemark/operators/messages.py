"""Recent context of a session as one text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clip_message
from tidemark.operators.windows import recent_per_session

# How roles are shown, and how many messages make a context.
ROLE_LABELS: Mapping[str, str] = {"user": "用户"}
OTHER_ROLE = "助手"
CONTEXT_MESSAGES = 12


def recent_context(
    df: DataFrame,
    n: int = CONTEXT_MESSAGES,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    clip: int | None = None,
    labels: Mapping[str, str] = ROLE_LABELS,
    other: str = OTHER_ROLE,
) -> DataFrame:
    """The last ``n`` messages of a session, oldest first, one ``role：text`` line each.

    At most ``n`` messages, whole or of at most ``clip`` characters, are collected per session.
    """
    shown = None
    for name, label in labels.items():
        hit = F.col(role) == name
        shown = F.when(hit, label) if shown is None else shown.when(hit, label)
    shown = F.lit(other) if shown is None else shown.otherwise(other)
    recent = recent_per_session(df, n, session, order, text)
    line = F.concat(shown, F.lit("："), clip_message(text, clip))
    gathered = recent.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("_l"))
    return gathered.select(
        session,
        F.size("_l").cast("bigint").alias("messages"),
        F.array_join(F.col("_l")["line"], "\n").alias("context"),
    )
