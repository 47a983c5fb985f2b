"""Normalised documents of tickets and logs, validation queries (FN-08, FN-09, FN-40, SET-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _labelled(parts: list[tuple[str, Column]]) -> Column:
    return tx.clean_text(F.concat_ws(" ", *[F.when(tx.blank(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts]))


def ticket_documents(tickets: DataFrame) -> DataFrame:
    """FN-08: labelled content and embedding text; tickets without any content go. ``nan`` tags are no tags."""
    tags = F.array_join(F.filter("tags", lambda t: (t != "") & (F.lower(t) != "nan")), ", ")
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c)).otherwise("")
    col = lambda c: tx.blank(F.col(c))
    content = F.concat_ws(
        "\n", F.concat(F.lit("Subject: "), col("subject")), F.concat(F.lit("Description: "), col("description")), F.concat(F.lit("Resolution: "), col("resolution")), F.when(tags != "", F.concat(F.lit("Tags: "), tags))
    )
    embedding = _labelled(
        [
            ("ticket subject", col("subject")),
            ("issue description", col("description")),
            ("known resolution", col("resolution")),
            ("priority", known("priority")),
            ("ticket type", known("ticket_type")),
            ("support queue", col("queue")),
            ("business type", col("business_type")),
            ("tags", tags),
        ]
    )
    rows = tickets.withColumn("content", tx.clean_text(content)).withColumn("embedding_text", embedding).where("content <> ''")
    return rows.select(
        F.concat_ws("_", F.lit("ticket"), "source_dataset", "ticket_id").alias("doc_id"),
        F.lit("ticket").alias("source_type"),
        F.when(col("subject") != "", F.col("subject")).otherwise(F.concat(F.lit("Ticket "), F.col("ticket_id"))).alias("title"),
        "content",
        F.when(F.col("embedding_text") != "", F.col("embedding_text")).otherwise(F.col("content")).alias("embedding_text"),
        "ticket_id",
        "source_dataset",
        "priority",
        "ticket_type",
        "queue",
        "business_type",
        "status",
    )


def log_documents(logs: DataFrame) -> DataFrame:
    """FN-09: cleaned message (or raw line) as content, ``SYSTEM severity log`` as title."""
    content = tx.clean_text(tx.preferred(F.col("message"), F.col("raw_log")))
    known = lambda c: F.when(F.col(c) != "unknown", F.col(c)).otherwise("")
    embedding = _labelled([("system", known("system")), ("severity", known("severity")), ("component", tx.blank(F.col("component"))), ("log message", content)])
    return logs.withColumn("content", content).where("content <> ''").select(
        F.concat_ws("_", F.lit("log"), "source_dataset", "log_id").alias("doc_id"),
        F.lit("log").alias("source_type"),
        F.concat_ws(" ", F.upper("system"), "severity", F.lit("log")).alias("title"),
        "content",
        embedding.alias("embedding_text"),
        "log_id",
        "source_dataset",
        "system",
        "severity",
    )


def all_documents(tickets: DataFrame, logs: DataFrame) -> DataFrame:
    """SET-02."""
    return ticket_documents(tickets).unionByName(log_documents(logs), allowMissingColumns=True)


def validation_query(title: Column, *fields: Column) -> Column:
    """FN-40: title, fields and the first 240 characters of the last one."""
    return tx.collapse(F.concat_ws(" ", title, *fields[:-1], F.substring(fields[-1], 1, 240)))
