"""Columns over texts of executions: statement ids, templates, masking, sizes and durations, plan flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is masked in texts that leave the system.
URI_AUTHORITY = r"(?i)(hdfs|s3a?|obs|oss|abfs|wasbs?)://([^/]+)"
SECRET = r"(?i)(password|passwd|secret|token|access[._-]?key|keytab|credential)(=|:)[^,;\s]+"


def statement_id(text: Column) -> Column:
    """The leading comment of a SQL text, trimmed, with inner white space collapsed; null if there is none or it is empty."""
    inner = F.regexp_extract(text, r"(?s)^\s*/\*\s*(.*?)\s*\*/", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def template(text: Column) -> Column:
    """SQL text without comments, literals and case, so that runs of one statement are equal."""
    x = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    x = F.regexp_replace(x, r"--[^\n]*", " ")
    x = F.regexp_replace(x, r"'(?:[^']|'')*'", "?")
    x = F.regexp_replace(x, r"\b\d+\b", "?")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def template_hash(text: Column) -> Column:
    return F.md5(template(text))


def redact(text: Column) -> Column:
    """Masks the authority of URIs, then the values of secrets."""
    return F.regexp_replace(F.regexp_replace(text, URI_AUTHORITY, "$1://***"), SECRET, "$1$2***")


def size_bytes(text: Column, default: int) -> Column:
    """`64m`, `4g`, `512kb` or plain bytes as bytes; anything else is the default."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*([kKmMgGtT]?)[bB]?\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([kKmMgGtT]?)[bB]?\s*$", 2))
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1)
    return F.when(text.isNull() | (n == ""), F.lit(default).cast("long")).otherwise(n.try_cast("long") * scale.cast("long"))


def duration_ms(text: Column, least: int = 60_000) -> Column:
    """`15m`, `1h`, `3600s`, `500ms` or plain milliseconds, at least `least`; anything else is null."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*(ms|s|m|h|d)?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+)\s*(ms|s|m|h|d)?\s*$", 2)
    scale = F.when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000).otherwise(1)
    return F.when(n != "", F.greatest(n.try_cast("long") * scale.cast("long"), F.lit(least).cast("long")))


def plan_features(plan: Column) -> dict[str, Column]:
    """Flags of a physical plan's text."""
    return {
        "sort_merge_join": plan.contains("SortMergeJoin"),
        "shuffled_hash_join": plan.contains("ShuffledHashJoin"),
        "cartesian": plan.contains("CartesianProduct"),
        "broadcast_join": plan.contains("BroadcastHashJoin"),
        "nested_loop": plan.contains("BroadcastNestedLoopJoin"),
        "empty_partition_filters": plan.contains("PartitionFilters: []"),
        "adaptive": plan.contains("AdaptiveSparkPlan"),
        "codegen_gap": ~plan.rlike(r"\*\(\d+\)|codegen id :|\* \w"),
    }


def plan_shape(plan: Column) -> Column:
    """Labels of what a plan does, in a fixed order."""
    labels = (("Broadcast", "broadcast"), ("SortMergeJoin", "sort-merge join"), ("Exchange", "exchange"), ("Aggregate", "aggregate"), ("Sort ", "sort"))
    has = [F.when(F.concat(plan, F.lit(" ")).contains(k), F.lit(v)) for k, v in labels]
    return F.array_join(F.array_compact(F.array(*has)), ", ")
