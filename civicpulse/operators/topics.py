"""Topic rules compiled to one Column, topic limits and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TopicQuery
from ..functions import normalize as N
from ..functions.constants import TOPIC_RULES

OTHER = "other"
TopicRule = tuple[str, Sequence[str]]


def check_rules(rules: Sequence[TopicRule]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Labels must not be empty and every rule needs a keyword that is not blank."""
    out = []
    for label, keywords in rules:
        words = tuple(" ".join(k.split()).lower() for k in keywords if k.strip())
        if not label.strip() or not words:
            raise ValueError("A topic rule needs a label and a keyword.")
        out.append((label.strip(), words))
    return tuple(out)


class TopicRules:
    """Rule sets by complaint type; one registry per engine, not per process."""

    def __init__(self, rules: dict[str, Sequence[TopicRule]] | None = None) -> None:
        self._rules = {k: check_rules(v) for k, v in (TOPIC_RULES if rules is None else rules).items()}

    def register(self, complaint_type: str, rules: Sequence[TopicRule]) -> None:
        self._rules[" ".join(complaint_type.split())] = check_rules(rules)

    def select(self, complaint_type: str, custom: dict[str, Sequence[TopicRule]] | None = None) -> tuple:
        """Custom rules first, then registered ones; an empty custom rule set means the fallback."""
        if custom is not None and complaint_type in custom:
            return check_rules(custom[complaint_type])
        return self._rules.get(complaint_type, ())


def rule_topic(text: Column, rules: Sequence[TopicRule]) -> Column:
    """Topic of a normalised text: the first rule with any matching keyword."""
    out = None
    for label, keywords in rules:
        hit = N.any_of([N.matches_keyword(text, k) for k in keywords])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(OTHER) if out is None else out.otherwise(OTHER)


def limit_topics(assigned: DataFrame, top_n: int) -> DataFrame:
    """Topics beyond the ``top_n`` most frequent become ``other``.

    Ties go to the topic whose first request id is least: rows have no order of
    their own.  The kept topics are at most ``top_n`` names, a bounded broadcast.
    """
    counts = assigned.groupBy("topic").agg(F.count("*").alias("n"), F.min("service_request_id").alias("first_id"))
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last("first_id"), "topic").limit(top_n).select(F.col("topic").alias("_top"))
    out = assigned.join(F.broadcast(top), F.col("topic") == F.col("_top"), "left")
    return out.withColumn("topic", F.coalesce("_top", F.lit(OTHER))).drop("_top")


def extract_topics(requests: DataFrame, query: TopicQuery, custom_rules: dict[str, Sequence[TopicRule]] | None = None,
                   registry: TopicRules | None = None) -> DataFrame:
    """Requests of the query's complaint type (compared as written) with ``topic`` and ``normalized_text``."""
    rules = (registry or TopicRules()).select(query.complaint_type, custom_rules)
    # a column of its own: referenced often, so the optimizer computes it once per row
    rows = requests.where(F.col("complaint_type") == query.complaint_type).withColumn("_text", N.topic_text(F.col("descriptor")))
    text = F.col("_text")
    if rules:
        topic = F.when(text == "", OTHER).otherwise(rule_topic(text, rules))
        labels = len({label for label, _ in rules} | {OTHER})
    else:
        topic, labels = N.topic_label(text), None
    out = rows.withColumns({"normalized_text": N.topic_label(text), "topic": topic}).drop("_text")
    # a rule set of at most top_n labels needs no count of topics, hence no second pass
    return out if labels is not None and labels <= query.top_n else limit_topics(out, query.top_n)


def topic_coverage(requests: DataFrame, query: TopicQuery, custom_rules=None, top_unmatched_n: int = 10,
                   registry: TopicRules | None = None) -> DataFrame:
    """One row: matched and other records, the rate, and the most frequent unmatched descriptors."""
    assigned = extract_topics(requests, query, custom_rules, registry)
    other = (F.col("topic") == OTHER).cast("long")
    totals = assigned.agg(F.count("*").alias("total_records"), F.coalesce(F.sum(other), F.lit(0)).cast("long").alias("other_records"))
    top = unmatched_descriptors(assigned, top_unmatched_n)
    order = Window.orderBy(F.desc("n"), F.asc_nulls_last("first_id"), "descriptor")
    listed = top.withColumn("k", F.row_number().over(order)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "descriptor", "n"))), lambda x: F.struct(x["descriptor"].alias("descriptor"), x["n"].alias("n")))
        .alias("top_unmatched_descriptors")
    )  # at most top_unmatched_n rows
    out = totals.join(F.broadcast(listed))
    matched = F.col("total_records") - F.col("other_records")
    return out.select(
        F.lit(query.complaint_type).alias("complaint_type"), "total_records", matched.alias("matched_records"), "other_records",
        F.when(F.col("total_records") > 0, matched / F.col("total_records")).otherwise(0.0).alias("coverage_rate"),
        "top_unmatched_descriptors",
    )


def unmatched_descriptors(assigned: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent descriptors of topic ``other``: ``(descriptor, n, first_id)``."""
    counts = assigned.where(F.col("topic") == OTHER).groupBy("descriptor").agg(
        F.count("*").alias("n"), F.min("service_request_id").alias("first_id")
    )
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("first_id"), "descriptor").limit(n)


def label_rows(summaries: DataFrame, limit: int) -> DataFrame:
    """The dominant topics that a map labels: largest geographies first, then the least dominant, then by name."""
    order = [F.desc("geography_total_count"), "share_of_geography", "geography_value"]
    return summaries.where("is_dominant_topic and complaint_count > 0").orderBy(*order).limit(limit)
