"""Host-level quality rules, in DataFrame functions only.

Each document is measured once (words, symbols, repeated lines, repeated 3-word
windows) and judged by a few rules.  Failures are aggregated by host, the rates
are shrunk with a beta prior fitted to all hosts by moments, and a host whose
shrunk rate of some rule passes that rule's limit loses all its documents.

Repeated windows are found inside the row: window hashes are sorted with their
positions, so a text of n words costs n log n and nothing is shuffled.

Defined cases: a null text counts as no text (no words: it fails the length
rule); documents without a host form one host of their own; repeated rows are
judged row by row; very long texts are measured whole, inside their row; an empty table gives no rows; columns of the input other than
id, text and host are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: rule -> (expression that is true for a failing document, largest shrunk host rate)
RULES = {
    "short": ("n_words < 50", 0.5),
    "repeats": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", 0.5),
}
BASE_RULES = ("short", "repeats")


def _repeat_words(sorted_windows: str) -> Column:
    """Words covered by windows that are found twice, from sorted (hash, position)."""
    s = F.col(sorted_windows)

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each document: ``(id, host, n_words, word_chars, ...)``."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text")
    )
    rows = rows.select(
        "id",
        "host",
        F.array_remove(F.split("text", SPACE + "+"), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    w = F.col("w")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    no_windows = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select(
        "id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.when(F.size("w") >= 4, windows).otherwise(no_windows)).alias("windows"),
    )
    rows = rows.withColumn("at", _repeat_words("windows")).drop("windows")
    at = F.col("at")
    covered = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", total).drop("at")


def _prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Beta prior of each rule by document-weighted moments over the hosts.

    Two rows of sums reach the driver, whatever the number of hosts.
    """
    wanted: list[Column] = []
    pooled = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"k_{r}").alias(r) for r in RULES]).first()
    if not pooled["n"]:
        return {r: (1.0, 1.0) for r in RULES}
    mean = {r: pooled[r] / pooled["n"] for r in RULES}
    for r in RULES:
        wanted.append((F.sum(F.col("n") * (F.col(f"k_{r}") / F.col("n") - mean[r]) ** 2) / pooled["n"]).alias(r))
    spread = hosts.agg((F.count("*") / pooled["n"]).alias("inverse"), *wanted).first()
    prior = {}
    for r in RULES:
        m, within = mean[r], mean[r] * (1 - mean[r])
        between = spread[r] - within * spread["inverse"]  # what binomial noise does not explain
        strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6
        prior[r] = (m * strength, (1 - m) * strength)
    return prior


def host_verdicts(counts: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per host: documents, failures, shrunk rates and the verdict."""
    limits = {r: limit for r, (_, limit) in RULES.items()} | (limits or {})
    failed = [F.sum(F.expr(e).cast("long")).alias(f"k_{r}") for r, (e, _) in RULES.items()]
    hosts = materialise(counts.groupBy("host").agg(F.count("*").alias("n"), *failed), "hosts")
    prior = _prior(hosts)
    for r, (a, b) in prior.items():
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    over = F.lit(False)
    for r in RULES:
        over = over | (F.col(f"rate_{r}") > F.lit(limits[r]))
    return hosts.withColumn("host_failed", over)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Counts of every document with ``base_failed``, ``host_failed`` and ``kept``.

    The host table is written first: its measured size decides whether Spark
    broadcasts it or splits the hot hosts of a sort-merge join.
    """
    counts = materialise(document_counts(docs, id_col, text_col, host_col), "quality")
    hosts = materialise(host_verdicts(counts, limits).select(F.col("host").alias("_host"), "host_failed"), "hosts")
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | F.expr(RULES[r][0])
    out = counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents."""
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _sql() -> str:
    kinds = ", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS k_{r}" for r, (e, _) in RULES.items())
    means = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}" for r in RULES)
    spreads = ", ".join(f"sum(n * (k_{r} / n - m_{r}) ** 2) / sum(n) - any_value(m_{r} * (1 - m_{r})) * count(*) / sum(n) AS b_{r}" for r in RULES)
    strength = ", ".join(
        f"CASE WHEN b_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / b_{r} - 1, 1.0), 1e6) ELSE 1e6 END AS s_{r}" for r in RULES
    )
    over = " OR ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) > {limit}" for r, (_, limit) in RULES.items())
    base = " OR ".join(f"({RULES[r][0]})" for r in BASE_RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i:i+2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
n AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {kinds} FROM n GROUP BY source),
m AS (SELECT {means} FROM h),
b AS (SELECT {spreads} FROM h, m),
s AS (SELECT {strength} FROM m, b),
v AS (SELECT source, ({over}) AS host_failed FROM h, m, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       NOT ({base}) AND NOT host_failed AS kept
FROM n JOIN v ON n.source IS NOT DISTINCT FROM v.source"""


OP9_SQL = _sql()
