"""Line dedup with a suffix array over line-ID sequences.

Every document is the sequence of its lines (blank ones left out, white space at
the ends of a line ignored).  Suffixes of these sequences are ranked by
distributed prefix doubling: the ranks at depth 2d come from the pairs of ranks
at depth d of positions i and i + d.  Suffixes that are alone with their prefix
are final and drop out, so the table of a round holds repeated runs only.  A
group of equal rank at depth m is an interval of the suffix array whose longest
common prefix is at least m: a run of m lines found more than once.

A run counts as repeated when it has at least ``min_words`` words.  The least m
that reaches them depends on the lines alone, so equal runs share it, and a maximal
repeated run is the union of the intervals at these depths that lie in it, but for the
lines at its end that no window of ``min_words`` words reaches.  With ``whole_runs``
(the ``op1`` query and the pipeline's stage) the windows of a line also grow to every
length up to where the next line's window ends, so that one of them ends at each line a
run can end with: their union is exactly that of all maximal repeated runs of
``min_words`` words or more, however long (tested against the definition).  Ranks beyond
that depth would name longer prefixes of lines that are already covered, so doubling
ends there.

Of the members of an interval the first in corpus order (document id,
row, line) stays; the lines of the later copies are deleted, together with blank
lines inside such a run.  A copy that overlaps its own first occurrence is a
later copy too.

Defined cases: a null or blank text has no lines and is returned as it is;
documents that repeat a whole earlier document lose all lines and get an empty
text; repeated rows are copies like any other (one of them stays); rows with a
null id come first in corpus order; very long texts are cut into lines whole; an
empty table gives no rows; every column of the input is carried along, whatever its
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, prefix_sums, put_back, read_table, set_apart, text_or_empty

MIN_WORDS = 10
_SPACE = r"[\x20\x09-\x0D]"


def order_ranks(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``r``: how many suffixes (column ``n``) lie in groups before this one."""
    return prefix_sums(groups.select(*keys, "n"), keys, "n", "r").drop("n")


def document_lines(rows: DataFrame, min_words: int, whole_runs: bool = False) -> DataFrame:
    """One row per non-blank line of ``rows(_row, _id, _text)``.

    ``j`` counts non-blank lines, ``raw`` all lines of the document; ``m`` is the
    least number of lines from here that has ``min_words`` words, null if the
    document ends before.  ``upto`` is the longest window that starts here: ``m``,
    or with ``whole_runs`` the last length at which the lines after this one have
    fewer than ``min_words`` words.
    """
    trimmed = F.transform(
        F.split("_text", "\n"), lambda x, i: F.struct(i.alias("raw"), F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "").alias("s"))
    )
    lines = rows.select("_row", "_id", F.filter(trimmed, lambda x: x["s"] != "").alias("l"))
    lines = lines.select(
        "_row",
        "_id",
        F.transform(
            "l",
            lambda x: F.struct(
                x["raw"].alias("raw"),
                F.xxhash64(x["s"]).alias("h1"),
                F.xxhash64(F.lit(1), x["s"]).alias("h2"),
                (F.regexp_count(x["s"], F.lit(_SPACE + "+")) + 1).alias("words"),
            ),
        ).alias("l"),
    )
    def needed(j: Column) -> Column:
        return F.aggregate(
            F.slice("l", j + 1, min_words),
            F.struct(F.lit(0).alias("m"), F.lit(0).alias("words")),
            lambda acc, x: F.when(acc["words"] >= min_words, acc).otherwise(
                F.struct((acc["m"] + 1).alias("m"), (acc["words"] + x["words"]).alias("words"))
            ),
            lambda acc: F.when(acc["words"] >= min_words, acc["m"]),
        )

    placed = F.transform(
        "l",
        lambda x, j: F.struct(
            j.alias("j"), x["raw"].alias("raw"), x["h1"].alias("h1"), x["h2"].alias("h2"), x["words"].alias("words"),
            needed(j).alias("m"),
        ),
    )
    if not whole_runs:
        return lines.select("_row", "_id", F.inline(placed)).withColumn("upto", F.col("m"))
    lines = lines.select("_row", "_id", placed.alias("l"))
    longest = F.transform(
        "l", lambda x, j: x.withField("upto", F.greatest(x["m"], F.coalesce(F.get("l", j + 1)["m"], F.size("l") - j)))
    )
    return lines.select("_row", "_id", F.inline(longest))


def repeated_windows(lines: DataFrame) -> DataFrame:
    """Later copies ``(_row, j, m)`` of the suffix-array intervals at the depths ``m`` to ``upto``."""
    spots = lines.select("_row", "_id", "j", "m", "upto", "h1", "h2")
    groups = spots.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ranks = materialise(order_ranks(groups, ["h1", "h2"]), "ranks")
    level = materialise(spots.join(ranks, ["h1", "h2"]).select("_row", "_id", "j", "m", "upto", "r"), "level")
    return _later_copies(level)


def _later_copies(level: DataFrame) -> DataFrame:
    """Doubling from the stored ranks of single lines on; only lines found more than once are left."""
    depth, found, old = 1, [], []
    while True:
        ahead = level.select("_row", F.col("j").alias("_at"), F.col("r").alias("r2"))
        # windows whose depth lies between this level and the next: two overlapping prefixes name them
        due = level.where((F.col("upto") >= depth) & (F.col("m") < 2 * depth))
        sizes = F.sequence(F.greatest("m", F.lit(depth)), F.least("upto", F.lit(2 * depth - 1)))
        due = due.withColumn("m", F.explode(sizes)).withColumn("_at", F.col("j") + F.col("m") - depth)
        found.append(materialise(due.join(ahead, ["_row", "_at"]).select("_row", "_id", "j", "m", "r", "r2"), "windows"))
        old.append(level)
        pairs = level.withColumn("_at", F.col("j") + depth).join(ahead, ["_row", "_at"]).drop("_at")
        more = level.where("m is not null").agg(F.max("upto").alias("m")).first()["m"]
        if more is None or more < 2 * depth:
            break
        pairs = materialise(pairs, "pairs")
        groups = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
        ranks = materialise(
            order_ranks(groups.withColumnRenamed("r", "_r1"), ["_r1", "r2"]).select("_r1", "r2", "r"), "ranks"
        )
        level = pairs.withColumnRenamed("r", "_r1").join(ranks, ["_r1", "r2"]).select("_row", "_id", "j", "m", "upto", "r")
        level = materialise(level, "level")
        depth *= 2
    windows = None
    for k, w in enumerate(found):
        w = w.withColumn("k", F.lit(k))
        windows = w if windows is None else windows.unionByName(w)
    place = F.struct("_id", "_row", "j")
    key = ["k", "m", "r", "r2"]
    firsts = windows.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialise(firsts, "firsts")  # a table of its own: the join below can be split where an interval is large
    later = windows.join(firsts, key).where(~place.eqNullSafe(F.col("first"))).select("_row", "j", "m")
    later = materialise(later, "later")
    for table in [*found, *old]:
        drop_scratch(table)
    return later


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """Maximal runs to delete: ``(_row, start, stop, n_lines, n_words)``, raw line numbers, both included."""
    lines = materialise(document_lines(rows, min_words, whole_runs), "lines")
    later = repeated_windows(lines)
    gone = later.select("_row", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("m") - 1)).alias("j")).distinct()
    gone = gone.join(lines.select("_row", "j", "raw", "words"), ["_row", "j"])
    within = Window.partitionBy("_row").orderBy("j")
    islands = gone.withColumn("island", F.col("j") - F.row_number().over(within))
    return islands.groupBy("_row", "island").agg(
        F.min("raw").alias("start"), F.max("raw").alias("stop"),
        F.count("*").alias("n_lines"), F.sum("words").alias("n_words"),
    ).drop("island")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, whole_runs: bool = False
) -> DataFrame:
    """All rows of ``docs`` with ``_clean`` (text without later copies) and ``_removed``.

    ``_removed`` is null where nothing was deleted, else the runs in order as an
    array of structs ``(start, stop, n_lines, n_words)``.  Columns of the input that
    have these two names give way to them.
    """
    rows, names = set_apart(docs)
    names = {c: inner for c, inner in names.items() if c not in ("_clean", "_removed")}
    out = _cleaned(rows, names[id_col], names[text_col], min_words, whole_runs)
    return out.select(*[F.col(inner).alias(c) for c, inner in names.items()], F.col("clean").alias("_clean"), F.col("removed").alias("_removed"))


def _cleaned(rows: DataFrame, id_col: str, text_col: str, min_words: int, whole_runs: bool) -> DataFrame:
    """``rows`` (set apart) with ``clean`` and ``removed``."""
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "docs")
    texts = rows.select(F.col("row").alias("_row"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    runs = repeated_runs(texts, min_words, whole_runs)
    per_row = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "n_lines", "n_words"))).alias("removed"))
    out = rows.join(per_row.withColumnRenamed("_row", "row"), "row", "left")
    out = out.withColumn("lines", F.when(F.col("removed").isNotNull(), F.split(text_or_empty(text_col), "\n")))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda k: F.slice(
            F.col("lines"),
            F.coalesce(F.get("removed", k - 1)["stop"] + 2, F.lit(1)),
            F.coalesce(F.get("removed", k)["start"], F.size("lines")) - F.coalesce(F.get("removed", k - 1)["stop"] + 1, F.lit(0)),
        ),
    )
    clean = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(gaps), "\n"))
    return out.withColumn("clean", clean)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of whole runs cut out of ``text``; documents left without a word go."""
    rows, names = set_apart(docs)
    out = _cleaned(rows, names["doc_id"], names["text"], min_words, True)
    out = out.where(F.col("removed").isNull() | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("clean")}
    if "n_chars" in names:
        own = F.col(names["n_chars"])
        changed["n_chars"] = F.when(F.col("removed").isNull(), own).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return put_back(out, names, changed)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted line runs of all documents and a digest of what is left."""
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), whole_runs=True)
    runs = F.transform("_removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string")))
    return out.select(
        "doc_id",
        F.coalesce(F.array_join(runs, ","), F.lit("")).alias("removed"),
        F.coalesce(F.aggregate("_removed", F.lit(0).cast("long"), lambda s, x: s + x["n_lines"]), F.lit(0).cast("long")).alias("n_removed_lines"),
        F.coalesce(F.aggregate("_removed", F.lit(0).cast("long"), lambda s, x: s + x["n_words"]), F.lit(0).cast("long")).alias("n_removed_words"),
        F.sha2(F.coalesce("_clean", F.lit("")), 256).alias("text_sha256"),
    )


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS raw_line, unnest(range(len(string_split(t, chr(10))))) AS raw FROM d),
l AS (SELECT rid, doc_id, raw, s, len(regexp_split_to_array(s, '[ 	-
]+')) AS words,
             row_number() OVER (PARTITION BY rid ORDER BY raw) - 1 AS j
      FROM (SELECT *, regexp_replace(raw_line, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS s FROM raw) WHERE s <> ''),
a AS (SELECT *, list(s) OVER ahead AS nxt, list(words) OVER ahead AS w FROM l
      WINDOW ahead AS (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND {2 * MIN_WORDS - 1} FOLLOWING)),
m AS (SELECT *, list_position(list_transform(range(1, len(w) + 1), lambda k: list_sum(w[1:k]) >= {MIN_WORDS}), true) AS m FROM a),
e AS (SELECT rid, j, nxt, unnest(range(m, len(w) + 1)) AS k FROM m WHERE m > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY nxt[1:k] ORDER BY rid, j) AS copy FROM e),
g AS (SELECT DISTINCT rid, unnest(range(j, j + k)) AS j FROM c WHERE copy > 1),
i AS (SELECT l.*, j - row_number() OVER (PARTITION BY rid ORDER BY j) AS island FROM l SEMI JOIN g USING (rid, j)),
r AS (SELECT rid, min(raw) AS a, max(raw) AS b, count(*) AS n, sum(words) AS w FROM i GROUP BY rid, island),
x AS (SELECT rid, string_agg(a || ':' || b, ',' ORDER BY a) AS removed, sum(n) AS n, sum(w) AS w FROM r GROUP BY rid),
k AS (SELECT raw.rid, string_agg(raw_line, chr(10) ORDER BY raw) AS clean FROM raw
      ANTI JOIN r ON raw.rid = r.rid AND raw.raw BETWEEN r.a AND r.b GROUP BY raw.rid)
SELECT doc_id, coalesce(removed, '') AS removed, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(w, 0) AS BIGINT) AS n_removed_words, sha256(coalesce(clean, '')) AS text_sha256
FROM d LEFT JOIN x USING (rid) LEFT JOIN k USING (rid)"""
