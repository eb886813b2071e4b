"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier over the presence of words and of marks of style (symbols,
words said twice in a row), fitted on labelled documents, gives every document a
posterior over the domains.  Nonnegative rates (expected copies) are then fitted to
all documents so that the expected token totals of the domains meet the targets:
least squares by (accelerated) projected gradient.  All rates start at one copy; a step takes the
gap of every domain from the totals, moves each document's rate against its
posterior-weighted gaps and cuts it off at the bound.  A round is one sum of the size
of the number of domains over all documents; the rates follow from the posteriors, the
steps since and a table of rates that is stored every few rounds.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents, least by
hash.  A word counts where its preference for a domain is marked and significant in
that sample; there is no cap on their number, and their table is broadcast only
up to ``BROADCAST_WORDS`` rows and joined beyond.  Counts, totals and rates cover all
documents and all words of their texts.

Defined cases: a null or empty text has no words and gets the domain priors and
no tokens, so its rate stays 1; labels of unknown domains and labels without a
document are ignored, a document with two labels counts for both; without labels
all domains are equally likely; rows that repeat are documents of their own; a
target of domains without any tokens cannot be met and the rates are the
least-squares ones (:func:`totals` tells what is met); very long texts are cut into
words whole; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, put_back, read_table, row_hashes, set_apart, text_or_empty

TRAIN_ROWS = 20_000
BROADCAST_WORDS = 200_000  # rows of the classifier's table (a hash and a weight per domain) that may be broadcast
SIGNIFICANT = 4.0  # standard deviations of a word's log-ratio
EFFECT = 1.5  # least size of a log-ratio: weaker preferences go with topic or language, and add up
ROUNDS = 100
STORED = 6  # steps between two tables of rates
PROGRESS = 3e-6  # of the first loss
RIDGE = 1e-6  # pull of rates to one copy: of rates that meet the targets alike, those nearest to it
#: share of the tokens that each domain of the labelled table should get
TARGETS = {"clean": 0.97, "junk": 0.03, "toxic": 0.0}
#: a rate this near to a whole number is that number of copies: rounding error and the ridge's own bias
SNAP = RIDGE
#: the chances from here on, around the end to the start, add a copy: their share is the rest of a rate
FIRST_CHANCE = 0.7
#: upper ends of the classes of a share that a mark of style has among the words
_SHARES = (0.0, 0.05, 0.2, 0.5)


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _style(name: str, count: Column, n: Column) -> Column:
    """A pseudo word: the class of the share of ``count`` in ``n``."""
    share = count / F.greatest(n, F.lit(1))
    level = reduce(lambda rest, k: F.when(share <= _SHARES[k], F.lit(k)).otherwise(rest), reversed(range(len(_SHARES))), F.lit(len(_SHARES)))
    return F.concat(F.lit(f"\x00{name}"), level.cast("string"))


def _with_words(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``n_tokens`` and ``_words``: hashes of the distinct words (letters and digits only) and marks of style."""
    text = text_or_empty(text)
    low = F.lower(text)
    rows = rows.withColumn("n_tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    n = F.col("n_tokens")
    again = F.regexp_count(low, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))"))  # words that are said again at once
    marks = F.array(_style("again", again, n), _style("symbols", F.regexp_count(text, F.lit("[#*$%&|<>]+")), n))
    bare = F.array_distinct(F.transform(F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w)))
    words = F.when(n > 0, F.concat(bare, F.transform(marks, lambda w: F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("_words", words)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic first, else by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def _score_words(words: DataFrame, weights: DataFrame, names: list[str], k: range) -> DataFrame:
    """Summed log-ratios ``s0, ...`` per row of ``words`` and flags ``e0, ...`` of words that speak for a domain."""
    if weights.count() <= BROADCAST_WORDS:  # a stored table: the count reads no data
        weights = F.broadcast(weights)
    scored = words.join(weights, "word", "left")
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k]
    flags = [F.coalesce(F.max(F.col(f"w{i}") > 0), F.lit(False)).alias(f"e{i}") for i in k]
    return scored.groupBy(*names).agg(*sums, *flags)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    """Table ``(word, w0, w1, ...)`` of log-ratios, log priors, and what a text without
    any word for a domain says about it (log-ratios)."""
    sample = labels.where(F.col("domain").isin(domains)).select("doc_id", "domain")
    sample = sample.orderBy(F.xxhash64("doc_id", "domain"), "doc_id").limit(TRAIN_ROWS)  # at most TRAIN_ROWS: broadcast
    texts = docs.select(F.col("doc_id").alias("_doc_id"), "text")
    some = texts.join(F.broadcast(sample), F.col("_doc_id") == F.col("doc_id"))
    some = some.dropDuplicates(["domain", "text"])  # copies are no evidence of their own
    some = _with_words(some.select(F.monotonically_increasing_id().alias("_row"), "domain", "text"), "text")
    words = materialise(some.select("_row", "domain", F.explode_outer("_words").alias("word")), "sample")
    k = range(len(domains))
    rows = {r["domain"]: r["n"] for r in words.groupBy("domain").agg(F.countDistinct("_row").alias("n")).collect()}
    size = [rows.get(d, 0) for d in domains]
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    counts = words.where("word is not null").groupBy("word").agg(*per)
    everything, columns, sure = _total([F.col(f"c{i}") for i in k]), [], []
    for i in k:
        own, rest = F.col(f"c{i}") + 0.5, everything - F.col(f"c{i}") + 0.5
        ratio = F.log(own / (size[i] + 1)) - F.log(rest / (sum(size) - size[i] + 1))
        z = F.abs(ratio) / F.sqrt(1 / own + 1 / rest)
        ok = (z >= SIGNIFICANT) & (F.abs(ratio) >= EFFECT)
        columns.append(F.when(ok, ratio).otherwise(0.0).alias(f"w{i}"))
        sure.append(F.when(ok, z).otherwise(0.0))
    weights = counts.select("word", *columns, (F.greatest(*sure) if len(sure) > 1 else sure[0]).alias("z")).where("z > 0")
    weights = materialise(weights.drop("z"), "words")
    prior = [float(np.log((n + 1) / (sum(size) + len(domains)))) for n in size]

    flagged = _score_words(words, weights, ["_row", "domain"], k)
    silent = [F.sum(F.when(~F.col(f"e{i}"), 1).otherwise(0)).alias(f"n{i}") for i in k]
    seen = {r["domain"]: r for r in flagged.groupBy("domain").agg(F.count("*").alias("n"), *silent).collect()}
    absence = []
    for i, d in enumerate(domains):
        own = (seen[d][f"n{i}"], seen[d]["n"]) if d in seen else (0, 0)
        other = [(r[f"n{i}"], r["n"]) for x, r in seen.items() if x != d]
        quiet, n = sum(x for x, _ in other), sum(x for _, x in other)
        absence.append(float(np.log((own[0] + 1) / (own[1] + 2)) - np.log((quiet + 1) / (n + 2))))
    return weights, prior, absence


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], keep: list[Column]) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``p0, p1, ...`` of every row of ``docs``."""
    weights, prior, absence = fit_classifier(docs, labels, domains)
    k = range(len(domains))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col("text").alias("_text"))
    rows = _with_words(rows, "_text").drop("_text")
    names = [c for c in rows.columns if c != "_words"]
    words = rows.select(*names, F.explode_outer("_words").alias("word"))
    scored = _score_words(words, weights, names, k)
    says = [
        F.col(f"s{i}") + prior[i] + F.when(~F.col(f"e{i}") & (F.col("n_tokens") > 0), absence[i]).otherwise(0.0) for i in k
    ]
    scored = scored.select(*names, *[says[i].alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k]) if len(domains) > 1 else F.col("s0")
    mass = [F.exp(F.col(f"s{i}") - top) for i in k]
    return scored.select(*names, *[(mass[i] / _total(mass)).alias(f"p{i}") for i in k])


def _sums(table: DataFrame, rate: Column, k: range) -> np.ndarray:
    """Expected totals of the domains at ``rate``."""
    got = table.agg(*[F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")).alias(f"a{i}") for i in k]).first()
    return np.array([float(got[f"a{i}"] or 0) for i in k])


def _moments(table: DataFrame, free: Column, k: range) -> np.ndarray:
    """Second moments of the posteriors of the rows that are ``free``, weighted by tokens."""
    n = F.when(free, F.col("n_tokens")).otherwise(0)
    got = table.agg(*[F.sum(n * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in k for j in range(i + 1)]).first()
    return np.array([[float(got[f"m{max(i, j)}_{min(i, j)}"] or 0) for j in k] for i in k])


def fit_rates(table: DataFrame, targets: list[float], lower: float = 0.0, budget: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Add ``rate`` to ``table(n_tokens, p0, p1, ...)``.

    Minimises ``(A r - T)' W (A r - T) / 2`` over ``r >= lower``, near one copy: ``A r`` are the
    expected domain totals, ``T`` the targets, ``W`` the inverse second moments of the
    posteriors, in which domains that overlap are told apart.  A step on the rate of a row with
    posteriors ``p`` is ``r - p V (A r - T)``, cut off at ``lower``, in the metric of the tokens.
    First ``V`` are the inverse moments of the rows not at the bound, which closes the gaps at
    once but for the cut; such steps go on as long as each halves the loss.  Then ``V = W``: the
    plain gradient, whose Lipschitz constant is 1, so whole steps go down.  They start from a
    point ahead of the last two (accelerated, and anew where that overshoots), until two in turn
    gain less than ``PROGRESS`` of the first loss or a thousandth of what is left.
    Every ``STORED`` steps the rates are stored.

    ``budget`` is the number of tokens of the mixture; by default the largest for
    which no domain needs more tokens than it has.
    """
    k = range(len(targets))
    share = np.array(targets, float) / sum(targets)
    columns = table.columns
    total = _sums(table, F.lit(1.0), k)
    if budget is None:
        budget = min((total[i] / share[i] for i in k if share[i] > 0), default=0.0)
    moments = _moments(table, F.lit(True), k)
    want, weight, size = share * budget, np.linalg.pinv(moments, rcond=1e-9, hermitian=True), max(budget, total.sum(), 1.0)

    def loss(reached: np.ndarray) -> float:
        return float((reached - want) @ weight @ (reached - want))

    def moved(state: DataFrame, start: str, pull: np.ndarray) -> DataFrame:
        r = F.col(start) * (1 - RIDGE) + RIDGE - _total([F.col(f"p{i}") * float(pull[i]) for i in k])
        return state.withColumn("_new", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(float(lower)), r)).otherwise(1.0))

    state, stored, slow, momentum, ahead = table.withColumns({"_rate": F.lit(1.0), "_ahead": F.lit(1.0)}), None, 0, 1.0, total
    first, scaled = loss(total), True
    for done in range(1, rounds + 1):
        if np.abs(total - want).max() <= 1e-7 * size:
            break
        if scaled:
            if done > 1:
                moments = _moments(state, F.col("_rate") > lower, k)
            state = moved(state, "_rate", np.linalg.pinv(moments, rcond=1e-6, hermitian=True) @ (total - want))
        else:
            state = moved(state, "_ahead", weight @ (ahead - want))
        reached = _sums(state, F.col("_new"), k)
        before, after, far = loss(total), loss(reached), 0.0
        if scaled and after >= before:
            scaled = False  # back to where it was
            state = state.drop("_new").withColumn("_ahead", F.col("_rate"))
            ahead = total
            continue
        if scaled:
            scaled = after <= 0.5 * before
        else:
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            far = (momentum - 1) / following if after <= before else 0.0
            momentum = following if after <= before else 1.0
            slow = slow + 1 if abs(before - after) <= max(PROGRESS * first, 1e-3 * after) else 0
        state = state.withColumn("_ahead", F.col("_new") + (F.col("_new") - F.col("_rate")) * float(far)).select(*columns, F.col("_new").alias("_rate"), "_ahead")
        ahead, total = reached + far * (reached - total), reached
        if slow == 2:
            break
        if done % STORED == 0:
            state = materialise(state, "rates")
            drop_scratch(stored)
            stored = state
    rated = F.when(F.col("n_tokens") > 0, F.greatest(F.col("_rate"), F.lit(float(lower)))).otherwise(1.0)
    return state.withColumn("rate", rated).select(*columns, "rate")


def totals(rated: DataFrame, domains: list[str]) -> DataFrame:
    """What a fitted mixture holds: ``(domain, tokens, mixed)``, expected tokens at one copy and at the rates."""
    one = [F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"a{i}") for i in range(len(domains))]
    mixed = [F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p{i}")).alias(f"b{i}") for i in range(len(domains))]
    rows = [F.struct(F.lit(d).alias("domain"), F.col(f"a{i}").alias("tokens"), F.col(f"b{i}").alias("mixed")) for i, d in enumerate(domains)]
    return rated.agg(*one, *mixed).select(F.inline(F.array(*rows)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: list[Column], lower: float = 0.0, budget: float | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens``, posteriors ``p0, p1, ...`` in the order of ``targets`` and ``rate``.

    ``labels(doc_id, domain)`` names domains of ``targets``.
    """
    table = materialise(posteriors(docs, labels, list(targets), keep), "posteriors")
    return fit_rates(table, list(targets.values()), lower, budget)


def copies(rate: Column, chance: Column) -> Column:
    """Whole copies of a rate, one more with the rest's probability if ``chance`` is even over [0, 1)."""
    whole = F.round(rate)
    more = F.pmod(chance - FIRST_CHANCE, F.lit(1.0)) < rate - F.floor(rate)
    return F.when(F.abs(rate - whole) <= SNAP, whole).otherwise(F.floor(rate) + more.cast("int")).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as its rate says; columns unchanged.

    Rows equal in every column have one rate and are named by two hashes over all
    columns.  Documents that stay once are not looked up.
    """
    rows, names = set_apart(docs)
    k1, k2 = row_hashes(rows)
    rows = rows.withColumns({"k1": k1, "k2": k2})
    known = rows.select("k1", "k2", F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"))
    rates = mix(known, labels, targets or TARGETS, [F.col("k1").alias("k1"), F.col("k2").alias("k2")])
    chance = F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(1 << 20)) / float(1 << 20)
    changed = rates.select("k1", "k2", copies(F.col("rate"), chance).alias("copies")).where("copies != 1")
    changed = materialise(changed.groupBy("k1", "k2").agg(F.max("copies").alias("copies")), "copies")
    rows = rows.join(changed, ["k1", "k2"], "left")
    rows = rows.withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return put_back(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rates of all documents for the production targets."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    mixed = mix(docs, label_domains(labels), TARGETS, [F.col("doc_id").alias("doc_id")])
    return mixed.select("doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(TARGETS)], "rate")
