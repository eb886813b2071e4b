"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  A
wider net proposes more candidates: telephone numbers without a country code,
addresses written with "at" and "dot", numbers of the form of a social security
number, secrets and access keys.  Labelers (regular expressions, gazetteers of
cue words and of placeholders, and the context) vote yes, no or abstain on every
candidate, base ones included.  No labeler and no feature says whether a candidate
is a base one.  Expectation-maximisation over the counts of all vote patterns of a
kind estimates how reliable each labeler is on that kind, under a prior that a vote
is more often right than wrong; its posteriors train one logistic span classifier
on the kind, the shape and the context, weighted by the counts of all candidates.
A candidate that the classifier accepts and that overlaps no base span becomes a span.

The patterns and features take a bounded number of values (3 ** 6 and 2 ** 8 per
kind), so what reaches the driver is one small table of counts over the whole corpus.

Defined cases: a null text counts as empty and has no spans; matches that fail
their check (parts of an ip, digits, Luhn) are dropped without another try;
offsets are code points, the end excluded; very long texts are scanned whole, in
time linear in their length; repeated rows are scanned each; an empty table gives
no rows and trains nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# within a run of digits no later start can succeed where the first fails, and
# possessive repeats give up nothing that could match: long runs cost linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# candidates beyond the base
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]|\.[0-9])")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[.%+-]*+([A-Za-z0-9_][A-Za-z0-9._%+-]*+) ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++"
)
# key word and separator are found together, so other assignments consume nothing of a secret;
# a value ends at the next parameter of a URL, not at any other "&"
_ASSIGNED = re.compile(
    r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?:[^\s,;\"'<>&]|&(?!(?:amp;)?[\w.%\[\]-]+=)){6,}+"
)
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")

#: cue words before a span, by kind
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("password", "passwd", "pwd", "credential", "login", "auth", "bearer"),
}
#: words that name other numbers and codes
OTHER = ("version", "release", "order", "invoice", "part no", "isbn", "model", "page", "serial", "example", "e.g.")
#: values that documentation uses as placeholders
PLACEHOLDERS = ("0.0.0.0", "127.0.0.1", "255.255.255.255", "password", "changeme", "secret", "xxxx", "0000000000", "1234567890", "none", "null", "true", "false")
LABELERS = ("shape", "cue", "placeholder", "context", "variety", "other")
FEATURES = ("shape", "cue", "placeholder", "bounded", "numeric_near", "variety", "mixed", "other")
_NUMERIC_BEFORE = re.compile(r"[0-9]\s*\Z")
_NUMERIC_AFTER = re.compile(r"\s*[0-9]")
_KEY = re.compile(r"[^=:]*[=:]\s*[\"']?")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", begin, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def more_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the wider net that overlap no base span and no earlier candidate."""
    found: list[tuple[str, int, int]] = []
    if "AKIA" in text or "ASIA" in text:
        found += [("secret", *m.span()) for m in _ACCESS_KEY.finditer(text)]
    found += [("secret", *m.span()) for m in _ASSIGNED.finditer(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    found += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [("email", m.start(1), m.end()) for m in _SPELT.finditer(text)]
    taken, out = sorted((s, e) for _, s, e in base), []
    starts = [s for s, _ in taken]
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        k = int(np.searchsorted(starts, e)) - 1
        if (k < 0 or taken[k][1] <= s) and (not out or out[-1][2] <= s):
            out.append((kind, s, e))
    return out


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Votes of the labelers in base 3 (0 no, 1 abstain, 2 yes) and feature bits of a candidate."""
    value = text[start:end]
    lower = value.lower()
    before = text[max(0, start - 40) : start]
    digits = _digits(value)
    core = lower  # what tells a secret from a word: the value behind the key word
    if kind == "secret" and (key := _KEY.match(lower)):
        core = lower[key.end() :]
    near = before.lower()
    cue = any(c in near or (kind == "secret" and c in lower) for c in CUES[kind])
    other = any(w in near for w in OTHER)
    placeholder = any(lower.endswith(p) for p in PLACEHOLDERS) or (len(digits) > 6 and len(set(digits)) < 3)
    bounded = (not before or not before[-1].isalnum()) and (end >= len(text) or not text[end].isalnum())
    numeric_near = bool(_NUMERIC_BEFORE.search(before) or _NUMERIC_AFTER.match(text[end : end + 4]))
    variety = len(set(core)) >= 6 and not (kind == "secret" and core.isalpha())
    mixed = any(c.isdigit() for c in core) and any(c.isalpha() for c in core)
    if kind == "email":
        shape = "." in value or "dot" in lower
    elif kind == "secret":
        shape = mixed and len(core) >= 6
    elif kind == "ssn":
        shape = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    elif kind == "phone" and value[0] != "+":
        shape = digits[0] not in "01" and digits[3] not in "01"
    else:
        shape = True
    votes = (
        2 if shape else 0,  # regular expressions: form of the kind
        2 if cue else 1,  # gazetteer of cue words
        0 if placeholder else 1,  # gazetteer of placeholders
        2 if bounded and not numeric_near else 0,  # context: stands alone
        2 if variety else 0,  # variety of characters
        0 if other else 1,  # context: named as something else
    )
    bits = (shape, cue, placeholder, bounded, numeric_near, variety, mixed, other)
    return sum(v * 3**k for k, v in enumerate(votes)), sum(int(b) << k for k, b in enumerate(bits))


#: prior of a labeler's votes (no, abstain, yes) on wrong and right candidates, and its weight:
#: so many candidates, and such a share of all of the kind
_PRIOR = np.array([[0.45, 0.35, 0.2], [0.1, 0.35, 0.55]])
_PRIOR_ROWS, _PRIOR_SHARE = 40.0, 0.02
RIDGE = 1e-5  # of the span classifier; every kind weighs 1


def estimate(patterns: dict[int, float], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote pattern and the labelers' tables ``(labeler, class, vote)``.

    Two-class Dawid-Skene by expectation-maximisation over pattern counts, started
    from the share of yes votes among the votes cast.  The prior on the tables ties
    the second class to yes votes: candidates on which all agree stay in one class.
    """
    keys = sorted(patterns)
    labelers = len(LABELERS)
    if not keys:
        return {}, np.full((labelers, 2, 3), 1 / 3)
    votes = np.array([[k // 3**j % 3 for j in range(labelers)] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    cast = np.maximum((votes != 1).sum(axis=1), 1)
    p = np.clip((votes == 2).sum(axis=1) / cast, 0.05, 0.95)
    rows = _PRIOR_ROWS + _PRIOR_SHARE * n.sum()
    pull = _PRIOR * rows
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        prior = (weight.sum(axis=1) + rows / 2) / (n.sum() + rows)
        table = np.stack([[[c[votes[:, j] == v].sum() for v in range(3)] for c in weight] for j in range(labelers)]) + pull
        table /= table.sum(axis=2, keepdims=True)
        score = np.log(prior)[:, None] + sum(np.log(table[j][:, votes[:, j]]) for j in range(labelers))
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
    return dict(zip(keys, p.tolist(), strict=True)), table


def _row_of(cell: int) -> list[int]:
    """Features of a classifier cell: the bits, one entry per kind (its intercept)."""
    bits, kind = cell & 255, cell >> 8
    return [bits >> k & 1 for k in range(8)] + [int(kind == k) for k in range(len(KINDS))]


def train_classifier(weighted: list[tuple[int, float, float]], rounds: int = 400) -> np.ndarray:
    """Logistic regression; rows ``(kind << 8 | bits, count, mean posterior)``."""
    size = len(_row_of(0))
    if not weighted:
        return np.zeros(size)
    x = np.array([_row_of(c) for c, _, _ in weighted], float)
    n, y = np.array([w[1] for w in weighted], float), np.array([w[2] for w in weighted])
    # every kind weighs the same, however many candidates another kind has
    kinds = np.array([c >> 8 for c, _, _ in weighted])
    n = n / np.bincount(kinds, n, len(KINDS))[kinds]
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(size)
        step = np.linalg.solve(hessian, x.T @ (n * (p - y)) + RIDGE * w)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def accept_probability(weights: np.ndarray, cell: int) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(_row_of(cell), weights))))))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1):
            text = text.as_py()
            base = base_spans(text)
            spans = [(*s, True) for s in base] + [(*s, False) for s in more_candidates(text, base)]
            rows.append([
                {"kind": k, "start": s, "end": e, "base": b, "votes": v, "cell": KINDS.index(k) << 8 | f}
                for k, s, e, b in spans for v, f in [votes_and_features(text, k, s, e)]
            ])
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows, _SPANS)], names=["id", "found"])


_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("cell", pa.int32())])
)
_FOUND = "id long, found array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:int,cell:int>>"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row ``(id, spans)`` per document, spans as structs ``(kind, start, end, base, score)``.

    ``score`` is the classifier's probability; base spans are in whatever it says.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = materialise(texts.mapInArrow(_find, _FOUND), "pii")
    each = found.select(F.explode("found").alias("s"))
    cells = each.groupBy(F.col("s.votes").alias("votes"), F.col("s.cell").alias("cell")).count().collect()
    cells = [(r["votes"], r["cell"], r["count"]) for r in cells]
    means: dict[int, list[float]] = {}
    for kind in range(len(KINDS)):
        own = [c for c in cells if c[1] >> 8 == kind]
        patterns: dict[int, float] = {}
        for votes, _, n in own:
            patterns[votes] = patterns.get(votes, 0) + n
        posterior, _ = estimate(patterns)
        for votes, cell, n in own:
            total = means.setdefault(cell, [0.0, 0.0])
            total[0] += n
            total[1] += n * posterior[votes]
    weights = train_classifier([(c, n, s / n) for c, (n, s) in sorted(means.items())])
    table = F.create_map(*[F.lit(x) for c in sorted(means) for x in (c, accept_probability(weights, c))]) if means else None
    scored = F.transform(
        "found",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
            (F.element_at(table, s["cell"]) if table is not None else F.lit(0.0)).alias("score"),
        ),
    )
    return found.select("id", F.filter(scored, lambda s: s["base"] | (s["score"] >= accept)).alias("spans"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = []
        added: list[list[int]] = []
        shas, joined = [], []
        for spans in batch.column(1).to_pylist():
            named = lambda some: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in some)
            spans = sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"]))
            base = [s for s in spans if s["base"]]
            counts.append([sum(s["kind"] == k for s in base) for k in BASE])
            shas.append(hashlib.sha256(named(base).encode()).hexdigest())
            joined.append(named(spans))
            added.append([sum(s["kind"] == k for s in spans) for k in KINDS[4:]] + [len(spans)])
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        more = [pa.array([c[k] for c in added], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(shas, pa.string()), pa.array(joined, pa.string()), *more],
            names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_ssn", "n_secret", "n_spans"],
        )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents; ``n_spans`` counts base and added ones."""
    found = pii_spans(read_table(spark, sf_dir, "documents"))
    return found.mapInArrow(
        _digest,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_ssn long, n_secret long, n_spans long",
    )
