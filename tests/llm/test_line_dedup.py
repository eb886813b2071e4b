import random

import pytest

from civicpulse.llm.line_dedup import drop_repeated_lines, line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(docs, min_words):
    """docs: list of (id, text) in corpus order -> cleaned texts."""
    first, gone = {}, []
    for d, (_, text) in enumerate(docs):
        lines = (text or "").split("\n")
        spots = [i for i, x in enumerate(lines) if x.strip(WS)]
        seq = [lines[i].strip(WS) for i in spots]
        bad = set()
        for i in range(len(seq)):
            words, m = 0, 0
            while words < min_words and i + m < len(seq):
                words += len(seq[i + m].split())
                m += 1
            if words >= min_words and first.setdefault(tuple(seq[i : i + m]), (d, i)) != (d, i):
                bad |= set(range(i, i + m))
        cut, run = set(), []
        for j in [*sorted(bad), None]:
            if run and (j is None or j != run[-1] + 1):
                cut |= set(range(spots[run[0]], spots[run[-1]] + 1))
                run = []
            if j is not None:
                run.append(j)
        gone.append("\n".join(x for i, x in enumerate(lines) if i not in cut) if bad else text)
    return gone


@pytest.mark.parametrize("min_words", [1, 4, 10])
def test_equals_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)] + ["", "  ", "one long line of eleven words is here for the test"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[3][1]), (63, "same\n" * 50), (64, "same\n" * 70 + "end")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, _id int, source string")
    got = {r.doc_id: r._clean for r in line_dedup(df.repartition(3), min_words=min_words).collect()}
    assert got == {i: t for (i, _), t in zip(docs, brute(docs, min_words), strict=True)}


def test_long_run_and_repeated_rows(spark):
    run = "\n".join(f"line number {i} of a long shared passage" for i in range(500))
    rows = [(1, run, 5), (2, "intro here\n" + run + "\noutro", 6), (3, run, 7), (3, run, 7), (None, "lonely words", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str) == sorted(
        [(1, run, 5), (2, "intro here\noutro", 16), (None, "lonely words", 1), (None, None, None)], key=str
    )


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_whole(docs, min_words):
    """Every repeated run of lines with ``min_words`` words in all, straight from the definition."""
    first, gone = {}, []
    for d, (_, text) in enumerate(docs):
        lines = (text or "").split("\n")
        seq = [(i, x.strip(WS)) for i, x in enumerate(lines) if x.strip(WS)]
        bad = set()
        for i in range(len(seq)):
            for e in range(i + 1, len(seq) + 1):
                run = tuple(x for _, x in seq[i:e])
                if sum(len(x.split()) for x in run) >= min_words and first.setdefault(run, (d, i)) != (d, i):
                    bad |= set(range(i, e))
        cut = {seq[j][0] for j in bad}
        cut |= {k for j in bad if j + 1 in bad for k in range(seq[j][0], seq[j + 1][0])}
        gone.append("\n".join(x for i, x in enumerate(lines) if i not in cut) if bad else text)
    return gone


@pytest.mark.parametrize("min_words", [1, 4, 10])
def test_whole_runs_equal_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)] + ["", "  ", "one long line of eleven words is here for the test"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[3][1]), (63, "same\n" * 50), (64, "same\n" * 70 + "end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r._clean for r in line_dedup(df.repartition(3), min_words=min_words, whole_runs=True).collect()}
    assert got == {i: t for (i, _), t in zip(docs, brute_whole(docs, min_words), strict=True)}


def test_the_stage_leaves_no_tail_of_a_repeated_run(spark):
    run = "this line is long enough to be a run on its own\nand a short tail"
    df = spark.createDataFrame([(1, run), (2, "before\n" + run + "\nafter"), (3, run)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df).collect()} == {1: run, 2: "before\nafter"}


def test_query_and_sql_equal_the_definition(spark, tmp_path):
    """The registered query and its SQL against all repeated runs, whatever their length."""
    import hashlib

    import duckdb

    from civicpulse.llm.line_dedup import OP1_SQL, op1_line_dedup

    rng = random.Random(77)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(9)] + ["", "  ", "one long line of eleven words is here for the test"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(50)]
    docs += [(50, None), (51, docs[3][1]), (52, "same\n" * 40), (53, "x\n" + docs[4][1] + "\nab\ncd\nef"), (54, "y\n" + docs[4][1] + "\nab\ncd\nef\ngh")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    want = brute_whole(docs, 10)
    assert {i: r.text_sha256 for i, r in rows.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for (i, _), t in zip(docs, want, strict=True)}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = db.sql(OP1_SQL)
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in sql.columns) for r in rows.values())


def test_very_long_text(spark):
    lines = [f"line {i} of a very long text that is like no other one" for i in range(30_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["head", *lines[100:20_000], "tail"])), (3, "word " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert got[1] == "\n".join(lines) and got[2] == "head\ntail" and len(got[3]) == 1_500_000
