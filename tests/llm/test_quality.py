import re

from civicpulse.llm.quality import document_counts, quality_rules


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    spots: dict = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in spots.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a a a a", "a b c a b c", "x y x y x y z", "é ü ß # $ | <b> \x0b q",
    "line\nline\n\nline \nother", "to be or not to be " * 40, "w " * 60, " ".join(f"w{i}" for i in range(5000)),
    "lead " + "a b c d " * 3 + "tail",
]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words int")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in document_counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "bad", "short text") for i in range(60)] + [(60, "bad", good)]
    rows += [(100 + i, f"h{i % 5}", good) for i in range(100)] + [(300, None, good), (301, "h1", "too short"), (301, "h1", "too short")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [(r.id, r.kept, r.base_failed, r.host_failed) for r in quality_rules(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[60] == (False, False, True)
    assert all(by[100 + i] == (True, False, False) for i in range(100))
    assert by[300][0] and by[301] == (False, True, False)


def test_a_small_host_is_shrunk_to_the_corpus(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"h{i % 20}", good if i % 50 else "bad") for i in range(1000)] + [(5000, "tiny", "bad"), (5001, "one", good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    by = {r.id: r for r in quality_rules(df).collect()}
    assert by[5000].base_failed and not by[5000].host_failed
    assert by[5001].kept


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_very_long_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + "\n" + "again and again the same words\n" * 20_000
    rows = [(1, text, "h"), (1, text, "h"), (None, "", "h"), (2, "a b c", None)]
    got = document_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    ones = [r for r in got if r.id == 1]
    assert len(got) == 4 and len(ones) == 2 and ones[0] == ones[1]
    assert ones[0].n_words == 200_000 + 120_000 and ones[0].n_dup_lines == 19_999 and ones[0].n_repeat_words == 120_000
