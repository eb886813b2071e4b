import random
import re
from collections import Counter

import numpy as np

from civicpulse.llm.language_id import document_rows, drop_unidentified, identify, op5_language_id, page_rows, sample_edges, train, visible

WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while children sing about winter nights and morning light".split(),
    "fr": "le renard brun saute par dessus les chiens paresseux pendant que les enfants chantent à l'été français".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund während die kinder nachts schöne lieder singen".split(),
}


def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        text = " ".join(rng.choice(WORDS[lang], int(rng.integers(20, 80))))
        rows.append((i, text, lang, f"src-{lang}", len(text)))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_text_beats_a_wrong_declaration_and_priors_help_the_rest(spark):
    rows = corpus()
    rng = np.random.default_rng(5)
    rows += [(900 + i, " ".join(rng.choice(WORDS["fr"], 60)), "en", "src-en", 1) for i in range(3)]
    rows += [(910, None, None, "src-de", 0), (911, "", "fr", None, 0), (912, None, None, None, None), (913, "\x00\x01\x02\x03" * 200, None, "src-en", 9)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in identify(document_rows(df), train(df.select("text", "lang")), ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].language == lang and got[i][0].kept for i, _, lang, *_ in rows[:240])
    assert len(got[0]) == 2
    assert all(got[900 + i][0].language == "fr" for i in range(3))
    assert got[910][0].language == "de" and got[910][0].text_language is None
    assert got[911][0].language == "fr"
    assert not got[913][0].kept and got[913][0].language == "und"
    kept = drop_unidentified(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 913 not in ids and set(range(240)) < set(ids) and ids.count(0) == 2


def test_pages_use_markup_address_and_host(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    pages = [
        (i, f"https://www.h{i % 4}.example.{'fr' if lang == 'fr' else 'com'}/{i}?q", f"<html lang='{lang}'><p>{text}</p><script>x</script>")
        for i, text, lang, *_ in corpus()
    ]
    pages += [(1000, "http://a.example.fr:80/x", "<html>"), (1001, "no address", None), (1002, None, '<HTML LANG="de-AT"><p>')]
    rows = page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    sides = {r.page_id: (r.markup, r.suffix, r.host, r.domain) for r in rows.collect()}
    assert sides[1] == ("fr", "fr", "www.h1.example.fr", "example.fr")
    assert sides[1000] == (None, "fr", "a.example.fr", "example.fr") and sides[1001] == (None,) * 4
    got = {r.page_id: r.language for r in identify(rows, train(docs.select("text", "lang")), ["page_id"]).collect()}
    assert all(got[i] == lang for i, _, lang, *_ in corpus())
    assert got[1000] == "fr" and got[1002] == "de"


def test_visible_text():
    assert visible(b"<p>a</p><style>b</style><!-- c --><SCRIPT>d</script >e").split() == [b"a", b"e"]
    assert visible(b"<p>a &amp;lt; &lt;b&gt; &eacute;</p>").strip() == b"a &lt; <b> &eacute;"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_unidentified(empty).collect() == []


def brute(rows, labelled):
    """The fusion straight from its definition; rows (key, data, page, markup, suffix, host, domain)."""
    langs = sorted({lang for _, lang in labelled})
    pairs = lambda b: [(x, y) for x, y in zip(b, b[1:], strict=False)]
    logp, mean = [], []
    for lang in langs:
        count = Counter(p for t, x in sorted(set(labelled)) if x == lang for p in pairs(t.encode()))
        total = Counter()
        for (x, _), n in count.items():
            total[x] += n
        of = lambda p, count=count, total=total: np.log((count[p] + 0.05) / (total[p[0]] + 256 * 0.05))
        logp.append(of)
        mean.append(sum(n * of(p) for p, n in count.items()) / sum(count.values()))
    ll, fits, vote = [], [], []
    for _, data, page, *_ in rows:
        data = (visible(data) if page else data).strip() if page else data
        total = [sum(of(p) for p in pairs(data)) for of in logp]
        says = len(data) > 3
        fits.append(not says or min((m - 1.5) * (len(data) - 1) - t for m, t in zip(mean, total, strict=True)) < 300)
        ll.append([0.2 * t if says else 0.0 for t in total])
        vote.append(int(np.argmax(ll[-1])) if fits[-1] and max(ll[-1]) > min(ll[-1]) else None)
    n = len(langs)
    seen = [vote.count(k) + 1 for k in range(n)]

    def counts(side, i):
        value = rows[i][side]
        if value is None or not any(r[side] == value and v is not None for r, v in zip(rows, vote, strict=True)):
            return None
        return [sum(r[side] == value and v == k for r, v in zip(rows, vote, strict=True)) - (vote[i] == k) for k in range(n)]

    out = {}
    for i, row in enumerate(rows):
        host, domain = counts(5, i) or [0] * n, counts(6, i) or [0] * n
        scores = []
        for k in range(n):
            upper = (domain[k] + 10 * seen[k] / sum(seen)) / (sum(domain) + 10)
            score = ll[i][k] + np.log((host[k] + 10 * upper) / (sum(host) + 10))
            for side in (3, 4):
                if (c := counts(side, i)) is not None:
                    score += np.log((c[k] + 0.5) / (seen[k] + 0.5 * n))
            scores.append(score)
        posterior = 1 / sum(np.exp(x - max(scores)) for x in scores)
        kept = fits[i] and posterior >= 0.5
        out[row[0]] = (langs[int(np.argmax(scores))] if kept else "und", round(float(posterior), 6), None if vote[i] is None else langs[vote[i]], bool(kept))
    return out


def test_equals_brute_force(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(rng.choice(WORDS[lang], int(rng.integers(1, 6)))), lang, f"s{i % 4}", 1) for i in range(60) for lang in [("en", "fr", "de")[i % 3]]]
    docs += [(60, None, "fr", "s1", 0), (61, "", "de", None, 0), (62, "ab", "xx", "s2", 2), (63, "\x00\x07" * 400, None, "s0", 9), (64, docs[0][1], "en", "s3", 1)]
    docs += [(65, "le the der", None, "s9", 0), (66, "the fox", "FR ", "s1", 0)]
    pages = [(i, f"http://h{i % 3}.{'abc'[i % 2]}.example/{i}", f"<html lang={'en' if i % 2 else 'fr'}><p>{docs[i][1]}</p><!-- le la -->") for i in range(12)] + [(12, None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id): (r.language, r.posterior, r.text_language, r.kept) for r in op5_language_id(spark, str(tmp_path)).collect()}
    labelled = [(t, lang) for _, t, lang, *_ in docs if lang and t and len(t) > 3]
    rows = [(("d", i), (t or "").encode(), False, lang.strip().lower() if lang and (t, lang) not in labelled else None, None, src, None) for i, t, lang, src, _ in docs]
    for i, url, html in pages:
        host = url.split("/")[2] if url else None
        declared = ("en" if i % 2 else "fr") if html else None
        rows.append((("p", i), (html or "").encode(), True, declared, host and host.split(".")[-1], host, host and ".".join(host.split(".")[-2:])))
    want = brute(rows, labelled)
    assert got.keys() == want.keys()
    for key, (language, posterior, text_language, kept) in want.items():
        assert (got[key][0], got[key][2], got[key][3]) == (language, text_language, kept) and abs(got[key][1] - posterior) < 2e-6, key


def test_a_rare_language_and_a_text_of_many_copies(spark):
    rows = corpus() + [(1000 + i, " ".join(WORDS["fr"]), "fr", "s", 1) for i in range(300)]
    rows += [(2000 + i, f"zeta omikron lambda kappa theta ypsilon {i} sigma", "el", "s", 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    edges = sample_edges(df, 20)
    assert set(edges) == {"en", "fr", "de", "el"}
    model = train(df.select("text", "lang"), 20)
    assert model[0] == ["de", "el", "en", "fr"]
    got = {r.doc_id: r.language for r in identify(document_rows(df, edges), model, ["doc_id"]).collect()}
    assert all(got[i] == "el" for i in (2000, 2001, 2002))


def test_markup_is_stripped_in_linear_time():
    hidden, tag = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"), re.compile(rb"(?s)<[^>]*>")
    rng = random.Random(3)
    parts = [b"<", b">", b"<!--", b"-->", b"<script", b"</script", b"<STYLE>", b"</style >", b" ", b"a", b"/", b"--", b"!"]
    for _ in range(4000):
        html = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert visible(html) == tag.sub(b" ", hidden.sub(b" ", html)), html
    for html in (b"<" * 2_000_000, b"<!--" * 500_000, b"<script " * 300_000, b"<style>" * 300_000 + b"</script>", b"<a>" * 500_000, b"</script " * 200_000):
        visible(html)


def test_very_long_and_empty_pages(spark, tmp_path):
    docs = corpus() + [(5000, " ".join(WORDS["de"] * 60_000), None, "src-x", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r.language for r in op5_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 241 and got[5000] == "de"
