"""Operators on single texts against brute force, exact round trips or held-out accuracy."""

import collections
import hashlib
import html
import json
import math
import re
import time
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from rcaspark.llm import html_text, langid, mixing, packing, pii, queries, resample, rules, url_filter

from .conftest import SF

PLAIN_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, form in PLAIN_FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_pii(documents):
    texts = collections.defaultdict(list)
    for r in documents.select("doc_id", "text").collect():
        texts[r.doc_id].append(brute_spans(r.text))
    got = pii.find(documents).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        digests = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in x).encode()).hexdigest(): x for x in texts[r.doc_id]}
        found = digests[r.base_sha256]
        counts = collections.Counter(k for k, _, _ in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PLAIN_FORMS)
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(",")) | {""}
    return got


def test_pii_matches_the_plain_forms(spark):
    check_pii(spark.read.parquet(f"{SF}/documents.parquet"))


def test_pii_on_hard_texts(spark, odd_documents, no_documents):
    texts = [
        "a@b@c.com x_y@z.org.uk,me@x a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "é😀 +1 (377) 555-0271. +49 30/1",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111", "+1 2 3 4 5 6 7 8 ", "+12345678901234567 +1.2.3.4.5.6.7.8",
        "9" * 5000, "1 " * 5000, "a" * 20000 + "@", "x@" * 3000, "1." * 4000, "+1" * 3000, "aé.b@c.d" * 50, "a@b.c_d@e.f",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pii(rows)
    check_pii(odd_documents)
    assert pii.find(no_documents).count() == 0


def test_pii_contexts_add_unseen_identifiers(spark):
    seeds = [f"please call phone number +1 ({200 + i}) 555-01{i:02d} today" for i in range(30)]
    unseen = ["please call phone number 555-0199-8811 today", "the year 1999 was fine and 20001 sheep slept"]
    rows = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert got[30].added_spans == "phone:25:38" and got[30].n_phone == 0
    assert got[31].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[0] == "please call phone number [PHONE] today" and clean[30] == "please call phone number [PHONE] today"
    assert clean[31] == unseen[1]


def test_pii_takes_time_in_proportion_to_a_text(spark):
    text = " ".join(str(10000 + i % 89999) for i in range(400_000)) + " mail a1@b.org end"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    began = time.monotonic()
    got = pii.find(rows).first()
    assert got.n_email == 1 and got.spans.startswith(f"email:{text.index('a1@')}:") and time.monotonic() - began < 60
    many = " ".join(f"u{i}@b.org and" for i in range(20_000))
    clean = pii.redact(spark.createDataFrame([(1, many)], "doc_id long, text string")).first().text
    assert clean == " ".join(["[EMAIL] and"] * 20_000)


def test_pii_finds_variants_planted_in_the_given_texts(spark):
    """A third of the given texts get a line with an identifier of a plain form, a third one of another form, a third a decoy."""
    kinds = {
        "phone": ("call me on", lambda i: f"+49 (30) 555-{i:04d}", lambda i: f"(0171) 555-{i:04d}"),
        "email": ("write mail to", lambda i: f"user{i}@mail.example.org", lambda i: f"user{i} (at) mail (dot) example (dot) org"),
        "card": ("paid with card", lambda i: next(d for d in (f"40000{i:010d}{c}" for c in range(10)) if luhn(d)), lambda i: f"4000-0{i:03d}-7781-{i:03d}"),
    }
    rows, truth = [], set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        kind = list(kinds)[r.doc_id // 3 % 3]
        lead, plain, variant = kinds[kind]
        text, value = r.text or "", [plain, variant, lambda i: f"section {i} of {i + 70000}"][r.doc_id % 3](r.doc_id)
        text += f"\nPlease {lead if r.doc_id % 3 < 2 else 'see'} {value} tomorrow."
        rows.append((r.doc_id, text))
        if r.doc_id % 3 == 1:
            start = text.rindex(value)
            truth.add((r.doc_id, f"{kind}:{start}:{start + len(value)}"))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, x) for r in got for x in r.added_spans.split(",") if x}
    right = len(added & truth)
    print("planted variants: precision", right / max(len(added), 1), "recall", right / len(truth))
    assert right >= 0.95 * len(added) and right >= 0.9 * len(truth)


def test_redaction_joins_overlapping_spans_and_keeps_columns(odd_documents, spark):
    out = pii.redact(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    text = "é mail 1.2.3.4@x.org end, 4111 1111 1111 1111"
    kept = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert kept.startswith("é mail [") and kept.count("[") == 2 and "1.2" not in kept and "4111" not in kept and " end, [" in kept


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head>
<body class="page header"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> --><article><header><h1>Head &quot;line&quot;</h1></header>
<p>First  <b>bold</b>text &amp; more&nbsp;here.<br>Next<p>Short.</p><aside>Side</aside><div class='ad'>Buy</div>
<form><label>Name</label><input></form><p>Last &#233; &lt;b&gt;</p><section id="comments"><p>Nice!</p></section></article>
<div class="sidebar"><p>Other</p></div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == 'Head "line" First boldtext & more here. Next Short. Last é <b>'


def test_pages_without_an_article_element():
    page = "<body><ul class=menu><li>Home</ul><div><p>" + "Long text here. " * 9 + "</p><p>And ends.</p></div><div class='footer'>x</div>"
    assert html_text.main_text(page) == ("Long text here. " * 9).strip() + " And ends."


LONG = "A long paragraph of the article's own text, with a comma and a full stop at its end."


@pytest.mark.parametrize("page,text", [
    # Windows decide: short lines far from the text, and runs of links, are no part of it.
    (f"<body><div>Today<p>Hot</p><p>Login here</p><p>Low</p></div><div><p>{LONG}<p>{LONG}<p>Short.</div>", f"Login here Low {LONG} {LONG} Short."),
    (f"<div>One<p>Two<p>Three<p>Four<p>Five<p>Six</div><div><p>{LONG}<p>{LONG}</div>", f"Five Six {LONG} {LONG}"),
    (f"<div><p>{LONG}<p>{LONG}</div><div><p><a>x</a><p><a>y</a><p><a>z</a></div><div>One</div>", f"{LONG} {LONG}"),
    (f"<div><p>{LONG}</div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><div><p>{LONG}</div>", f"{LONG} {LONG}"),
])
def test_windows_decide(page, text):
    assert html_text.main_text(page, window=3, surge=1) == text


def article_of(page):
    """By brute force: the text between a given page's article tags."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_windows_find_the_text_of_given_pages_without_article_tags(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"</?article>", "", page) for page in pages]
    assert sum(html_text.main_text(b) == article_of(p) for p, b in zip(pages, bare)) >= 0.995 * len(pages)
    assert all(html_text.main_text(p) == article_of(p) for p in pages)
    # The windows matter: single lines lose headings and short paragraphs.
    assert sum(html_text.main_text(b, window=1) != html_text.main_text(b) for b in bare) > 0.5 * len(bare)


@pytest.mark.parametrize("page,text", [
    *[(f"<article><p>{LONG}<p class='{c}'>{LONG}<h2 class='{c}'>Part</h2><p>{LONG}</article>", f"{LONG} {LONG} Part {LONG}")
      for c in ("comment", "reply", "ads", "menu", "login")],
    *[(f"<article><p>{LONG}<section class='{c}'><h2>Part</h2><p>{LONG}<p>{LONG}</section><p>{LONG}</article>", f"{LONG} Part {LONG} {LONG} {LONG}")
      for c in ("menu", "login", "popup", "cookie")],
    (f"<article><p>{LONG}<p>{LONG}<div class='login'><p>Sign in</div></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}<p>{LONG}<div class='ad'><p>{LONG[:60]}</div><section id='comments'><p>{LONG[:70]}</section></article>", f"{LONG} {LONG}"),
    (f"<article><h1>Hi</h1><p>Ho</article><footer>{LONG}</footer>", "Hi Ho"),
])
def test_classes_drop_no_article_text(page, text):
    assert html_text.main_text(page) == text


def test_extraction_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<article><p>a b</article>", "x", 5), (1, "u", "<article><p>a b</article>", "y", 6), (None, None, None, "z", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(page_id=1, url="u", text="a b", n_chars=3)] * 2 + [type(got[0])(page_id=None, url=None, text="", n_chars=0)]))


def test_deep_pages():
    assert html_text.main_text("<p>a" * 20000).count("a") == 20000 and html_text.main_text("<div>" * 20000 + "x") == "x"


@pytest.mark.parametrize("page,text", [
    (f"<div class='has-sidebar'><article><p>{LONG}</article><div class=sidebar>Other</div></div>", LONG),
    (f"<div id=page class='layout side-right'><p>{LONG}<p>{LONG}<div class=footer>x</div></div>", f"{LONG} {LONG}"),
    *[(f"<article><p>{LONG}<p>{LONG}<section class='{c}'><h2>Part</h2><p>{LONG}</section></article>", f"{LONG} {LONG} Part {LONG}")
      for c in ("legal", "notice", "related", "share", "search", "header")],
    (f"<article><p>{LONG}<div class=share><a>Tell others</a></div></article>", LONG),
    (f"<!-- <article> --><script>'<main>'</script><div><p>{LONG}</div>", LONG),
    (f"<article><a>Teaser</a></article><div><p>{LONG}<p>{LONG}</div><article><p>Read on</article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}<ul><li><a>See one</a><li><a>See two</a><li><a>See three</a></ul><p>{LONG}</article>", f"{LONG} See one See two See three {LONG}"),
    (f"<article><p>{LONG}<figure><figcaption>A caption</figcaption></figure><math><mi>x</mi></math></article>", f"{LONG} A caption x"),
    (f"<article class='post comments-open'><p>{LONG}</article><p>{LONG}<div id=comments><article class=comment>Nice</article></div>", f"{LONG} {LONG}"),
    (f"<form><div><p>{LONG}<p>{LONG}</div></form>", f"{LONG} {LONG}"),
])
def test_markup_hides_no_article_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<article><p>cut &amp", "cut &"), ("<p>x</p><!-- open", "x"),
    ("<p>a <b>b</p><p>c", "a b c"), ("<p>1 < 2</p>", "1 < 2"), ("<script>x", ""), ("<article><p>a</p><p class", "a"), ("</p></div>x", "x"),
])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_every_page_keeps_its_paragraphs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        want = article_of(r.html)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert html_text.extract(pages.where("false")).count() == 0
    assert html_text.extract(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first().text == ""


def test_language_on_the_held_out_fold(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(documents).collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and len(r.text) > 40]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_tables(odd_documents, no_documents):
    rows = langid.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count() and rows[0].component == 7
    assert {r.doc_id: r.lang_pred for r in rows}[8] == "und" and all(r.score == 0 for r in rows if r.text is None)
    assert langid.identify(no_documents).count() == 0
    blank = langid.predict(odd_documents, langid.learn(no_documents))
    assert {r.lang_pred for r in blank.collect()} == {"und"}


@pytest.mark.parametrize("languages", [1, 2, 3, 7, 8, 40])
def test_codewords_are_apart(languages):
    code = langid.codewords(languages)
    assert len({tuple(w) for w in code}) == languages
    if languages >= 8:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) > code.shape[1] / 5


def test_raking_reaches_its_targets(spark):
    cells = spark.createDataFrame(
        [(s, l, t, 10 + 7 * i % 23 + 50 * (s == "a")) for i, (s, l, t) in enumerate((s, l, t) for s in ("a", "b", None) for l in ("x", None) for t in (0, 1))],
        "source string, lang string, topic long, tokens long")
    goals = {"source": {"a": 0.2, "b": 0.5, None: 0.3}, "lang": {"x": 0.6, None: 0.4}, "topic": {0: 0.5, 1: 0.5}}
    targets = {k: spark.createDataFrame(list(v.items()), f"value {'long' if k == 'topic' else 'string'}, share double") for k, v in goals.items()}
    rows = mixing.rake(cells, targets, rounds=50, tolerance=1e-6).collect()
    for name, goal in goals.items():
        for value, share in goal.items():
            assert abs(sum(r.weight for r in rows if r[name] == value) - share) < 1e-4


def test_mixing_draws_by_probability(spark):
    documents = mixing.with_topics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = mixing.mix(documents).collect()
    assert len(rows) == 1000 and max(r.probability for r in rows) == 1.0
    expected = sum(r.probability for r in rows)
    assert abs(sum(r.kept for r in rows) - expected) < 4 * expected**0.5
    drawn, wanted = collections.Counter(), collections.Counter()
    for r in rows:
        wanted[r.lang] += r.probability * r.n_tokens
    targets = {r.value: r.share for r in mixing.target_shares(documents.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")))["lang"].collect()}
    for lang, share in targets.items():
        assert abs(wanted[lang] / sum(wanted.values()) - share) < 0.01


def test_mixing_on_odd_tables(odd_documents, no_documents):
    rows = mixing.mix(mixing.with_topics(odd_documents)).collect()
    assert len(rows) == odd_documents.count() and all(isinstance(r.kept, bool) for r in rows)
    assert mixing.mix(mixing.with_topics(no_documents)).count() == 0


def test_a_small_cell_repeats_and_does_not_shrink_the_others(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    tiny = spark.createDataFrame([(-1, "rare words " * 10, "new", "en"), (-2, "other rare words " * 7, "src1", "xx")], documents.schema)
    topics = mixing.with_topics(documents.unionByName(tiny)).cache()
    total = topics.agg(F.sum("n_tokens")).first()[0]
    cells = topics.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    targets = {(name, r.value): r.share for name, t in mixing.target_shares(cells).items() for r in t.collect()}
    for budget, wanted in ((None, mixing.LEAST_SHARE * total), (total, total)):
        rows = mixing.mix(topics, budget=budget).collect()
        expected = sum(r.rate * r.n_tokens for r in rows)
        assert abs(expected - wanted) < 1e-6 * wanted
        spread = sum(r.n_tokens**2 * (r.rate % 1) * (1 - r.rate % 1) for r in rows) ** 0.5
        assert abs(sum(r.copies * r.n_tokens for r in rows) - wanted) < 4 * spread
        assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 and r.kept == (r.copies > 0) for r in rows)
        for name, value in (("source", "new"), ("lang", "xx"), ("lang", "en"), ("lang", "de")):
            got = sum(r.rate * r.n_tokens for r in rows if r[name] == value) / expected
            assert abs(got - targets[name, value]) < 0.01
        assert min(r.copies for r in rows if r.doc_id < 0) > 1
        sample = collections.Counter(r.doc_id for r in mixing.repeated(mixing.mix(topics, budget=budget)).collect())
        assert sample == {r.doc_id: r.copies for r in rows if r.copies}


def test_packing_round_trip(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(90, "a <|endoftext|> b"), (91, "日本語 text\u00a0x\u2009y ㎏ ½"), (92, "x" * 4096)], "doc_id long, text string")
    for documents in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), odd_documents.select("doc_id", "text").distinct(), extra):
        pieces = collections.defaultdict(list)
        rows = packing.pack(documents, path).collect()
        for r in rows:
            pieces[r.doc_id].append(r)
            assert r.length == r.bucket == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        assert len({r.sequence_id for r in rows}) == len(rows)
        for doc, text in documents.collect():
            ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
            got = sorted(pieces[doc], key=lambda r: r.start)
            assert [x for r in got for x in r.ids] == ids and {r.doc_tokens for r in got} == {len(ids)}
            assert [r.start for r in got] == [sum(x.length for x in got[:i]) for i in range(len(got))]
            assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) for r in got)
            assert len(got) == len(ids) // 1024 + bin(len(ids) % 1024).count("1")
    assert packing.pack(no_documents, path).count() == 0


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, marked = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            marked |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_rules_base_matches_brute_force(spark, odd_documents, no_documents):
    some = spark.createDataFrame([(1, "a b c a b c\nx\n\nx \nx\n é#é"), (2, "a a a a"), (3, "a b\r\na b\r\n"), (4, "&|<>\x0b%")], "doc_id long, text string")
    for documents in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd_documents, some):
        want = sorted(((r.doc_id, *brute_statistics(r.text)) for r in documents.select("doc_id", "text").collect()), key=str)
        rows = rules.quality(documents).collect()
        assert sorted((tuple(r)[:7] for r in rows), key=str) == want
        assert not any(r.kept for r in rows if r.base_failed)
    assert rules.quality(no_documents).count() == 0


def test_votes_find_the_better_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = rules.quality(documents).drop("quality").join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.9 > 0.5 > sum(bad) / len(bad)


def test_threshold_is_the_kth_largest(spark):
    import random

    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 0.25, 1e-9 * rng.random()]) for _ in range(500)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 250, 499, 500):
        assert resample.threshold(table, "x", k) == sorted(values, reverse=True)[k - 1]
    assert resample.threshold(table, "x", 501) is None and resample.threshold(table.where("false"), "x", 1) is None


def test_weights_are_sums_over_all_grams(spark):
    import numpy as np

    texts = ["", "one", "one two three", " ".join(f"word{i % 70}" for i in range(900))]
    ratio = np.linspace(-1, 2, resample.BUCKETS)
    rows = resample._score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratio).collect()
    for r in rows:
        grams = resample.buckets_of(np.frombuffer(texts[r.doc_id].encode(), np.uint8)) if texts[r.doc_id] else []
        assert r.n_grams == len(grams)
        assert r.log_weight == pytest.approx(sum(ratio[g] for g in grams)) if len(grams) else r.log_weight is None


def test_resampling_prefers_the_target(spark, odd_documents, no_documents):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = resample.resample(documents, labels)
    rows = out.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > sum(bad) / len(bad) + 0.2
    share = labels.where("quality = 1").count() / labels.count()
    assert abs(out.where("kept").count() - share * documents.count()) <= 0.02 * documents.count()
    assert resample.resample(odd_documents, labels).count() == odd_documents.count()
    assert resample.resample(no_documents, labels).count() == 0
    assert resample.resample(odd_documents, labels.where("false")).where("kept").count() >= 1


def brute_rule(url, table):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://EXAMPLE.com/en/a?x", "https://www.example.com/en/", "https://a.www.example.com/en/b#c", "http://net/es/", "x://b.net/es",
        "http://b.net/fr/1", "http://notexample.com/en/", "http://example.com", "http://example.com?/en/", "a://b://c.com/x", "http://É.COM/é", "http://x.net/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "<p>" + "word " * 99) for i, u in enumerate(urls)], "page_id long, url string, html string")
    outcomes = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.lit(False).alias("bad"))
    for r in url_filter.judge(pages, queries.URL_RULES, outcomes).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id], queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert url_filter.judge(pages.where("false"), queries.URL_RULES, outcomes.where("false")).count() == 0


def test_outcomes_are_naive_bayes_over_words(spark):
    """Model and outcomes against plain loops over the given tables; a strange host, clashing columns and nulls change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, pages = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None, 0), (5, None), (1, 0)], "doc_id long, quality int")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).unionByName(odd)
    model = {r.bucket: r.weight for r in url_filter.word_model(docs, labels).collect()}
    quality = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            quality[r.doc_id] = min(quality.get(r.doc_id, 1), r.quality)
    words = lambda text: regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text.lower())
    seen = {w for r in docs.collect() for w in words(r.text or "")} | {w for r in pages.collect() for w in words(r.html or "")}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in seen], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(url_filter.BUCKETS)).alias("b")).collect()}
    counts = [collections.Counter(bucket[w] for r in docs.collect() if quality.get(r.doc_id) == q for w in words(r.text or "")) for q in (0, 1)]
    totals = [sum(c.values()) + url_filter.SMOOTHING * url_filter.BUCKETS for c in counts]
    want = {b: math.log((counts[0][b] + url_filter.SMOOTHING) / totals[0]) - math.log((counts[1][b] + url_filter.SMOOTHING) / totals[1]) for b in counts[0] | counts[1]}
    assert model.keys() == want.keys() and all(abs(model[b] - want[b]) < 1e-9 for b in want)

    def text(page):
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", page or "")
        page = re.sub(r"<[^<>]*>", " ", page)
        for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            page = page.replace(name, mark)
        return words(page)

    more = spark.createDataFrame([(None, None, None), (9, "http://x.org/", ""), (9, "http://x.org/", "")], pages.select("page_id", "url", "html").schema)
    pages = pages.select("page_id", "url", "html").unionByName(more).withColumns({"bucket": F.lit("x"), "row": F.lit(1), "host": F.lit("y"), "bad": F.lit(2), "weight": F.lit("z")})
    found = collections.Counter(tuple(r) for r in url_filter.learned_outcomes(pages, url_filter.word_model(docs, labels)).collect())
    brute = collections.Counter()
    for r in pages.collect():
        known = [bucket[w] for w in text(r.html)]
        weights = [want[b] for b in known if b in want]
        brute[brute_rule(r.url, [])[0], True if not known else sum(weights) > 0 if weights else None] += 1
    assert found == brute and len({bad for _, bad in found}) > 1
    verdicts = url_filter.judge(pages, queries.URL_RULES, url_filter.learned_outcomes(pages, url_filter.word_model(docs, labels))).collect()
    assert len(verdicts) == pages.count()
    none = url_filter.learned_outcomes(pages, url_filter.word_model(docs, labels.where("false"))).where("bad is not null")
    assert none.count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.a.net", True)] * 60 + [("good.a.net", False)] * 60 + [("few.b.net", True)] * 2 + [("c.net", False)] * 300 + [("new.a.net", None)]
    rows += [(f"h{i}.d{i % 7}.org", i % 9 == 0) for i in range(200)]
    found = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert found["bad.a.net"].bound > 0.5 and found["good.a.net"].rate < 0.2 and found["few.b.net"].bound < 0.5
    assert found["good.a.net"].rate < found["new.a.net"].rate < found["bad.a.net"].rate
    pages = spark.createDataFrame([(i, f"http://{h}/p", None) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    verdicts = url_filter.judge(pages, [], spark.createDataFrame(rows, "host string, bad boolean")).collect()
    assert {r.host for r in verdicts if r.verdict == "block"} == {"bad.a.net"}


def test_entry_point_lists_the_operators():
    import __spark_entry__ as entry

    assert {f"op{i}_" for i in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in entry.queries()}
    assert json.dumps(list(entry.oracle_sql()))
