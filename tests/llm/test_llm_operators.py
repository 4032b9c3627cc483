"""Each operator against a brute-force statement of its contract, and on odd input."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orisite.llm import (decontaminate, html_text, language_id, lm_scoring, mixing, queries, simhash_dedup, suffix_dedup,
                         token_counts, topk_search, toxicity)
from orisite.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------ 1

def test_token_counts_equal_direct_encoding(spark, docs, odd_docs, tmp_path):
    import base64

    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    direct = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, d in enumerate((docs, odd_docs)):
        expected = sorted(((r.doc_id, len(direct.encode_ordinary(r.text or ""))) for r in d.collect()), key=repr)
        token_counts.write_token_files(d, str(tmp_path / f"t{i}"), docs_per_file=7)
        files = token_counts.read_token_files(spark, str(tmp_path / f"t{i}"))
        for block in (5, 64, 1 << 18):  # borders in headers, documents over many blocks, one block
            if block == 5 and i:
                continue
            s = token_counts.separator_scan(files, token_counts.END, 2, token_counts.DIGITS, block)
            got = s.select(token_counts.spelled_id(F.col("head"), token_counts.END, token_counts.DIGITS), F.col("n_tokens") - token_counts.DIGITS)
            assert rows(got) == expected and s.where("not ended").count() == 0


def test_separator_scan_of_plain_files(spark):
    def file(*tokens, tail=b""):
        return np.array(tokens, "<u4").tobytes() + tail

    files = spark.createDataFrame([("a", file(1, 2, 0, 0, 3, 0)), ("b", file()), ("c", file(4, 5, 0, 6, tail=b"\1")), ("d", file(7))],
                                  "path string, content binary")
    expected = [("a", 0, 2, True), ("a", 3, 0, True), ("a", 4, 1, True), ("c", 0, 2, True), ("c", 3, 1, False), ("d", 0, 1, False)]
    for block in (1, 2, 3, 100):
        got = token_counts.separator_scan(files, end=0, width=4, block_tokens=block)
        assert rows(got.select("path", "start", "n_tokens", "ended")) == expected
    assert token_counts.separator_scan(files.limit(0), 0).count() == 0


# ------------------------------------------------------------------ 2

def brute_lm(rows_, mass):
    train = [w for _, w, t in rows_ if t]
    c1, c2, starts = Counter(), Counter(), len(train)
    for w in train:
        c1.update(w + ["</s>"])
        c2.update(zip(["<s>"] + w, w + ["</s>"]))
    n, v = sum(c1.values()), len(c1)
    out = []
    for i, w, t in rows_:
        base = score = 0.0
        for a, b in zip(["<s>"] + w, w + ["</s>"]):
            p = (c1[b] + 1) / (n + v + 1)
            base += math.log10(p)
            ca = starts if a == "<s>" else c1[a]
            score += math.log10((c2[a, b] + mass * p) / (ca + mass)) if ca else math.log10(p)
        out.append((i, t, len(w) + 1, sum(c1[b] > 0 for b in w + ["</s>"]), n, base, score))
    return out


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_lm_scores(request, which):
    d = request.getfixturevalue(which)
    train = ~queries.held_out(7)
    got = sorted(map(tuple, lm_scoring.score_texts(d, train, batch_bytes=50_000, mass=30.0).collect()), key=repr)
    data = [(r.doc_id, words(r.text), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in d.collect()]
    expected = sorted(brute_lm(data, 30.0), key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9)


def test_lm_scores_of_many_equal_rows(spark):
    """A third of the rows are equal, as many have neither id nor text: each kind is folded to one row."""
    data = [(1, "a b a c")] * 700 + [(None, None)] * 700 + [(i, f"a w{i % 9} b") for i in range(700)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    train = ~queries.held_out(7)
    slim = d.withColumn("train", train)
    assert lm_scoring.fold_copies(slim, 1 << 20).where("times > 1").count() == 0
    folded = lm_scoring.fold_copies(slim, 20_000)
    assert sorted(r.times for r in folded.where("times > 1").collect()) == [700, 700] and folded.count() == 702
    got = sorted(map(tuple, lm_scoring.score_texts(d, train, batch_bytes=20_000, mass=30.0).collect()), key=repr)
    expected = sorted(brute_lm([(i, words(t), i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t in data], 30.0), key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], rtol=1e-9)


def test_lm_of_order_three_backs_off_and_sums_to_one(spark):
    train = ["a b a", "b a c", "c", "a b c a b"]
    c = Counter()
    for t in train:
        w = ["<s>", *t.split(), "</s>"]
        c.update(tuple(w[i:j]) for j in range(1, len(w) + 1) for i in range(max(0, j - 3), j))
    vocabulary = {g[0] for g in c if len(g) == 1} - {"<s>"}
    n, mass = sum(c[w,] for w in vocabulary), 2.0

    def p(w, context):
        if not context:
            return (c[w,] + 1) / (n + len(vocabulary) + 1)
        shorter = p(w, context[1:])
        return (c[*context, w] + mass * shorter) / (c[context] + mass) if c[context] else shorter

    for context in [(), ("a",), ("a", "b"), ("<s>", "a"), ("zzz", "a")]:
        assert abs(sum(p(w, context) for w in [*vocabulary, "unseen"]) - 1) < 1e-12
    texts = [*train, "a b", "a zzz b a", "", "c c c", "b a b a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lm_scoring.score_texts(d, F.col("doc_id") < len(train), mass=mass, order=3).collect():
        w = ["<s>", *texts[r.doc_id].split(), "</s>"]
        expected = sum(math.log10(p(w[i], tuple(w[max(0, i - 2):i]))) for i in range(1, len(w)))
        assert abs(r.score - expected) < 1e-9


def test_lm_without_training_rows(odd_docs):
    got = lm_scoring.score_texts(odd_docs, F.lit(False)).collect()
    assert len(got) == 11 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert lm_scoring.score_texts(odd_docs.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------------ 3

def test_toxicity_separates_held_out_rows(spark):
    insults = ["idiot", "moron", "zugli", "zuglo", "zugla"]
    rng = np.random.default_rng(1)
    rows_, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice(list("abdeiknorst"), 4)) for _ in range(int(rng.integers(8, 60)))]
        toxic = int(i % 4 == 0)
        if toxic:
            w[int(rng.integers(len(w)))] = insults[int(rng.integers(5))]
        rows_.append((i, " ".join(w)))
        labels.append((i, toxic))
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(d.where("doc_id < 600"), l)
    got = toxicity.score(d.where("doc_id >= 600"), m).collect()
    hit = [r.toxicity >= 0.3 for r in got if r.doc_id % 4 == 0]
    false = [r.toxicity >= 0.3 for r in got if r.doc_id % 4]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.05


def test_toxicity_on_odd_input(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(odd_docs, none)
    assert [r.toxicity for r in toxicity.score(odd_docs, m).collect()] == [0.0] * 11
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    assert {r.toxicity for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, one)).collect()} == {1.0}
    x = toxicity.features([b"", b"YOU 1d10t!! you idiot", b"\xff\xfe"], (np.empty(0, np.uint64), np.empty(0, int)), toxicity.Characters())
    f = dict(zip(toxicity.FEATURES, x[1]))
    assert not x[0].any() and f["hits_fixed"] == np.log1p(2) and f["hidden_hits"] == np.log1p(1) and f["near_second"] == np.log1p(2)


def plain_features(text, lexicon):
    """The features of one text, word by word.  lexicon: {(length, beginning): tier}, length 0 for whole words."""
    def fold(c):
        low = (c if ord(c) <= 0xFFFF else unicodedata.normalize("NFKC", c)).lower()
        return toxicity.STAND_INS.get(c, low if len(low) == 1 else c)

    s, runs_ = f" {text} ", [[]]
    for i, c in enumerate(s):
        if c.isalpha() or c in "0123456789" or c in "@$" and s[i - 1].isalpha() and s[i + 1].isalpha():
            runs_[-1].append(c)
        else:
            runs_.append([])
    words_ = ["".join(w) for w in runs_ if any(c.isalpha() for c in w)]
    folded = ["".join(map(fold, w)) for w in words_]
    tiers = []
    for w in folded:
        begun = [(k, w[:k]) for k in toxicity.STEMS if k and len(w) > k] + ([(0, w)] if len(w) > 2 else [])
        tiers.append(min((lexicon[b] for b in begun if b in lexicon), default=None))
    fixed = ["".join(map(fold, w)) for w in toxicity.INSULTS]
    second = [i for i, w in enumerate(folded) if w in ["".join(map(fold, x)) for x in toxicity.SECOND_PERSON]]
    hits = [sum(w in fixed for w in folded)] + [tiers.count(k) for k in (1, 2, 3)]
    hit = [i for i, w in enumerate(folded) if w in fixed or tiers[i]]
    odd = [any(not c.isalpha() for c in w) for w in words_]
    n, chars = max(1, len(words_)), max(1, sum(ord(c) > 32 for c in text))
    letters = max(1, sum(c.isalpha() for c in text))
    return [math.log1p(len(words_)), *map(math.log1p, hits), *(h / n for h in hits), math.log1p(sum(odd[i] for i in hit)),
            math.log1p(sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hit)), len(second) / n,
            sum(c.isupper() for c in text) / letters,
            sum(len(a := [c for c in w if c.isalpha()]) > 1 and all(c.isupper() for c in a) for w in words_) / n,
            sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) / chars, sum(c in "!?" for c in text) / chars, sum(odd) / n,
            sum(a == b == c and ord(c) > 32 for a, b, c in zip(text, text[1:], text[2:])) / chars]


def test_toxicity_features_equal_a_plain_statement(docs):
    of = toxicity.Characters()
    lexicon = {(0, "you"): 1, (3, "sto"): 1, (4, "plea"): 2, (5, "trash"): 3, (0, "the"): 2, (7, "garbage"): 1}
    keys = []
    for k, w in lexicon:
        t = toxicity.Tokens([(w + ("x" if k else "")).encode()], of)
        keys.append(t.stem(k)[0][0])
    order = np.argsort(np.array(keys, np.uint64))
    given = np.array(keys, np.uint64)[order], np.array(list(lexicon.values()))[order]
    odd = ["", "   ", "idiot", "you", "YOU are tr@sh!!! $o 1d10t", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d you",
           "you a b c d e f idiot", "\U0001e900\U0001e922 \u24b6 \u00df\u0130 aaa", "stop stone PLEASE the garbages 5$ @home"]
    texts_ = odd + [r.text or "" for r in docs.collect()]
    got = toxicity.features([t.encode() for t in texts_], given, of)
    np.testing.assert_allclose(got, [plain_features(t, lexicon) for t in texts_], rtol=1e-12)


def test_toxicity_sample_is_bounded_by_rows(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")).alias("text"))
    l = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    all_ = toxicity.labelled_sample(d, l, 100_000, "doc_id", "text", "toxic").count()
    assert all_ == d.distinct().count()
    assert 0 < toxicity.labelled_sample(d, l, 300, "doc_id", "text", "toxic").count() < 400


# ------------------------------------------------------------------ 4

def plain_language(train, texts_):
    """Word-first backoff, word by word: (language, score) of each text."""
    def runs_(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        return low.split()

    def grams(w, k):
        framed = f" {w} "
        return [framed[e - k:e] for e in range(2, len(framed) + 1) if e >= k]

    langs = sorted({lang for lang, _ in train})
    counts = [{lang: Counter() for lang in langs} for _ in range(5)]
    for lang, text in train:
        for w in runs_(text):
            counts[0][lang][w] += 1
            for k in range(1, 5):
                counts[k][lang].update(grams(w, k))
    keys = [set().union(*c.values()) for c in counts]

    def logs(k, x):
        return [math.log((counts[k][lang][x] + 0.1) / ((sum(counts[k][lang].values()) or 1) + 0.1 * (len(keys[k]) + 1))) for lang in langs]

    for text in texts_:
        total = np.zeros(len(langs))
        for w in runs_(text):
            if w in keys[0]:
                total += logs(0, w)
                continue
            framed, value = f" {w} ", np.zeros(len(langs))
            for e in range(2, len(framed) + 1):
                known = [k for k in range(min(4, e), 0, -1) if framed[e - k:e] in keys[k]]
                if known:
                    value += logs(known[0], framed[e - known[0]:e])
            total += value / (len(w) + 1)
        best = int(total.argmax())
        yield (langs[best], 1 / np.exp(total - total[best]).sum()) if runs_(text) else ("und", 0.0)


def test_language_equals_a_plain_statement(docs, spark):
    train = [(r.lang, r.text) for r in docs.where("lang is not null").dropDuplicates(["doc_id", "text"]).collect() if r.doc_id % 2]
    texts_ = [r.text for r in docs.collect()] + ["", None, "zqx", "\U0001e900\U0001e922", "5 ! \u0130stanbul Stra\u00dfe", "\U00020000 x"]
    m = language_id.fit(docs.where("doc_id % 2 = 1"), per_lang=10**6)
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts_)), "i int, text string"), m).orderBy("i").collect()
    for r, (lang, score) in zip(got, plain_language(train, texts_)):
        assert r.lang_score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or abs(score - 0.5) < 1e-3)


def test_language_of_scripts_above_ffff_and_of_one_id(spark):
    data = [(5, "\U0001e900\U0001e922 \U0001e925\U0001e926", "ff")] * 40 + [(6, "plain words here", "en")] * 40
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.predict(d, language_id.fit(d, per_lang=1))
    assert got.where("lang = lang_pred").count() == 80


def test_language_of_held_out_rows(docs, spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.predict(d, language_id.fit(d.where(~queries.held_out(4))))
    right = told.where(queries.held_out(4)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_on_odd_input(spark, odd_docs):
    m = language_id.fit(odd_docs.where("doc_id in (1, 7)"))
    got = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in language_id.predict(odd_docs, m).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[2] == by_id[3] == by_id[4] == ("und", 0.0)
    assert by_id[1][0] == "en" and by_id[7][0] == "de" and 0 < by_id[1][1] <= 1
    empty = language_id.fit(odd_docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd_docs, empty).collect()} == {"und"}
    assert language_id.predict(odd_docs.limit(0), m).count() == 0


# ------------------------------------------------------------------ 5

@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &lt;&amp; text", "plain <& text"),
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>ddd</table>", "aa  b\nc   ddd"),
    ("<table><td>x<td colspan=2>wide<tr><td>1<td>2<td>3</table>", "x  wide\n1  2  3"),
    ("<head><title>t</title></head><script>var a='<p>';</script><!-- c --><div hidden>h</div>see", "see"),
    ("<style>.x, #y {display: none} p.z{}</style><p class='a x'>no</p><p id=y>no</p><p>yes", "yes"),
    ("<p style='color:red; display:none'>no</p>ok", "ok"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("unclosed <a href=\"x", "unclosed"), ("a < b", "a < b"), ("x<!-- never closed", "x"), ("</p></div>z", "z"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"), ("<select><option>a<option>b</select>", "a\nb"),
])
def test_html(html, text):
    assert html_text.render(html) == text


def test_html_keeps_every_visible_word(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract_text(pages.withColumn("__row", F.lit(1)).withColumn("copy", F.col("html"))).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", r["copy"])
        import html

        expected = html.unescape(re.sub(r"<[^>]*>?", " ", body)).split()
        assert "".join(w for w in r.page_text.split() if w != "-") == "".join(w for w in expected if w != "-")
    assert html_text.render("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"


@pytest.mark.parametrize("html, text", [
    ('<td colspan="²">a', "a"), (f'<table><tr><td colspan="{"9" * 5000}">a<td>b', "a  b"), (f"a&#{'9' * 5000};&#x{'f' * 5000};b", "a\ufffd\ufffdb"),
    (f"&#{'0' * 5000}65;", "A"), ("x<!-->y<p>z", "xy\n\nz"), ("x<!--->y<p>z", "xy\n\nz"), ("x<!-- a --!>y", "xy"), ("x<!---->y", "xy"),
    ("<details><summary>s</summary>body</details>e", "s\ne"), ("<details open><summary>s</summary>body</details>", "s\nbody"),
    ('<div style="visibility:hidden">a<b style="visibility:visible">b</b></div>', "b"), ('<div hidden>a<b style="visibility:visible">b</b></div>', ""),
    ("<style>.i{visibility:hidden}.v{visibility:visible}</style><p class=i>a<b class=v>b</b>", "b"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a  b  c\n   d  e"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<div>" * 300 + "<script>var secret=1;</script><p hidden>hid</p>ok", "ok"), ("<b>" * 5000 + "<p>deep", "deep"),
    (f"<table><tr><td>{'w' * 500}<td>b<tr><td>c<td>d</table>", f"{'w' * 500}  b\nc  d"), ("<ol start=²><li>a</ol>", "1. a"),
    ("<ul><li>" * 40 + "a<li>b", None)])
def test_html_odd_pages(html, text):
    got = html_text.render(html)
    if text is None:
        assert got.split()[-3:] == ["a", "-", "b"] and got.split().count("-") == 41  # no item is lost below the last level
    else:
        assert got == text


def test_html_never_raises_and_takes_linear_time(spark):
    import random
    import time

    rnd = random.Random(8)
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    parts = ["<table>", "<td colspan=9 rowspan=3>", "<tr>", "</p>", "<!--", "-->", "<!-->", "&#", "&#x", "999999999;", "<li>", "<ul>", "</ul>", '"', "'", "<",
             ">", "=", "<style>", "a{display:none}", "</style>", "<script>", "<select><option>", "hidden", "²", "\x00", "<details>", "<pre>", "&amp", "<ol start="]
    for _ in range(10_000):
        p = list(rnd.choice(pages)[: rnd.choice([50, 400, 1500])])
        for _ in range(rnd.randrange(1, 9)):
            at = rnd.randrange(len(p) + 1)
            p[at: at + rnd.choice([0, 0, 1, 7])] = rnd.choice(parts) * rnd.choice([1, 1, 3])
        assert isinstance(html_text.render("".join(p)), str)
    shapes = ["<div>", "<ul><li>", "<table><tr><td>", "<b>a</b>", "<a '", "<", "&#", "<td rowspan=9 colspan=999>b<tr>", "<blockquote>", "</p><b>", "{a "]
    for shape in shapes:
        n, took = 100_000 // len(shape), []
        for k in (1, 4):
            page = ("<style>" if shape[0] == "{" else "<table>" if shape[1:3] == "td" else "") + shape * (n * k)
            start = time.process_time()
            out = html_text.render(page)
            took.append(time.process_time() - start)
            assert len(out) < 30 * len(page)
        assert took[1] < 20 * took[0] + 1, (shape, took)  # 4 times the page; 16 times would be quadratic


def test_html_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x", "y")], "`page.id` long, html string, __row string, `a b` string")
    assert [tuple(r) for r in html_text.extract_text(pages).collect()] == [(1, "x", "y", "a")]
    assert html_text.extract_text(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="page_text"):
        html_text.extract_text(pages.withColumn("page_text", F.lit(1)))


# ------------------------------------------------------------------ 6

def test_leaks(spark, docs, odd_docs):
    def grams(t):
        w = re.split(r"[\x20\x09-\x0D]+", t.lower().strip(" \t\n\x0b\x0c\r")) if t and t.strip(" \t\n\x0b\x0c\r") else []
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd_items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "No id at all here"), (4, "ab"), (4, "ab")],
                                      "item_id long, text string")
    for d, b in ((docs, items), (odd_docs, odd_items)):
        expected = set()
        for r in d.collect():
            for i in b.collect():
                g = grams(i.text)
                if g and len(g & grams(r.text)) >= 0.8 * len(g):
                    expected.add((r.doc_id, i.item_id, len(g & grams(r.text)), len(g)))
        got = decontaminate.leaks(d, b).select("doc_id", "item_id", "n_common", "n_item").collect()
        assert set(map(tuple, got)) == expected and len(got) == len(expected) > 0
        leaked = {e[0] for e in expected}
        left = [r.doc_id for r in decontaminate.drop_leaks(d, b).collect()]
        assert sorted(left, key=repr) == sorted((r.doc_id for r in d.collect() if r.doc_id not in leaked), key=repr)
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_short_items_in_long_texts_are_all_found(spark):
    rng = np.random.default_rng(11)
    sizes = [4, 5, 5, 5, 5, 5, 5, 6, 6, 8, 11, 12]                  # words of the items that each text holds
    planted = {(j, k): [f"q{j}x{k}w{i}" for i in range(n)] for j in range(60) for k, n in enumerate(sizes)}
    texts = []
    for j in range(60):
        w = [f"v{x}" for x in rng.integers(0, 10_000, 3_000)]
        for k, n in enumerate(sizes):
            w[100 + 200 * k:100 + 200 * k + n] = planted[j, k]
        texts.append((j, " ".join(w).upper() if j % 2 else " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([(100 * k + j, " ".join(w)) for (j, k), w in planted.items()], "item_id long, text string")
    expected = {(j, 100 * k + j, n - 4, n - 4) for j in range(60) for k, n in enumerate(sizes) if n > 4}
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontaminate, "BROADCAST_ROWS", limit)
            got = decontaminate.leaks(d, b).select("doc_id", "item_id", "n_common", "n_item").collect()
        assert set(map(tuple, got)) == expected and len(got) == len(expected)
    parts = b.where("item_id >= 1000").withColumn("text", F.concat("text", F.lit(" not in any text at all here")))
    assert decontaminate.leaks(d, parts, threshold=0.5).count() == 120  # 7 of 13 and 8 of 14 shingles
    assert decontaminate.drop_leaks(d, b.where("item_id between 100 and 129")).count() == 30


# ------------------------------------------------------------------ 7

def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        left, sw = total - sum(fixed.values()), sum(w[k] for k in free)
        over = [k for k in free if left * w[k] / sw > 3 * sizes[k] + 1e-9]
        if not over:
            return {**fixed, **{k: left * w[k] / sw for k in free}}
        fixed.update({k: 3.0 * sizes[k] for k in over})


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mixing(request, which):
    d = request.getfixturevalue(which)
    m = mixing.mix(d, keep=["doc_id", "source", "text"]).cache()
    got = m.collect()
    assert len(got) == d.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and len(r.mix_draws) <= 3
        sizes[r.source] += r.mix_size
        taken[r.source] += r.mix_size * len(r.mix_draws)
        largest[r.source] = max(largest[r.source], r.mix_size)
    targets = brute_targets(sizes)
    for r in got:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - targets[r.source]) < 1e-6
    for k, t in targets.items():
        least = min((r.mix_size for r in got if r.source == k and r.mix_size and len(r.mix_draws) * sizes[k] <= t), default=largest[k])
        assert -1e-6 <= t - taken[k] <= least  # no document is left that would fit
    again = {(r.doc_id, r.text): r.mix_draws for r in mixing.mix(d.repartition(5), keep=["doc_id", "source", "text"]).collect()}
    assert again == {(r.doc_id, r.text): r.mix_draws for r in got}
    assert mixing.mixed_rows(m).count() == sum(len(r.mix_draws) for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixing_fills_the_blocks_after_one_that_does_not_fit(spark):
    """One document with a third of its source's words, in a block of many: what it leaves open goes to others."""
    for seed in range(4):
        rows = [(i, "w " * 30, "a") for i in range(3000)] + [(9000 + seed, "w " * 45_000, "a")] + [(10_000 + i, "w " * 20, "b") for i in range(5000)]
        d = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix(d, keep=["doc_id", "source"], seed=seed, block_docs=64).collect()
        for source, least in (("a", 30), ("b", 20)):
            mine = [r for r in got if r.source == source]
            taken = sum(r.mix_size * len(r.mix_draws) for r in mine)
            assert 0 <= mine[0].mix_target - taken < least, (seed, source, mine[0].mix_target, taken)
        assert all(len({(x["pass"]) for x in r.mix_draws}) == len(r.mix_draws) <= 3 for r in got)


def test_empty_documents_cost_mixing_no_round(spark, monkeypatch):
    rounds, fits = [], mixing.fits
    monkeypatch.setattr(mixing, "fits", lambda *a: rounds.append(1) or fits(*a))
    rows = [(i, "w " * (0 if i % 3 else 40), "ab"[i % 2]) for i in range(3000)]
    mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=16).count()
    assert len(rounds) < 4


def test_splitting_tree_keeps_quotas_and_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 7), (2, 0), (3, 1)], "rank int, quota long")
    seen = []
    for seed in range(60):
        got = mixing.split_quotas(quotas, 5, seed).collect()
        by_rank, by_shard = Counter(), Counter()
        for r in got:
            by_rank[r["rank"]] += r.n
            by_shard[r.shard] += r.n
        assert by_rank == Counter({0: 40, 1: 7, 2: 0, 3: 1}) and max(by_shard.values()) - min(by_shard.values()) <= 1
        seen.append(sum(r.n for r in got if r["rank"] == 1 and r.shard < 2))
    # 7 of 48 marked, 19 drawn by the first two shards: mean 2.77, variance 1.46
    assert abs(np.mean(seen) - 7 * 19 / 48) < 0.6 and 0.6 < np.var(seen) < 2.8


# ------------------------------------------------------------------ 8

def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= bits and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_simhash(request, which):
    d = request.getfixturevalue(which)

    def fp(text):
        w = words(text)
        g = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in g]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    data = sorted(((r.doc_id, fp(r.text)) for r in d.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    comp = brute_components([f for _, f in data], 2)
    expected = sorted(((i, f, data[c][0]) for (i, f), c in zip(data, comp)), key=repr)
    got = simhash_dedup.simhash_components(d, 3, 2).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == expected
    left = [r.doc_id for r in simhash_dedup.drop_near_duplicates(d, 3, 2).collect()]
    assert sorted(left, key=repr) == sorted((i for i, _, c in expected if i is None or i == c), key=repr)


def test_one_row_of_each_near_duplicate_group_stays(spark, docs_schema):
    a, b, c, d = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white", "not seen elsewhere at all"
    data = [(3, a), (5, a), (5, b), (9, b), (None, b)]            # one id in two groups, 5 leads that of b
    data += [(20, c)] * 3 + [(21, c), (None, c)]                   # equal rows that lead their group
    data += [(None, d)] * 4                                        # copies without an id
    data += [(30, "same id other text"), (30, "and a third text here now")]
    table = spark.createDataFrame([(i, t, "en", s, None) for i, t in data for s in ("a", None)], docs_schema)
    expected = sorted([(3, a), (5, b), (20, c), (None, d), *data[-2:]], key=repr)
    kept = [rows(simhash_dedup.drop_near_duplicates(table.repartition(n), 3, 2)) for n in (1, 7)]
    assert sorted((r[:2] for r in kept[0]), key=repr) == expected and kept[0] == kept[1]
    assert simhash_dedup.drop_near_duplicates(table.limit(0), 3, 2).count() == 0


def test_simhash_links_chains_of_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(6):
        f = int(rng.integers(1 << 62)) << 1
        for _ in range(25):
            fps.append(f)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for bits in (1, 2, 3):
        nodes = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
        roots = {r.node: r.root for r in connected_components(simhash_dedup.links(nodes, bits)).collect()}
        comp = brute_components(fps, bits)
        groups = {}
        for f, c in zip(signed, comp):
            groups.setdefault(c, set()).add(roots.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


# ------------------------------------------------------------------ 9

def brute_top(data, k):
    fit = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in data]
    out = []
    for r, (q, x) in enumerate(fit):
        if q is not None and q % 20 == 0:
            best = sorted(((-int(x @ y), i is None, i) for c, (i, y) in enumerate(fit) if c != r), key=lambda b: (b[:2], b[2] or 0))[:k]
            out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(best)]
    return sorted(out, key=repr)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(topk_search, "CHUNK", 4)
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(200)]
    data += [(200 + i, [0.5] * 8) for i in range(40)]  # ties
    data += [(None, [1.0] * 8), (None, [0.5] * 8), (0, data[0][1]), (0, data[7][1]), (20, data[9][1]), (7, data[7][1])]  # null and repeated ids
    odd = [(300, None), (320, [1.0, None] + [0.0] * 6), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, None), (380, [1.0])]
    v = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.top_k(v, F.col("id") % 20 == 0, 20).collect()), key=repr)
    assert got == brute_top(data, 20)
    few = v.where("vec_id in (1, 20)")
    some = [d for d in data if d[0] in (1, 20)]
    assert sorted(map(tuple, topk_search.top_k(few, F.col("id") % 20 == 0, 20).collect()), key=repr) == brute_top(some, 20)
    three = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(three, F.col("id") % 20 == 0, 20).collect())) == [(0, 1, 1, 2048)] * 2 + [(0, 2, 0, 0)] * 2
    assert topk_search.top_k(v.limit(0), F.lit(True), 20).count() == 0
    assert topk_search.top_k(v.where("vec_id = 1"), F.col("id") % 20 == 0, 20).count() == 0


# ------------------------------------------------------------------ 10

def brute_repeats(data, width):
    seen, out = set(), []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            if w in seen:
                gone[p:p + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for r in bytes(gone).split(b"\0") if r), kept))
    return out


def check_repeats(df, width, span, batch_bytes):
    data = sorted(((r.doc_id, (r.text or "").encode()) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = sorted(brute_repeats(data, width), key=repr)
    got = suffix_dedup.remove_repeats(df, width=width, span=span, batch_bytes=batch_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == expected
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)


def test_suffix_array_of_words_equals_sorting():
    rng = np.random.default_rng(5)
    for depth, alphabet in ((100, b"ab"), (40, b"abc"), (8, b"x"), (16, b"ab"), (64, b"ab")):
        text = np.frombuffer(bytes(rng.choice(list(alphabet), 3000)), np.uint8)
        text = np.concatenate([text, text[100:900], text[:500]])
        place = np.flatnonzero(rng.random(len(text) - depth + 1) < 0.5)
        order, first = suffix_dedup.suffix_array(text, place, depth)
        raw = text.tobytes()
        expected = sorted(place.tolist(), key=lambda p: (raw[p:p + depth], p))
        assert place[order].tolist() == expected
        assert first.tolist() == [i == 0 or raw[p:p + depth] != raw[expected[i - 1]:expected[i - 1] + depth] for i, p in enumerate(expected)]
    assert [len(x) for x in suffix_dedup.suffix_array(text, place[:0], 8)] == [0, 0]


def test_repeats(docs, odd_docs):
    check_repeats(docs, 100, 64, 60_000)
    check_repeats(odd_docs, 100, 64, 20_000)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_in_periodic_and_mosaic_texts(spark):
    rng = np.random.default_rng(7)
    parts = ["".join(rng.choice(list("ab "), 60)) for _ in range(6)] + ["x" * 70, "xy" * 50, "é" * 40]
    rows_ = [(int(i), "".join(parts[int(k)] for k in rng.integers(0, len(parts), int(rng.integers(1, 9))))) for i in rng.permutation(60)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    check_repeats(d, 100, 64, 2_000)
    check_repeats(d, 40, 20, 3_000)


def test_repeats_of_an_id_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = ("".join(rng.choice(list("abcdef "), 230)) for _ in range(4))
    data = [(None, t) for t in (a, b, c) for _ in range(40)] + [(7, d)] * 120 + [(i, a[i:i + 120] + d[:100 + i]) for i in range(60) if i != 7]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    bounds, pieces = suffix_dedup.cut_ids(table, 2_000)
    assert set(pieces) == {suffix_dedup.LEAST_ID, 7} and min(pieces.values()) > 10 and {6, 7} < set(bounds)
    check_repeats(table, 100, 64, 2_000)
    giant = spark.createDataFrame([(1, a), (2, a * 60), (3, a)], "doc_id long, text string")
    assert suffix_dedup.cut_ids(giant, 2_000) == ([2], {})  # one long text is no reason to deal rows
    check_repeats(giant, 100, 64, 2_000)
