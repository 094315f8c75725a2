"""Operators that look at one row at a time, against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import bpe, decontaminate, fingerprints, html_text, license_scan, quality, token_files, url_filter
from assay.llm.common import hash_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def words_of(n, seed=0, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# word hashing


def test_words_are_runs_between_spaces_across_piece_borders(monkeypatch):
    monkeypatch.setattr("assay.llm.common.PIECE", 16)
    texts = ["Alpha beta\tGAMMA", "", "  alpha\nbeta ", "é" * 40 + " x", "alpha"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, first = hash_words(data, np.cumsum([0, *map(len, raw)]))
    by_text = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(h) for h in by_text] == [3, 0, 2, 2, 1]
    assert by_text[0][:2] == by_text[2] and by_text[0][0] == by_text[4][0]


# 1


def judged(url, rules=url_filter.RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_url_rules_match_plain_python(spark):
    urls = [
        None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net/x?y#z", "https://Example.NET/en/p", "http://www.example.net/en", "http://example.com/de/x", "http://example.com/fr/", "http://x.org/fr/",
        "http://x.org?fr/", "http://notnet/", "http://.net/", "http://a..net//en/", "a://b://c.net/", "http://example.com/de?", "http://" + "a." * 300 + "net/" + "p/" * 3000, "http://x.org/fr/é ü", "http://x.org/fr/", "http://net#/",
    ]
    rows = [(i if i % 5 else None, u, "clash", "clash", "d") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, short string, r_host string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = sorted((r["url"] or "", r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert got == sorted((u or "", h, p, r or "", v) for u in urls for h, p, r, v in [judged(u)])
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_without_a_final_slash_are_prefixes(spark):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/xy/z"), ("block", "com", "")]
    urls = ["http://a.com/xyz", "http://a.com/xy/zz/1", "http://b.com", "http://a.com/q"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert got == {u: judged(u, rules)[2:] for u in urls}


# 2


def dice(a, b):
    import regex

    def pairs(t):
        w = [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).split(" ") if x]
        return {f"{x} {y}" for x, y in zip(w, w[1:])}

    a, b = pairs(a), pairs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def pairs_of(words):
    return [f"{x} {y}" for x, y in zip(words, words[1:])]


def license_windows(text, template, least):
    """The best of all windows of all allowed lengths; they begin and end with bigrams of the template."""
    import regex

    split = lambda t: [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).split(" ") if x]
    w, b = split(text), set(pairs_of(split(template)))
    g = pairs_of(w)
    hits = [k for k, x in enumerate(g) if x in b]
    low, high = len(b) * least / (2 - least) - 1e-9, len(b) * (2 - least) / least + 1e-9
    best = None
    if len({g[k] for k in hits}) < low:
        return None
    for s in hits:
        seen = set()
        for e in range(s, min(len(g), s + int(high))):
            seen.add(g[e])
            if g[e] in b and low <= len(seen) <= high:
                d = 2 * len(seen & b) / (len(seen) + len(b))
                if d >= least and (best is None or d > best[0]):
                    best = (d, s, " ".join(w[s : e + 2]))
    return best


def wrapped(text, width=60, lead=""):
    import textwrap

    return "\n".join(lead + line for part in text.split("\n") for line in textwrap.wrap(part, width))


def test_license_scan_matches_brute_force(spark):
    mit, bsd, apache = (next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 300) for name in ("MIT", "BSD-2-Clause", "Apache-2.0"))
    texts = [
        None, "", "word", "Released under the MIT License.", "Some text.\nReleased under the mit  license\nMore text here.", "Licensed under CC BY-NC 4.0.\n" * 3,
        mit, "intro\n\n" + bsd + "\n\nthe end of it", license_scan._ISC.replace("fee", "charge"), "This work is licensed under the GNU General Public License, version 2.",
        "licensed under the stars of the night sky in May", " ".join(words_of(5000)) + " " + mit, apache[:80], "Licensed under the Apache License, Version 2.0.",
        " ".join(words_of(400)) + "\n\n" + wrapped(mit).replace("\n", "\n\n", 3), "#!/bin/sh\n" + wrapped(apache, 70, "# ") + "\nset -e\nrun it", "/*\n" + wrapped(bsd, 50, " * ") + "\n */\nint main() {}",
        " ".join(words_of(50)) + " " + mit.replace("\n", " ") + " " + " ".join(words_of(50, 1)), "Copyright (c) 2020 Jane Doe. Released under the MIT License.", apache.replace("compliance", "full and complete compliance"),
    ]
    docs = frame(spark, texts + texts[3:5], [*range(len(texts)), 3, None])
    docs = docs.withColumnRenamed("lang", "License").withColumnRenamed("source", "found")
    key = lambda i: -1 if i is None else i
    got = sorted((key(r["doc_id"]), r["template_id"], round(r["dice"], 9), r["start"], r["found"]) for r in license_scan.scan(docs, license_scan.templates(spark)).collect())
    want = []
    for doc, text in [*enumerate(texts), (3, texts[3]), (-1, texts[4])]:
        for k, (_, template) in enumerate(license_scan.TEMPLATES):
            if best := license_windows(text or "", template, license_scan.LEAST):
                want.append((doc, k, round(best[0], 9), *best[1:]))
    assert got == sorted(want)
    names = {}
    for doc, k, *_ in got:
        names.setdefault(doc, set()).add(license_scan.TEMPLATES[k][0])
    assert "MIT" in names[14] & names[17] & names[18] & names[11] and "Apache-2.0" in names[15] & names[19] and "BSD-2-Clause" in names[16] & names[7]
    assert not {0, 1, 2, 10} & set(names)
    assert license_scan.scan(docs.limit(0), license_scan.templates(spark)).count() == 0
    assert license_scan.scan(docs, license_scan.templates(spark, [("X", "one")])).count() == 0


@pytest.mark.parametrize("inserted, times", [(15, 3), (12, 3), (20, 2), (8, 5), (25, 1), (1, 30)])
def test_notices_with_words_put_in_are_found(spark, inserted, times):
    """Also where no window of the template's own length matches."""
    w = license_scan._MIT.split()
    step = len(w) // (times + 1)
    for k in range(times, 0, -1):
        w[k * step : k * step] = [f"x{k}y{j}" for j in range(inserted)]
    text = " ".join(words_of(40) + w + words_of(40, 1))
    best = license_windows(text, license_scan._MIT, license_scan.LEAST)
    got = [(r["dice"], r["start"], r["found"]) for r in license_scan.scan(frame(spark, [text]), license_scan.templates(spark, [("MIT", license_scan._MIT)])).collect()]
    assert got == ([best] if best else []) and (best or times == 30)


def test_templates_beyond_the_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_BIGRAMS", 5)
    texts = [" ".join(words_of(30)) + " Released under the MIT License. " * 3, "Licensed under CC BY 4.0.", None, "none"]
    got = {(r["doc_id"], license_scan.TEMPLATES[r["template_id"]][0], r["start"]) for r in license_scan.scan(frame(spark, texts), license_scan.templates(spark, license_scan.TEMPLATES[:8])).collect()}
    assert {(0, "MIT", 30), (1, "CC-BY-4.0", 0)} <= got and {d for d, *_ in got} == {0, 1}


def test_license_wordings_are_the_published_ones(spark):
    """Notices as projects carry them: names filled in, wrapped, with words of their own."""
    mit = "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + license_scan._MIT
    holders = (license_scan._BSD + license_scan._BSD_THIRD + license_scan._BSD_END).replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("the copyright holder", "the University")
    gpl = "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nFoo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with Foo. If not, see <https://www.gnu.org/licenses/>."
    got = {}
    for r in license_scan.scan(frame(spark, [wrapped(mit), wrapped(holders, 72, "// "), wrapped(gpl, 66, "; ")]), license_scan.templates(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert "MIT" in got[0] and "BSD-3-Clause" in got[1] and "GPL-3.0" in got[2]


@pytest.mark.parametrize("name", ["op1_url_hash_prefix", "op2_license_dice"])
def test_native_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    import __spark_entry__ as entry

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, data).select(columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


# 3


TEXTS = [None, "", " ", "a", "Hello  world's  end\n\n\tof it  ", "naïve 日本語 𝄞 ١٢٣", "<|endoftext|> stays", "x" * 5000, " \n" * 3000, " ".join(words_of(3000)), "a\u00a0b\u2003c\u3000d", "tab\t\tand\r\nlines\x0b\x0c end "]


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers

    return bpe.encoding(bpe.default_ranks(), public_tokenizers.PATTERN)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1'.s \n\t\u00a0é", max_size=120), st.integers(1, 9))
def test_safe_pieces_give_the_ids_of_the_whole(enc, text, cut):
    assert bpe.encode_text(enc, text, cut) == enc.encode_ordinary(text)
    assert "".join(p for p, _ in bpe.safe_pieces(text, cut)) == text


@pytest.mark.parametrize("mark", [" ", "\n", "\t", "\u3000", "\r\n"])
def test_long_runs_of_white_space(enc, mark):
    for text in (mark * 100_000, "a" + mark * 100_000, mark * 100_000 + "b c", "a" + mark * 100_000 + "\n" + "b" + mark * 70_000 + " c"):
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    huge = "word" + mark * 5_000_000 + "end"
    ids = bpe.encode_text(enc, huge)
    assert enc.decode(ids) == huge
    few = bpe.encode_text(enc, "word" + mark * 100_000 + "end")  # a run is cut into the longest ids, so any length goes on alike
    assert ids[:1000] == few[:1000] and ids[-3:] == few[-3:]


def test_control_characters_are_no_white_space(enc):
    text = "".join(f"a!\x1c.{i}" for i in range(40_000))
    assert bpe.encode_text(enc, text, 100) == enc.encode_ordinary(text)


def test_a_long_run_passes_the_query_and_the_files(spark, enc):
    texts = ["a" + " " * 1_200_000 + "b", "\n" * 1_200_000, "x" * 1_000_000]
    docs = frame(spark, texts)
    out = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    assert all(out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    path = token_files.new_path(spark, "runs")
    token_files.write(docs, path)
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.read(spark, path).collect()} == {i: r["n_tokens"] for i, r in out.items()}


def test_bpe_round_trip(spark, enc):
    docs = frame(spark, TEXTS + TEXTS[4:5], [*range(len(TEXTS)), None]).withColumnRenamed("lang", "N_Tokens").withColumnRenamed("source", "ids_SHA256")
    for r in bpe.round_trip(docs, cut=64).collect():
        ids = enc.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, cut=64)).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [r["text"] or "" for r in back]
    assert bpe.round_trip(docs.limit(0)).count() == 0


# 4


def test_quality_learns_and_ignores_held_out_labels(spark):
    good = [" ".join(words_of(60, i)).capitalize() + "." for i in range(150)]
    bad = [" ".join([w + "!!" for w in words_of(20, i)]).upper() + " spam spam spam" for i in range(150)]
    docs = frame(spark, [t for pair in zip(good, bad) for t in pair] + ["", None])
    marks = [(i, 1 - i % 2, 0) for i in range(300)]
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    first = quality.score(docs, quality.train(docs, labels)).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted").collect()
    out = [r for r in first if r["held_out"] and r["doc_id"] < 300]
    assert len(out) > 50 and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in first)
    wrong = labels.where("doc_id is not null and quality is not null").withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = quality.score(docs.withColumnRenamed("lang", "Score").withColumnRenamed("source", "PREDICTED"), quality.train(docs, wrong)).select("doc_id", "score").collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in first}


def test_quality_without_both_classes(spark):
    docs = frame(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in quality.score(docs, quality.train(docs, ones)).collect())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_descent_separates_and_bounds_alpha():
    rows = [np.array([i % 2]) for i in range(20)]
    w, b = quality.descend(rows, [np.ones(1)] * 20, np.array([1.0, -1.0] * 10), 2)
    assert w[0] + b > 0.9 and w[1] + b < -0.9


def dense_hinge(x, y, cost):
    """The same problem by projected gradient on the dense dual, with the intercept as a constant column."""
    x = np.c_[x, np.ones(len(x))] * y[:, None]
    q = x @ x.T
    a, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        a = np.clip(a + step * (1 - q @ a), 0, cost)
    return x.T @ a


def test_descent_equals_a_dense_solver():
    r = np.random.default_rng(4)
    x = np.where(r.random((60, 12)) < 0.4, r.normal(size=(60, 12)), 0.0)
    y = np.where(x @ r.normal(size=12) + 0.3 * r.normal(size=60) > 0, 1.0, -1.0)
    rows = [np.flatnonzero(v) for v in x]
    w, b = quality.descend(rows, [v[k] for v, k in zip(x, rows)], y, 12, epochs=4000)
    assert np.r_[w, b] == pytest.approx(dense_hinge(x, y, 1.0), abs=0.02)


def test_fit_equals_plain_python():
    """Naive-Bayes ratios, unit rows, the hinge fit and the ranking of rows, from scratch."""
    import math

    r = random.Random(9)
    rows, labels = [], []
    for i in range(100):
        label = i % 2
        rows.append(np.array(sorted({r.randrange(8) + 8 * (r.random() < (0.8 if label else 0.3)) for _ in range(5)}), np.int32))
        labels.append(label)
    model = quality.fit_rows(rows, np.array(labels), bits=4, epochs=4000)
    counts = [[1 + sum(j in x for x, y in zip(rows, labels) if y == c) for j in range(16)] for c in (0, 1)]
    ratio = [math.log(counts[1][j] / sum(counts[1])) - math.log(counts[0][j] / sum(counts[0])) for j in range(16)]
    dense = np.zeros((100, 16))
    for i, x in enumerate(rows):
        norm = math.sqrt(sum(ratio[j] ** 2 for j in x))
        for j in x:
            dense[i, j] = ratio[j] / norm
    inside = np.arange(100) % 5 != 4
    w = dense_hinge(dense[inside], np.where(np.array(labels) == 1, 1.0, -1.0)[inside], 1.0)
    want = dense @ w[:16] + w[16]
    assert quality.margins(model, rows) == pytest.approx(want, abs=0.03)
    got = quality.scores(model, rows)
    assert ((got > 0.5) == (np.array(labels) == 1)).mean() > 0.8


def test_op4_marks_the_held_out_fold(spark, tmp_path):
    good = [" ".join(words_of(60, i)).capitalize() + "." for i in range(120)]
    bad = [" ".join(words_of(20, i)).upper() + " !!! spam" for i in range(120)]
    frame(spark, [t for pair in zip(good, bad) for t in pair]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op4_quality(spark, str(tmp_path)).collect()
    assert len(out) == 240 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.5) == 1 - r["doc_id"] % 2 for r in out)


# 7


def test_pages(spark):
    from pyspark.sql import functions as F

    boiler = '<nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    pages = [
        (f"<html><head><title>t</title><style>p{{}}</style></head><body>{boiler}<div class='ad'>Buy this now.</div><article><h1>A &amp; B</h1><p><b>One<br><p>Two   &lt;x&gt; <script>var a='</p>'</script>three</article><footer>&copy; me</footer></body></html>", "A & B\n\nOne\n\nTwo <x> three"),
        (f"<body>{boiler}<main><p>First para.</p><ul><li>Point one<li>Point two</ul></main><section class='comments'><h2>Comments</h2><p>I like what you wrote here, it is true.</p></section></body>", "First para.\n\nPoint one\n\nPoint two"),
        ("<body><aside><p>Related things to read.</p></aside><article><p>Text goes on here.</p><form><p>Your mail</p><input></form></article></body>", "Text goes on here."),
        ("just text, &amp no markup", "just text, & no markup"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<!-- only --><script>x", ""),
        ("", ""),
        (None, ""),
        ("<article>" + "<p>" + "word " * 20_000 + "</p>" + "<div>" * 30 + "deep" + "</article>", "word " * 19_999 + "word\n\ndeep"),
        ('<article><p title="a > b" class=x>q<p>r</article>', "q\n\nr"),
        ("<article><p>a<</p>< b</p></article>", "a<\n\n< b"),
    ]
    df = spark.createDataFrame([(i if i else None, "u", h, "x", 5) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, Text string, N_CHARS long")
    got = html_text.extract(df, html_text.train(df)).select("page_id", "text", "n_chars").collect()
    for r in got:
        want = pages[r["page_id"] or 0][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_text.extract(df.limit(0), html_text.train(df.limit(0))).count() == 0
    assert html_text.train(df.where(F.col("html").isNull())).edge


def test_formulas_drawings_and_fallback_are_text():
    model = html_text.estimate(html_text.hand_counts(html_text.hand_labelled()))
    long = "The words of a paragraph go on until its end, and then the next begins."
    for inner, want in [
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
        ("<svg viewBox='0 0 1 1'><style>t{}</style><path d='M0'/><text x=1>North</text><text x=2>South</text></svg>", "North South"),
        ("<xmp><b>bold &amp;</b></xmp>", "<b>bold &amp;</b>"),
        *((f"<{t}>Shown {t} instead</{t}>", f"Shown {t} instead") for t in ("noscript", "object", "canvas", "audio", "video", "template", "iframe", "noframes")),
        ("<script>no</script><select><option>no</select><textarea>no</textarea>yes", "yes"),
    ]:
        got = html_text.extract_text(f"<article><p>{long}</p><p>A {inner} B</p><p>{long}</p></article>", model)
        assert " ".join(got.split()) == f"{long} A {want} B {long}"
    for tag in ("math", "svg", "xmp", "noscript", "object", "video", "iframe", "template", "canvas", "title", "textarea", "select"):
        got = html_text.extract_text(f"<article><p>{long}</p><p>A <{tag}>B</p><p>{long}</p></article>", model)
        assert got == f"{long}\n\nA B\n\n{long}"
    assert html_text.extract_text(f"<article><p>{long}</p><script>x<p>{long}</p></article>", model) == long


def test_sum_product_equals_enumeration():
    import itertools
    import math

    page = html_text.parse("<body><div class=ad><p>x</p></div><article><p>yy</p><ul><li><a href=1>z</a></li></ul></article></body>")
    model = html_text.estimate(html_text.hand_counts(html_text.hand_labelled()))
    where = html_text.places(page)
    n, total, mass = len(page.tags), 0.0, [0.0] * len(page.tags)
    for labels in itertools.product((0, 1), repeat=n - 1):
        y, w = (1, *labels), 1.0
        for i in range(1, n):
            p = 1 / (1 + math.exp(-model.edge.get((html_text._kind(page, i, where), y[page.parents[i]]), model.edge["*", y[page.parents[i]]])))
            odds = sum(model.trait.get(t, 0.0) for t in html_text._evidence(page, i, where))
            e = 1 / (1 + math.exp(-max(-30, min(30, odds))))
            w *= (p if y[i] else 1 - p) * (e if y[i] else 1 - e)
        total += w
        mass = [m + w * (v == 1) for m, v in zip(mass, y)]
    assert html_text.marginals(page, model) == pytest.approx([m / total for m in mass])


def test_words_of_names_are_learnt_and_place_counts():
    model = html_text.estimate(html_text.hand_counts(html_text.hand_labelled()))
    long = "The words of a paragraph go on until its end, and then the next begins."
    body = f"<h1>Head</h1><p>{long}</p><p>{long} {long}</p>"
    for inner in (f'<div class="side note"><p>{long}</p></div>', f'<section id="tags"><p>{long}</p><p>{long}</p></section>', f'<div class="unheard-of"><p>{long}</p></div>'):
        assert long in html_text.extract_text(f"<article>{body}{inner}{body}</article>", model).split(long + " " + long)[1][:150]
        got = html_text.extract_text(f"<article>{body}{inner}{body}</article>", model)
        assert got.count(long) == 6 + inner.count(long)
    got = html_text.extract_text(f'<body><div class="x1">We use cookies on this site.</div><article>{body}</article><div class="y7"><p>{long}</p></div></body>', model)
    assert got == f"Head\n\n{long}\n\n{long} {long}"
    got = html_text.extract_text(f'<body><nav><a href="/">Home</a></nav><div id="wrap">{body}<div class="gdpr-consent"><p>{long}</p></div></div><div class="newsletter"><p>{long}</p></div></body>', model)
    assert got == f"Head\n\n{long}\n\n{long} {long}"


def test_precision_and_recall_on_held_out_labelled_pages():
    pages = html_text.hand_labelled()
    found = []
    for fold in range(5):
        model = html_text.estimate(html_text.hand_counts(p for i, p in enumerate(pages) if i % 5 != fold))
        found.append(html_text.measure(pages[fold::5], model))
    assert min(p for p, _ in found) > 0.95 and min(r for _, r in found) > 0.95


@pytest.mark.parametrize(
    "shape",
    ["<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<p><table><td>" + "<div>" * 20_000, "<li>" * 20_000, "<ul><li>" * 10_000, "<select>" * 20_000, "<xmp>" * 20_000, "<head>" * 20_000, "<svg>" + "<path/>" * 20_000,
     "<a '" * 20_000, "<a x='" * 20_000, "<p x=\"'>" * 20_000, "<!--" * 20_000, "<" * 50_000, "</p>" * 20_000, "<td><p>" * 10_000, "&amp" * 20_000, "<math><a/>" * 10_000, "<a =" * 20_000, "<p class= " * 20_000],
)
def test_parsing_is_linear(shape):
    import time

    model = html_text.estimate(html_text.hand_counts(html_text.hand_labelled()[:20]))
    began = time.process_time()
    html_text.extract_text("<article><p>Text.</p>" + shape, model)
    assert time.process_time() - began < 4


# 8


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=700), min_size=1, max_size=5))
def test_codes_are_directly_addressable(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    seg = token_files.Segment(token_files.pack([None, *range(1, len(docs))], [len(d) for d in docs], ids))
    at = seg.offsets.astype(int)
    assert [seg.tokens(a, b).tolist() for a, b in zip(at[:-1], at[1:])] == docs
    assert [seg.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    assert seg.doc_ids == [None, *range(1, len(docs))]


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab '1.\n\t ") for _ in range(50)) for _ in range(60)] + TEXTS[9:10] * 30 + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "word " * 50 + "<|endoftext|>\n word"]
    assert tok.encode(texts[-4], add_special_tokens=False).ids == [64, 220, 50256, 275]
    ids = [*range(len(texts))]
    r.shuffle(ids)
    ids[7], ids[8] = None, None
    path = token_files.new_path(spark, "t")
    token_files.write(frame(spark, texts, ids).repartition(5), path, segment=500)
    rows = token_files.read(spark, path).collect()
    code = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, bytes(x["ids"])) for x in rows) == sorted((i if i is not None else -1, np.array(code(t), "<u4").tobytes()) for i, t in zip(ids, texts))
    rows.sort(key=lambda x: x["start"])
    assert [x["start"] for x in rows] == np.cumsum([0, *[x["n_tokens"] for x in rows]])[:-1].tolist()
    named = [x["doc_id"] for x in rows]
    assert named[:2] == [None, None] and named[2:] == sorted(named[2:])
    assert spark.read.parquet(path).count() > 5
    token_files.write(frame(spark, texts).limit(0), path + "e")
    assert token_files.read(spark, path + "e").count() == 0


def test_word_memory_forgets_and_windows_join(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    monkeypatch.setattr(token_files, "WINDOW", 64)
    e = token_files.PieceEncoder(token_files.default_tokenizer())
    texts = [" ".join(words_of(300, 1)), "", "y" * 300, "a b\nc. d.", " ".join(words_of(300, 2)), "\u3000x \u00a0 \n\n z", ""]
    for _ in range(2):
        got = [x.tolist() for x in e.encode(pa.array(texts, pa.large_string()))]
        assert got == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    e.words.trim()
    assert len(e.words) <= 40 and max(map(len, e.words.text.to_pylist())) <= token_files.LONG_WORD
    found = e.words.find(e.words.text)
    assert found.tolist() == list(range(len(e.words)))
    assert token_files.Words().find(pa.array(["x"])).tolist() == [-1]


def test_equal_word_hashes_mislead_nobody(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "word_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    e = token_files.PieceEncoder(token_files.default_tokenizer())
    texts = [" ".join(words_of(100, k)) for k in range(3)]
    for text in texts * 2:
        assert [x.tolist() for x in e.encode(pa.array([text], pa.large_string()))] == [e.library.encode(text, add_special_tokens=False).ids]


def test_tokenizers_that_split_otherwise_get_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    e = token_files.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some  words here", "", "x"]
    assert not e.by_words
    assert [x.tolist() for x in e.encode(pa.array(texts, pa.large_string()))] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ1'.,s \n\t\r\u00a0\u2003\u3000\u200b\x1dé", max_size=40), min_size=1, max_size=4))
def test_words_give_the_ids_of_the_whole(texts):
    import pyarrow as pa

    e = token_files.encoder(token_files.default_tokenizer())
    assert [x.tolist() for x in e.encode(pa.array(texts, pa.large_string()))] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


# 9


def test_tiles_are_greedy_and_found_in_any_order():
    item = np.arange(1, 31, dtype=np.uint64)
    text = np.r_[item[20:], np.uint64(99), item[5:18], np.uint64(98), item[:5], np.uint64(97), item[5:18]]
    assert decontaminate.tile(item, text, 5) == [(5, 11, 13), (20, 0, 10), (0, 25, 5)]
    assert decontaminate.tile(item, item[:4], 5) == []
    assert decontaminate.tile(item[:0], item, 5) == []


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing all places."""
    taken, tiles = (set(), set()), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and i + k not in taken[0] and j + k not in taken[1]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return tiles
        for i, j in found:
            if not any(i + k in taken[0] or j + k in taken[1] for k in range(best)):
                for k in range(best):
                    taken[0].add(i + k)
                    taken[1].add(j + k)
                tiles.append((i, j, best))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=40), st.integers(2, 5))
def test_tiles_equal_brute_force(item, text, least):
    as_hashes = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
    assert decontaminate.tile(as_hashes(item), as_hashes(text), least) == brute_tiles(item, text, least)


def test_repetitive_texts_take_no_pairs():
    import time

    began = time.process_time()
    one = np.full(20_000, 7, np.uint64)
    assert decontaminate.tile(one[:9000], one, 5) == [(0, 0, 9000)]
    period = np.tile(np.arange(1, 8, dtype=np.uint64), 3000)
    assert sum(t[2] for t in decontaminate.tile(period[:8000], np.r_[period[3:5000], np.uint64(99), period[:5000]], 5)) > 7900
    broken = np.concatenate([np.r_[np.full(k % 30 + 5, 3), 1000 + k] for k in range(300)]).astype(np.uint64)
    decontaminate.tile(broken, one[:12_000] - np.uint64(4), 5)
    assert time.process_time() - began < 20


def test_op9_equals_brute_force_on_a_table(spark, tmp_path):
    items = [" ".join(words_of(15 + 5 * k, 40 + k, 60)) for k in range(6)]
    r = random.Random(6)
    docs = []
    for k in range(60):
        own = words_of(80, 100 + k, 60)
        cut = items[k % 6].split()
        a = r.randrange(len(cut))
        docs.append(" ".join(own[:40] + cut[a : a + r.randrange(4, 30)] + own[40:] + cut[: max(a - 3, 0)]))
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x["doc_id"], x["item_id"]): (x["n_tiles"], x["covered"]) for x in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, b in enumerate(items):
            tiles = brute_tiles(b.split(), d.split(), 5)
            if sum(t[2] for t in tiles) >= 0.5 * len(b.split()):
                want[i, j] = (len(tiles), sum(t[2] for t in tiles))
    assert got == want and 5 < len(want) < 60


def test_decontamination(spark, monkeypatch):
    item, other = words_of(40, 1), words_of(30, 2)
    rest = " ".join(words_of(400, 3))
    texts = {
        0: rest + " " + " ".join(item) + " " + rest,
        1: rest,
        2: " ".join(item[20:]) + " " + rest + " " + ", ".join(item[:20]).upper(),
        3: " ".join(item[:19]) + " " + rest,
        4: None,
        5: "",
        6: rest + "".join(f" {item[i]} x" for i in range(40)),
        7: " ".join(item + ["and"] + other),
        8: " ".join(words_of(30_000, 5)) + " " + " ".join(item),
        9: rest + " it is TOO, short! " + rest,
        10: "too much, short",
        11: "Word",
    }
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in texts.items()] + [(None, texts[0], 9, "x"), (0, texts[0], 9, "x")], "doc_id long, text string, item_id long, coverage string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "too short"), (4, None), (None, " ".join(other)), (5, "word"), (6, "one two three four"), (7, "?!")], "item_id long, text string")
    for most in (1_000_000, 35):  # broadcast, and joined
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["item_id"] is None else r["item_id"]) for r in decontaminate.find(docs, bench).collect())
        assert got == sorted([(0, 1), (0, 1), (-1, 1), (2, 1), (7, 1), (7, 2), (7, -1), (8, 1), (9, 3), (11, 5)])
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 3, 4, 5, 6, 10]
    assert decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), bench).count() == 0


# 10


def test_collisions_estimate_generalised_jaccard():
    r = np.random.default_rng(5)
    terms = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    for _ in range(3):
        a, b = r.integers(0, 6, (2, len(terms)))
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s, t = (fingerprints.signature(terms[x > 0], x[x > 0], 1024) for x in (a, b))
        assert abs(fingerprints.likeness(s, t) - want) < 0.06


def test_collisions_of_texts_with_far_more_terms_than_draws():
    r = np.random.default_rng(6)
    terms = np.unique(r.integers(0, 1 << 63, 750_000, dtype=np.uint64))
    a, b = terms[:500_000], terms[250_000:750_000]
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s, t = (fingerprints.signature(x, np.ones(len(x), np.int64), 256) for x in (a, b))
    assert abs(fingerprints.likeness(s, t) - want) < 0.1  # three standard errors


def test_fingerprints(spark):
    texts = [None, "", "one", "one", " ".join(words_of(300)), " ".join(words_of(300)), "Ünï " * 50, " ".join(words_of(20_000, 4)), "a b c d e f"]
    ids = [5, 3, 9, 1, 12, 7, None, 8, 2]
    docs = frame(spark, texts, ids).withColumnRenamed("lang", "Fingerprint").withColumnRenamed("source", "near_next")
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[9]["fingerprint"] == got[1]["fingerprint"] and got[12]["fingerprint"] == got[7]["fingerprint"]
    assert got[5]["fingerprint"] == "" and got[5]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprints.compare_with_next(frame(spark, ["a b c"])).first()
    assert (one["near_next"], one["n_chars"]) == (1.0, 5)


def test_successors_with_repeated_ids_and_many_nulls(spark):
    texts = [f"t{i % 7} word {i % 3}" for i in range(300)]
    ids = [None if i % 3 == 0 else 4 if i % 3 == 1 else i for i in range(300)]
    rows = fingerprints.compare_with_next(frame(spark, texts, ids)).collect()
    assert len(rows) == 300
    hashes = {(r["t"], r["h"]) for r in frame(spark, texts).selectExpr("text t", "xxhash64(text) h").collect()}
    by_hash = {t: h % (1 << 64) for t, h in hashes}
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is None, -(x[0] or 0), by_hash[x[1]]))
    want = sorted(hashlib.sha256(fingerprints.edit(t, order[(k + 1) % 300][1]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in rows) == want
