"""Cross-tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
from collections import Counter
from itertools import product

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import alignment

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(models, text):
    """(id, bytes) of each token of both tokenizers over the whole text."""
    a, b = models
    printable = [x for x in range(256) if chr(x).isprintable() and chr(x) != " " and x != 0xAD]
    letters = {chr(x): x for x in printable}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return left, right


def groups_of(models, text):
    if not text:
        return []
    left, right = tokens(models, text)
    raw = (" " + text).encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return []
    ends = []
    for side in (left, right):
        at, found = 0, {}
        for k, (_, x) in enumerate(side):
            at += len(x)
            found[at] = k + 1
        ends.append(found)
    out, i, j = [], 0, 0
    for cut in sorted(ends[0].keys() & ends[1].keys()):
        out.append(([t for t, _ in left[i : ends[0][cut]]], [t for t, _ in right[j : ends[1][cut]]]))
        i, j = ends[0][cut], ends[1][cut]
    return out


def want(models, texts):
    every = [groups_of(models, t) for t in texts]
    held = Counter(p for g in every for p in {p for a, b in g for p in product(a, b)})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g in every:
        links = [p for a, b in g for p in product(a, b)]
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out


TEXTS = [
    None, "", " ", "   ", "a", "Hello world", "  two  spaces  ", "trail ", "line\nline two\n\n  indented\tword\r\n x", "a b   c", "　x   y", "emoji 😀😀 and é and ﬁ①", "▁under ▁", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|> x<|endoftext|>y",
    "\x00nul \x1c sep", "don't we'll I'm 's", "漢字かな交じり文 と 한국어", "0123456789 3.14159", "x" * 3000 + " " + "ab " * 500, " ".join(["word"] * 40), "Hello world", "ÄÖÜ straße naïve", "a  \n b", "\n", "﻿bom", "مرحبا بالعالم",
]


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_whole_texts(spark, models, hot):
    """Whatever part of the counts is broadcast."""
    expected = want(models, TEXTS)
    got = rows_of(alignment.align(frame(spark, TEXTS), hot_pairs=hot))
    for text, g, w in zip(TEXTS, got, expected, strict=True):
        assert g == w, text
    assert sum(w[2] > 0 for w in expected) > 20 and expected[12][:6] == (0,) * 6


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(*alignment.default_models())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", " a", "b", "'s", " ", "　", " ", "é", "é", "漢", "😀", "1", "12", "...", "▁", "\x85", "\x1c", "​"]), st.text(max_size=4)), min_size=1, max_size=12).map("".join).filter(lambda t: t and not any(0xD800 <= ord(c) <= 0xDFFF for c in t)))
def test_segments_give_the_groups_of_the_whole(models, tool, text):
    (which, entries, first), = tool.windows([text])
    expected = groups_of(models, text)
    if tool.links.counts[4][entries].any():
        assert expected == []
    else:
        written = b"".join(tool.links.written[int(e)].as_py() for e in entries)[:-1].decode()
        assert written == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in expected)


def test_windows_and_a_short_memory_change_nothing(models, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW", 64)
    monkeypatch.setattr(alignment, "MEMORY_SEGMENTS", 5)
    tool = alignment.Aligner(*alignment.default_models())
    texts = ["short", "words of a text that is longer than a window and so takes several of them, " * 3, "x" * 200 + " end", "a b"]
    got = {k: b"" for k in range(4)}
    for which, entries, first in tool.windows(texts):
        for k, (a, b) in zip(which.tolist(), zip(first[:-1], first[1:])):
            got[k] += b"".join(tool.links.written[int(e)].as_py() for e in entries[a:b])
    for k, text in enumerate(texts):
        assert got[k][:-1].decode() == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups_of(models, text))


def test_long_texts_pass_the_operator(spark, models, monkeypatch):
    texts = ["word " * 30, " ".join(f"token{i} ,\n" for i in range(60000)), "▁" + "many words " * 300_000, "word"]
    assert len(texts[1]) < alignment.WINDOW < len(texts[2])
    texts.append(" ".join(f"n{i % 977}" for i in range(600_000)))
    assert rows_of(alignment.align(frame(spark, texts))) == want(models, texts)


def test_empty_tables_repeated_rows_and_other_columns(spark, models):
    assert alignment.align(frame(spark, [])).collect() == []
    docs = spark.createDataFrame([(7, "a b", 1, 2), (7, "a b", 1, 2), (None, "a c", 1, 2)], "doc_id long, text string, n_a int, code int")
    got = sorted((r.doc_id is None, r.n_links, r.count_sum) for r in alignment.align(docs, hot_pairs=1).collect())
    w = want(models, ["a b", "a b", "a c"])
    assert got == sorted((i == 2, x[3], x[5]) for i, x in enumerate(w))


def test_query_equals_whole_texts_on_its_table(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert rows_of(alignment.op13_alignment(spark, "/root/testdata/sf0.001")) == want(models, [d.text for d in docs])


def test_coalescing_breaks_where_both_have_ended():
    import numpy as np

    starts, ends, side = np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9]), np.array([0, 0, 0, 1, 1, 1])
    order, group = alignment.coalesce(starts, ends, side)
    assert order.tolist() == [0, 3, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]
