"""Repeated passages against sets of windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import substring_dedup
from assay.llm.substring_dedup import FMIndex, Wavelet

SCHEMA = "doc_id long, text string, digest string, c int"


def want(rows, window=13):
    """Sorted (null id, id, n_words, n_removed, digest) by plain dictionaries."""
    split = [((1 << 63) - 1 if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for o, _, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, o), o)
    out = []
    for o, i, words in split:
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < o for j in range(window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i is None, i or 0, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed):
    """Passages that documents share, periodic texts, copies, edges of 12 and 13 words, odd white space."""
    r = random.Random(seed)
    words = lambda n, v=3000: [f"w{r.randrange(v)}" for _ in range(n)]
    common = [words(n) for n in (12, 13, 14, 40, 90)]
    texts = [" ".join(words(60)) for _ in range(8)]
    for _ in range(40):
        parts = [words(r.randrange(0, 30)) + r.choice(common) for _ in range(r.randrange(1, 4))] + [words(r.randrange(0, 30))]
        texts.append(r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    texts += texts[5:15] + ["a " * 50, "a " * 70 + "b", "a b " * 40, "b a " * 40, " ".join(common[0]), " ".join(common[1]), " ".join(common[1]).upper(), "", "  ", None, "x é " * 20, "x é " * 21]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows += [(None, texts[9]), (None, texts[20]), (3, texts[12]), (3, texts[3]), (3, texts[3]), (100, texts[40])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = rows_of(substring_dedup.remove_repeats(frame(spark, rows)))
    assert got == want(rows) and sum(0 < g[3] < g[2] for g in got) > 20


def test_anchors_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_WORDS", 30)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ANCHORS", 0)
    monkeypatch.setattr("assay.llm.common.HOT_ROWS", 3)
    rows = corpus(3)
    assert rows_of(substring_dedup.remove_repeats(frame(spark, rows))) == want(rows)


def test_empty_tables_and_other_windows(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []
    rows = corpus(4)
    assert rows_of(substring_dedup.remove_repeats(frame(spark, rows), window=7)) == want(rows, 7)


def test_long_texts(spark):
    r = random.Random(6)
    long = [f"v{r.randrange(50000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long[1000:1100])), (2, " ".join(long)), (3, " ".join(long[:200_000] + ["cut"] + long[200_005:])), (4, "z " * 300_000), (5, "z " * 20)]
    assert rows_of(substring_dedup.remove_repeats(frame(spark, rows))) == want(rows)


def test_query_equals_brute_force_on_its_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(substring_dedup.op11_fm_index(spark, "/root/testdata/sf0.001")) == want([tuple(d) for d in docs])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=200), st.randoms())
def test_wavelet_ranks_and_minima(values, r):
    values = np.array(values)
    matrix = Wavelet(values)
    c, i = np.array([r.randrange(matrix.first.size) for _ in range(30)]), np.array([r.randrange(len(values) + 1) for _ in range(30)])
    assert matrix.rank(c, i).tolist() == [int((values[:b] == a).sum()) for a, b in zip(c, i)]
    lo = np.array([r.randrange(len(values)) for _ in range(30)])
    hi = np.array([r.randrange(a + 1, len(values) + 1) for a in lo.tolist()])
    assert matrix.smallest(lo, hi).tolist() == [int(values[a:b].min()) for a, b in zip(lo, hi)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=5, max_size=20), min_size=1, max_size=12))
def test_matching_statistics_equal_counting(passages):
    sizes = np.array([len(p) for p in passages])
    index = FMIndex(np.concatenate(passages), sizes, np.arange(len(passages))[::-1] * 3)
    for n, p in enumerate(passages):
        for end in range(5, len(p) + 1):
            length, lo, hi = index.statistics(np.array([index.begin[n] + end]), 5)
            held = lambda k: [q for q, other in enumerate(passages) for s in range(len(other) - k + 1) if other[s : s + k] == p[end - k : end]]  # noqa: B023, E731
            assert length[0] == max((k for k in range(1, 6) if len(held(k)) > 1), default=0)
            if length[0] == 5:
                assert hi[0] - lo[0] == len(held(5)) and index.smallest_owner(lo, hi)[0] == min((len(passages) - 1 - q) * 3 for q in held(5))
