"""Operators and stages that compare rows, against brute force."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import common, near_dedup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def text_of(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, changes, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


# 5


@pytest.mark.parametrize("kind", ["plain", "hot", "few", "empty", "nulls"])
def test_shards(spark, kind):
    r = random.Random(1)
    rows = {
        "plain": [(i, text_of(r.randrange(1, 80), i)) for i in range(1500)],
        "hot": [(i, "the same text for a third of all rows" if i % 3 == 0 else text_of(20, i)) for i in range(1500)],
        "few": [(i, "x" * i) for i in range(7)],
        "empty": [],
        "nulls": [(None, None)] * 50 + [(3, "é")] * 50 + [(i, "") for i in range(50)],
    }[kind]
    out = sharding.assign(frame(spark, rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "key").repartition(3)).collect()
    key = lambda i, t: (i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(key(i, t) for i, t in rows) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out)
    sizes, slots = np.zeros(40), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if kind in ("plain", "hot"):
        largest = max(r["size"] for r in out)
        assert np.abs(sizes - sizes.mean()).max() <= 0.02 * sizes.mean() + largest
    shards, weight = {}, {}
    for r in out:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        weight[r["text_crc32"]] = weight.get(r["text_crc32"], 0) + r["size"]
    assert all(len(s) == 1 for g, s in shards.items() if weight[g] <= sizes.sum() / 40)
    assert kind != "hot" or max(map(len, shards.values())) > 6


@pytest.mark.parametrize("slice_rows", [10**6, 9])
def test_groups_of_half_a_shard_stay_whole_and_shards_stay_even(spark, monkeypatch, slice_rows):
    """Whatever the number of slices that a group which is moved is sorted in."""
    monkeypatch.setattr(sharding, "SLICE_ROWS", slice_rows)
    r = random.Random(8)
    rows = [(i, text_of(r.randrange(5, 40), i)) for i in range(6000)]
    for k in range(60):  # groups of up to nine tenths of a shard
        rows += [(10_000 + 1000 * k + i, text_of(20, -k - 1)) for i in range(r.randrange(20, 140))]
    out = sharding.assign(frame(spark, rows).repartition(4)).collect()
    sizes, shards = np.zeros(40), {}
    for x in out:
        sizes[x["shard"]] += x["size"]
        shards.setdefault(x["text_crc32"], set()).add(x["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert np.abs(sizes / sizes.mean() - 1).max() < 0.03
    for s in range(40):
        slots = sorted(x["slot"] for x in out if x["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_do_not_depend_on_partitions(spark):
    docs = frame(spark, [(i, text_of(10, i % 400)) for i in range(800)])
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs.coalesce(1)).collect()}
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs.repartition(7)).collect()}


def test_slices_of_a_shard_are_numbered_through(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 2000)
    out = sharding.assign(frame(spark, [(i, text_of(20, i)) for i in range(900)]), shards=5).collect()
    for s in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) > 100


# 6


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(s), least[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize("threshold", [85, 80])
def test_components_match_brute_force(spark, threshold):
    rows = [(i, text_of(60 + i % 40, i)) for i in range(60)]
    base = text_of(150, 777)
    n = len(rows)
    rows += [(n + i, edited(base, i % 9, i)) for i in range(150)]  # many likenesses around the threshold
    rows += [(1000 - i, base.upper()) for i in range(40)] + [(2000, text_of(4, 1)), (2001, text_of(4, 1).upper()), (2002, ""), (2003, None), (2004, " \n"), (2005, text_of(25_000, 3)), (2006, edited(text_of(25_000, 3), 100, 4))]
    got = near_dedup.near_duplicates(frame(spark, rows).withColumnRenamed("lang", "component_id").repartition(4), threshold).collect()
    want = brute(rows, threshold)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(near_dedup, "GROUP_DOCS", 2)
    chain = [text_of(200, 5)]
    for i in range(30):
        chain.append(edited(chain[-1], 2, i))
    rows = list(enumerate(chain))
    random.Random(2).shuffle(rows)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 85)


def test_hot_families_match_brute_force(spark, monkeypatch):
    """Copies, a large family of near copies and its stragglers, with keys, hubs and classes above the bound."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(near_dedup, "GROUP_DOCS", 3)
    base = text_of(200, 31)
    rows = [(i, base) for i in range(0, 300, 3)]
    rows += [(i, edited(base, 1 + i % 7, i)) for i in range(1, 300, 3)] + [(i, text_of(30 + i % 5, i)) for i in range(2, 300, 3)]
    random.Random(3).shuffle(rows)
    got = near_dedup.near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 85)


def test_join_by_key_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("m")).where("k <> 7").withColumn("f", F.col("k") * 2)
    got = common.join_by_key(rows, facts, ["k"], 500)
    assert sorted(map(tuple, got.select("k", "id", "m", "f").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "id", "m", "f").collect()))
    assert facts.where("m >= 10").count() == 1


def test_linked_equals_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(base, 250), r.integers(0, 1 << 60, 20, dtype=np.uint64)]) for _ in range(40)]
    owner = np.arange(40)
    want = {(a, b) for a in range(40) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 36 * len(set(sets[a]) | set(sets[b]))}
    found = near_dedup.linked(sets, owner, 36)
    root = {i: i for i in range(40)}
    other = dict(root)
    for links, tree in ((want, root), (found, other)):
        for a, b in links:
            while tree[a] != a:
                a = tree[a]
            while tree[b] != b:
                b = tree[b]
            tree[max(a, b)] = min(a, b)
    top = lambda t, v: v if t[v] == v else top(t, t[v])
    assert [top(root, i) for i in range(40)] == [top(other, i) for i in range(40)] and want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b = text_of(50, 1), text_of(50, 2)
    rows = [(None, a), (None, a), (4, a), (7, a), (7, a), (None, b), (None, b), (9, text_of(9, 9))]
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted([(-1, 4, False), (-1, 4, False), (4, 4, True), (7, 4, False), (7, 4, False), (-1, -1, True), (-1, -1, True), (9, 9, True)])
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    left = near_dedup.deduplicate(frame(spark, [(7, b), (7, b), (8, b), (None, b), (None, b), (3, "")]))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == sorted([(7, b), (-1, b), (3, "")])


def test_deduplicate_drops_rows_and_not_ids(spark):
    a, b, c, d = (text_of(150, k) for k in range(1, 5))
    rows = [(5, a), (7, a), (7, b), (None, a), (None, c), (None, edited(c, 1, 1)), (None, edited(c, 1, 2)), (8, d), (8, edited(d, 1, 3)), (None, d), (None, ""), (None, None)]
    left = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicate(frame(spark, rows).repartition(3), apart=False).collect()]
    assert sorted(i for i, t in left if i) == [5, 7, 8] and len(left) == 6
    assert {(5, a), (7, b), (None, ""), (None, None)} < set(left)
    assert sum(i is None and t in {c, *(t for _, t in rows[4:7])} for i, t in left) == 1
    named = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicate(frame(spark, rows)).collect()]
    assert set(left) - {(8, t) for _, t in rows[7:9]} < set(named) and len(named) == 8 and {(None, a), (None, d)} < set(named)


def test_long_chain_of_links(spark):
    links = spark.range(400).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    both = links.union(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "x long, y long"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(both).collect()}
    assert all(got[i] == 0 for i in range(1, 401)) and got[1001] == 1000
    assert near_dedup.components(links.limit(0)).count() == 0


# pipeline


def plant(spark, path):
    """A small corpus with good and bad texts, copies, near copies and benchmark passages."""
    r = random.Random(4)
    items = [text_of(30, 900 + i) for i in range(5)]
    good = [text_of(r.randrange(60, 200), i) for i in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in text_of(60, 500 + i).split()) for i in range(80)]
    rows = [(i, t) for i, t in enumerate(good)] + [(200 + i, t) for i, t in enumerate(bad)]
    rows += [(300 + i, good[i]) for i in range(20)] + [(400 + i, edited(good[i], 1, i)) for i in range(20) if len(good[i].split()) > 100]
    rows += [(500 + i, good[50 + i] + "\n" + items[i % 5] + "\n" + text_of(40, 7000 + i)) for i in range(20)]
    labels = [(i, int(i < 200), 0) for i in range(0, 280, 2)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(rows), items


def test_pipeline_keeps_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    from assay.llm import bpe

    rows, items = plant(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "near_dedup", "decontamination", "byte_bpe"]
    kept = stages["quality_classifier"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    good = {i for i in rows if not 200 <= i < 280}
    assert {r["doc_id"] for r in kept.collect()} == good
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = sorted((i, rows[i]) for i in good)
    first = {i for i, (_, c) in brute(left, corpus_pipeline.SIMILARITY).items() if i == c}
    want = {i for i in first if not any(item in rows[i] for item in items)}
    assert set(out) == want and any(i >= 500 for i in first)
    enc = bpe.encoding(bpe.default_ranks(), public_tokenizers.PATTERN)
    assert all(out[i]["n_tokens"] == len(enc.encode_ordinary(rows[i])) for i in out)


CONTRACT = {
    "op1_url_hash_prefix": ("pages", "page_id", "page_id host path rule verdict"),
    "op3_byte_bpe": ("documents", "doc_id", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op4_quality": ("documents", "doc_id", "doc_id held_out score predicted"),
    "op5_histogram_sort": ("documents", "doc_id", "doc_id size text_crc32 law shard slot grown_shard"),
    "op6_minhash": ("documents", "doc_id", "doc_id n_shingles component_id kept"),
    "op7_dom_model": ("pages", "page_id", "page_id url text n_chars"),
    "op8_addressable_codes": ("documents", "doc_id", "doc_id start n_tokens ids_crc32"),
    "op10_weighted_sampling": ("documents", "doc_id", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_return_what_they_should(spark, name):
    import __spark_entry__ as entry

    source, key, columns = CONTRACT[name]
    data = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{data}/{source}.parquet")
    out = entry.queries()[name](spark, data)
    assert out.columns[: len(columns.split())] == columns.split()
    rows = out.collect()
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in given.select(key).collect())
    texts = {r[key]: r["text"] or "" for r in given.select(key, "text").collect()} if source == "documents" else {}
    if name == "op8_addressable_codes":
        from tokenizers import Tokenizer

        from assay.llm import token_files

        library = Tokenizer.from_file(token_files.default_tokenizer())  # its own, as it comes
        start = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    if name == "op6_minhash":
        want = brute([(i, t) for i, t in texts.items()], 85)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    if name == "op5_histogram_sort":
        shards, weight = {}, {}
        for r in rows:
            shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
            weight[texts[r["doc_id"]]] = weight.get(texts[r["doc_id"]], 0) + r["size"]
        share = sum(weight.values()) / 40
        assert {r["law"] for r in rows} == {"bytes"} and all(len(s) == 1 for t, s in shards.items() if weight[t] <= share)
    if name == "op3_byte_bpe":
        import hashlib

        assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
