"""N-gram Jaccard join, suffix-array dedup and connected components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from palisade.llm import ngram_jaccard, suffix_dedup
from palisade.llm.components import connected_components


def shingle_set(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 4), (20, 21), (5, 5)], "a long, b long")
    got = {r.id: r.label for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 5: 5}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = []
    for family in range(12):
        words = prose(family, rng.choice((3, 8, 14, 25, 40, 90))).split()
        for _ in range(rng.randint(1, 6)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs, shingle=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_large_group_of_near_copies_is_linked_through_any_chain(spark):
    words = prose(99, 60).split()
    rows = []
    for i in range(40):  # a chain: neighbours are alike, ends are not
        words = list(words)
        words[i] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = {r.component_id for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80).collect()}
    assert got == {c for _, c in brute_components(rows, 4, 80).values()}


@pytest.mark.parametrize("block", [2, 5])
def test_crowded_keys_are_dealt_out_without_losing_links(spark, monkeypatch, block):
    """Many sets under the same keys: near copies of several texts that share a long passage, and strangers to them."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "KEY_SHARE", 64)
    rng = random.Random(block)
    passage = prose(500, 40).split()
    rows = []
    for family in range(6):
        words = passage + prose(600 + family, 9 + family).split()
        for _ in range(7):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = f"y{rng.randrange(9)}"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs, shingle=2, percent=75).collect()}
    assert got == brute_components(rows, 2, 75)


def test_a_long_text_has_bounded_keys():
    assert all(ngram_jaccard.boundary(length, 85) < 700 for length in (100.0, 1e4, 1e9))
    assert ngram_jaccard.boundary(2.0, 85) < ngram_jaccard.boundary(20.0, 85)


def test_linked_rows_share_a_component_number(spark):
    texts = [prose(1, 90), prose(1, 90) + " end", prose(2, 30), "", prose(3, 30)]
    docs = spark.createDataFrame([(7, texts[0]), (8, texts[1]), (9, texts[2]), (10, ""), (9, texts[4])], "doc_id long, text string")
    rows = ngram_jaccard.near_duplicates(docs).collect()
    by = {(r.doc_id, r.text_hash): r for r in rows}
    numbers = [r.component for r in rows if r.doc_id in (7, 8)]
    assert numbers[0] == numbers[1] and len({r.component for r in rows}) == 4
    assert len(by) == 5 and [r.component for r in rows if r.doc_id == 10] == [None]
    assert len({r.component for r in rows if r.doc_id == 9}) == 2 and {r.component_id for r in rows if r.doc_id == 9} == {9}


def test_near_duplicates_of_messy_rows(messy, no_docs):
    rows = ngram_jaccard.near_duplicates(messy.withColumn("n_shingles", F.lit("mine")), shingle=4, percent=85).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[2][1] == 1 and by[4][1] == 1
    assert by[6] == (0, 6) and by[7] == (0, 7) and by[8] == (0, 8)
    assert by[9] == (1, 9) and by[11] == (1, 10)
    assert by[None][1] is None
    assert sum(r.doc_id == 15 for r in rows) == 2 and by[15][1] == 15
    assert ngram_jaccard.near_duplicates(no_docs).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = np.append(rng.integers(1, rng.integers(2, 6), int(rng.integers(1, 50))), 0)
        sa = suffix_dedup.suffix_array(s)
        wanted = sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        assert sa.tolist() == wanted
        plcp, _ = suffix_dedup.permuted_prefixes(s, sa)
        for r in range(1, len(s)):
            a, b, n = wanted[r], wanted[r - 1], 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert plcp[a] == n


def test_both_forms_of_induction_agree(monkeypatch):
    rng = np.random.default_rng(1)
    strings = [np.append(rng.integers(1, top, 3000), 0) for top in (2, 3, 9, 700, 5000)] + [np.array([3, 1] * 400 + [2] * 300 + [0])]
    arrays = []
    for least in (0, 1 << 40):
        monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", least)
        arrays.append([suffix_dedup.suffix_array(s).tolist() for s in strings])
    assert arrays[0] == arrays[1]
    assert arrays[0][-1] == sorted(range(len(strings[-1])), key=lambda i: tuple(strings[-1][i:]))


def brute_windows(texts, length):
    raw = [t.encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    return {(n, i) for n, b in enumerate(raw) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1}


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_crowded_anchors_are_dealt_out_by_windows(spark, most):
    """A passage in many surroundings: contexts of one anchor all differ, whatever number of them a shard may hold."""
    passage = prose(7, 20)
    texts = [f"{prose(100 + i, 3)[: 5 + i]} {passage} {prose(200 + i, 4)}" for i in range(14)] + [prose(300, 40), prose(300, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = set()
    for r in suffix_dedup.repeated_spans(docs, length=60, gram=16, most_contexts=most).collect():
        for at, n in r.windows:
            got |= {(r.k, at + i) for i in range(n)}
    assert got == brute_windows(texts, 60)


@pytest.mark.parametrize(("bytes_", "due"), [(300, False), (399, False), (400, True), (500, True)])
def test_planted_passages_are_due_from_400_bytes_on(spark, bytes_, due):
    """A passage of more than fifty words may hold fewer than 400 bytes: then no 400-byte string starts twice."""
    passage = prose(5, 120).replace("é", "e")[:bytes_]
    texts = [f"{prose(40 + i, 30)} {'qwer'[i]}{passage}{'asdf'[i]} {prose(60 + i, 30)}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(docs, keep_text=False, digests=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == brute_spans(texts, 400)
    assert {r.n_removed for r in out} == ({bytes_} if due else {0})


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [7, 60, 400])
def test_removed_bytes_equal_brute_force(spark, messy, length):
    rows = messy.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").repartition(3)
    out = suffix_dedup.remove_repeats(docs, length=length, keep_text=False, digests=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == brute_spans([r.text for r in rows], length)


def test_small_shards_and_segments(spark, monkeypatch):
    texts = [prose(1, 300), prose(2, 200) + prose(1, 300)[100:900], prose(3, 400), prose(3, 400)[50:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(docs, length=50, shard_bytes=64)
    assert spans.count() == 4
    data = np.frombuffer(prose(1, 300).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, len(data)]), 50, 16)
    assert (np.diff(whole[1]) > 0).all() and whole[2].sum() == len(data) - 49


def test_removal_of_messy_rows(messy, no_docs):
    clashing = messy.withColumns({c: F.lit(1) for c in ("windows", "k", "th", "at", "n", "fp", "Copies", "c")})
    out = suffix_dedup.remove_repeats(clashing.withColumn("n_bytes", F.lit("mine")), length=60)
    assert set(clashing.columns) <= set(out.columns)
    out = out.collect()
    assert len(out) == messy.count() and {r.k for r in out} == {1}
    by = {r.doc_id: r for r in out}
    assert by[6].text is None and by[7].text == "" and by[1].text == ""
    assert by[17].n_removed == 3000 and by[9].text == "one"
    assert by[12].n_spans == 1 and by[12].text
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_cut_characters_stay_whole(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "x" + shared + "y"), (2, "zz" + shared + "w")], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs, length=31).collect():
        assert "�" not in r.text and r.text.encode().decode() == r.text
