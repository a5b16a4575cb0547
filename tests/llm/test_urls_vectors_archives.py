"""URL filter, vector search, archives, and the registered queries against SQL."""

import gzip
import hashlib
import io
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from palisade.llm import queries, url_filter, vector_search, warc
from palisade.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"

URLS = [
    (1, "http://A.Example.com/en/7/x?q#f"), (2, "http://com/en/"), (3, "https://example.com/en/8"), (4, "http://notexample.net/de/8"),
    (5, "http://x.example.net/de/88"), (6, "no scheme"), (7, None), (8, ""), (9, "http://a.b.org?x=/es/"), (10, "http://org/es/ñ"),
    (11, "://example.com/en/7"), (12, "http://example.com"), (13, "http://user@Host.ORG:80/es/"), (13, "http://user@Host.ORG:80/es/"),
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and str(best), best.verdict if best else "allow"


@pytest.mark.parametrize("most", [100, 0])
def test_urls_by_trie_and_by_join(spark, most):
    rules = [*queries.URL_RULES, Rule("allow", "org", "/"), Rule("allow", "com", "/en/"), Rule("block", "b.org", "/")]
    df = spark.createDataFrame([(i, u, "old") for i, u in URLS], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, max_broadcast=most).collect())
    assert got == sorted((i, *brute(u, rules)) for i, u in URLS)
    assert url_filter.judge_urls(df.limit(0), rules, max_broadcast=most).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, [], otherwise="block").collect()} == {"block"}


def test_join_knows_every_path_length(spark):
    rules = [url_filter.Rule("block", "a.example", "/" + "x" * n + "/") for n in range(1, 1201)]
    df = spark.createDataFrame([(n, f"https://a.example/{'x' * n}/page") for n in range(1, 1201)], "page_id long, url string")
    got, want = (sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, max_broadcast=m).collect()) for m in (0, 10_000))
    assert got == want and all(r[2] == "block" for r in got)


def test_nearest_equals_brute_force_at_factor_one(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[50:90] = vectors[0]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0, None] * 4), (1005, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vector_search.nearest(df, F.col("vec_id") % 25 == 0, k=5, factor=1.0, shard_rows=64, query_block=7).collect()
    x = vectors.astype(float)
    for q in range(0, 400, 25):
        score = vector_search.cosine(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == order
        assert [s for _, _, s in mine] == pytest.approx([score[i] for i in order], abs=1e-15)
    assert {r.query_id for r in got} == set(range(0, 400, 25))
    assert vector_search.nearest(df.limit(0), F.lit(True)).count() == 0
    two = vector_search.nearest(df.where("vec_id in (1, 2)"), F.lit(True), k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in two) == [(1, 1, 2), (2, 1, 1)]


def test_repeats_of_a_query_hide_no_equal_vector(spark):
    rows = [(0, [1.0, 0.0])] * 9 + [(i, [1.0, 0.0]) for i in range(1, 8)] + [(9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = vector_search.nearest(df, F.col("vec_id") == 9, k=3, factor=1.0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 0), (2, 0), (3, 0)]
    own = df.dropDuplicates().where("vec_id < 9").unionByName(spark.createDataFrame([(0, [1.0, 0.0])] * 8, df.schema)).repartition(1)
    got = vector_search.nearest(own, F.col("vec_id") == 0, k=3, factor=1.0, block_bytes=16).collect()
    assert {(r.rank, r.vec_id) for r in got} == {(1, 1), (2, 2), (3, 3)}


def test_production_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op7_vector_search(spark, SF).collect()
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = vector_search.cosine(np.broadcast_to(x[q], x.shape), x)
        score[q] = -9
        least = np.sort(score)[-5]
        mine = [r.score for r in got if r.query_id == ids[q]]
        hits, total = hits + sum(s >= least - 1e-12 for s in mine), total + 5
    assert hits / total >= 0.9


def pages(spark):
    big = "<html>" + "x" * 200
    rows = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "é", "é" * 80 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3"), (1, "again", big)]
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archives_round_trip(spark, tmp_path):
    df = pages(spark)
    folder = f"file://{tmp_path}/warc"
    out = warc.archive_round_trip(df, folder=folder).collect()
    assert len(out) == 10
    html = {(r.page_id, r.url): (r.html or "").encode() for r in df.collect()}
    for r in out:
        key = (r.page_id, r.url.replace("%0D", "\r").replace("%0A", "\n") if r.url else None)
        body = html[key]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        repeat = body.startswith(b"<html>") and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if repeat else ("response", None))
        assert r.payload == (None if repeat else body)
    names = [p for p in (tmp_path / "warc").iterdir() if p.name.endswith(".warc.gz")]
    assert names and not list((tmp_path / "warc").glob("*.mono*"))
    for p in names:  # each index line is a member of its own
        raw = p.read_bytes()
        for line in (p.parent / (p.name + ".idx")).read_text().splitlines():
            offset, stored, size = map(int, line.split())
            assert len(gzip.decompress(raw[offset : offset + stored])) == size
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_normaliser_reads_any_members(tmp_path):
    rng = random.Random(1)
    records = [warc.record_bytes(i, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), "d", None, False) for i in range(40)]
    whole = b"".join(records)
    for name, raw in (("one", gzip.compress(whole)), ("two", gzip.compress(whole[:5000]) + gzip.compress(whole[5000:]))):
        (tmp_path / name).write_bytes(raw)
        assert warc.normalise(pafs.LocalFileSystem(), f"{tmp_path}/{name}", f"{tmp_path}/{name}.warc.gz") == 40
        with gzip.open(tmp_path / f"{name}.warc.gz") as f:
            assert f.read() == whole
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(iter([whole[:-100]])))
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(b"")))) == b""


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name]).df()[columns].astype(object)
    mine = got.toPandas()[columns].astype(object)
    clean = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d.itertuples(index=False))
    assert clean(mine) == clean(want)
