import random
import struct
import zlib
from datetime import datetime, timedelta
from unittest.mock import Mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade import session
from palisade.config import Config
from palisade.functions import text as T
from palisade.operators import audit, fuzzy, images, limiter, metrics, terms, windows
from palisade.operators.signals import actions, as_json, assess, decide, extract
from palisade.operators.windows import second_pass_scan
from palisade.plans import queries
from palisade.session import ARROW_BYTES, persisted, ship
from palisade.sources import readers

CONFIG = Config()


def decisions(spark, texts, config=CONFIG):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    return {r.id: r for r in assess(df, "prompt", config, rewrite=None).collect()}


def test_ladder_of_decisions(spark):
    got = decisions(spark, [
        "The conductor reads", "idiot", "please skip the score", "I am 9 years old", "clown", "clown. that is a mask",
        "the rain falls", "", None, "bad idiot. clown here",
    ])
    assert [got[i].action for i in range(10)] == ["ALLOW", "BLOCK", "BLOCK", "BLOCK", "BLOCK", "ALLOW", "ALLOW", "ALLOW", "ALLOW", "BLOCK"]
    assert got[5].reason == "Valid adult assertion with ambiguous terms"
    assert got[0].reason == "Legitimate professional/educational context"
    assert got[1].reason == "Direct violation (severity: HIGH)"
    assert got[3].reason == "Direct violation (severity: UNKNOWN)"
    assert got[4].reason == "Ambiguous youth context without valid adult assertion (severity: LOW)"
    assert got[6].signals.severity is None and got[6].signals.context_score == 0 and got[1].signals.context_score is None
    assert got[9].signals.cross_sentence == ["idiot"]


def test_fuzzy_terms_raise_the_risk(spark):
    got = decisions(spark, ["idiott", "moronn"])
    assert all(r.reason.startswith("High risk (score: 3, NLP: False, second_pass: 1)") for r in got.values())
    assert got[0].signals.second_pass[0].term == "idiot"


def test_strict_mode_keeps_boundaries(spark):
    text = ["you silly idiot person"]
    assert decisions(spark, text)[0].action == "ALLOW" and decisions(spark, text, CONFIG.strict())[0].action == "BLOCK"


def test_rewriting_and_json(spark):
    df = spark.createDataFrame([(1, "scum", True), (2, "scum", False), (3, "fine", True)], "id int, prompt string, fun boolean")
    out = as_json(assess(df, "prompt", CONFIG, rewrite="fun", verbose=True))
    rows = {r.id: r for r in out.collect()}
    assert rows[1].rewritten_prompt == "sea foam" and rows[2].rewritten_prompt is None and rows[3].rewritten_prompt is None
    assert '"rewritten_prompt":null' in rows[2].json and rows[1].squashed == "scum"


def test_join_form_equals_expression_form(spark):
    rng = random.Random(2)
    windows = sorted({"".join(rng.choice("idotclwnmrse") for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"idiots", "clowns", "scumm", "trashh", "pathetical"})
    df = spark.createDataFrame([(w,) for w in windows], "window string")
    lexicon = spark.createDataFrame([(t,) for t in CONFIG.lexicon], "term string")
    joined = {(r.window, r.term, r.match_type, r.dist) for r in fuzzy.match_windows(df, lexicon, CONFIG).collect()}
    native = {(m.window, m.term, m.match_type, m.dist) for r in df.select(fuzzy.second_pass(F.col("window"), CONFIG).alias("m")).collect() for m in r.m}
    assert joined == native and len(joined) >= 4


def test_joined_decisions_equal_expression_decisions(spark):
    texts = ["plain words here", "an idiott walks", "an idiott walks", "moronn and clwns and clownn", "idiot", "conductor of the moronn", "moronn", "", None]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "id int, prompt string")
    for config in (CONFIG, CONFIG.strict()):
        columns = ("id", "prompt", "action", "reason", "context_score", "second_pass")
        want, got = (sorted(map(str, decide(extract(df, "prompt", config), config, joined=j).select(*columns).collect())) for j in (False, True))
        assert got == want and any("High risk" in r for r in got)


def test_scanned_matches_equal_the_expression(spark):
    """Repeated n-grams, edges of blanks, letters beyond ASCII, windows shorter than an n-gram, tokens too long for any."""
    rng = random.Random(5)
    parts = ["clown", "clwn", "moronn", "idiotic", "worthles", "a", "ab", "laßer", "ſcum", "aaaa", "losersloser", "trash", "trashtrash", ".", "日本", "x" * 40, "fo", "ol", "dolt!", "foul"]
    texts = [rng.choice(("", " ", "- ")) + rng.choice((" ", "\u3000 ")).join(rng.choice(parts) for _ in range(rng.randrange(7))) + rng.choice(("", " ")) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id int, t string")
    for config in (CONFIG, Config(jaccard_percent=50, hamming_threshold=12), Config(ngram=2, window_tokens=2)):
        got, want = df.select("id", second_pass_scan(F.col("t"), config).alias("m")).collect(), df.select("id", fuzzy.second_pass(F.col("t"), config).alias("m")).collect()
        assert {r.id: r.m for r in got if r.id <= len(texts)} == {r.id: r.m for r in want if r.id <= len(texts)} and sum(len(r.m) for r in want if r.m) > 40
        assert [r.m for r in got if r.id > len(texts)] == [None]


def test_long_texts_are_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_CHARS", 200)
    words = [random.Random(i).choice(("clwn", "moronn", "lo ser", "plain", "y" * 50, "an")) for i in range(400)]
    scan = windows.Scan(CONFIG)
    parts = windows._pieces(" ".join(words), CONFIG)
    assert len(parts) > 50 and max(map(len, parts)) < 600
    found = {m["window"]: m for p in scan.matches(parts) for m in p}
    assert [found[w] for w in sorted(found)] == scan.matches([" ".join(words)])[0] and len(found) == 2


def test_strict_query_counts_fuzzy_blocks(spark, tmp_path):
    texts = ["plain words here", "an idiott walks", "an idiott walks", "moronn", "idiot"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    plain, strict = decisions(spark, texts), decisions(spark, texts, CONFIG.strict())
    for i in range(len(texts)):
        pair = plain[i].action, strict[i].action
        want[pair] = want.get(pair, 0) + 1
    assert {(r.action, r.strict_action): r.n for r in queries.decide_strict(spark, str(tmp_path)).collect()} == want
    assert strict[1].action == plain[3].action == "BLOCK"


def test_strict_query_counts_each_row_once(spark, tmp_path):
    rows = [(1, "idiot"), (1, "plain words"), (1, "scum"), (None, "moronn"), (None, None), (2, "an idiott walks"), (3, "I am in the 4th grade")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(r.n for r in queries.decide_strict(spark, str(tmp_path)).collect()) == len(rows)


def test_actions_equal_the_decisions_of_each_mode(spark):
    texts = ["you silly idiot person", "an idiott walks", "moronn", "age 7", "I am in the 4th grade", "4th grade conductor", "cl0wn. that is a mask", "nasty rehearsal manager",
             "clown moron", "trash, scum and stupid", "i d i o t", "1d10t", "clwn of age", "ⓘdiot", "bad idiot. clown here", "tr-ash", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    for config in (CONFIG, Config(hard_terms=("idiot", "scum of"), ambiguous_terms=("clown", "mo ron"))):
        plain, strict = decisions(spark, texts, config), decisions(spark, texts, config.strict())
        want = {i: (r.action, strict[i].action) for i, r in plain.items()}
        assert {r.id: (r.action, r.strict_action) for r in actions(df, "prompt", config).collect()} == want and len(set(want.values())) >= 3


def test_strict_forms_are_computed_once(spark):
    """The normalised text's expression isn't repeated where its column is named; it was, over 400 times."""
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    for out in (extract(df, "t", CONFIG.strict()), actions(df, "t", CONFIG)):
        assert 0 < out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 40


def test_window_hashes_equal_those_of_the_windows():
    """Counts of many votes are added at once, in bytes or, for long windows, in whole numbers."""
    text = "aaaa " * 40 + "clown moron 日本 😀 " + "".join(random.Random(3).choice("ab c") for _ in range(300)).strip()
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    for config, most in ((CONFIG, 32), (Config(window_chars=280), 280), (Config(ngram=4), 32)):
        a = np.arange(0, len(text) - most)
        b = a + np.array([random.Random(int(i)).randrange(most + 1) for i in a])
        sims, name, _ = windows.Scan(config)._sims(chars, text, a, b)
        assert sims.tolist() == fuzzy.simhashes([text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], config.ngram, fuzzy._GramHashes()).tolist()
        runs = [text[i : i + config.ngram] for i in range(len(name))]
        assert len(set(zip(runs, name.tolist(), strict=True))) == len(set(runs)) == len(set(name.tolist()))


def test_arrow_batches_are_bounded_by_bytes(spark):
    ship(spark)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2000).alias("t"))
    sizes = [r.n for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) > 2 * ARROW_BYTES and max(sizes) < 2 * ARROW_BYTES


def test_hamming_join_loses_no_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(9))) for b in base]
    a, b = spark.createDataFrame([(x,) for x in base], "x long"), spark.createDataFrame([(y,) for y in near], "y long")
    got = sorted((r.x, r.y, r.dist) for r in fuzzy.hamming_join(a, b, "x", "y", 5).collect())
    assert got == sorted((x, y, (x ^ y).bit_count()) for x in base for y in near if (x ^ y).bit_count() <= 5)


def fold(times, most, window):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if t - x < window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


def test_rejected_requests_leave_no_trace(spark):
    rng = random.Random(4)
    rows, wanted = [], {}
    for client in (*"abc", None):
        times = sorted(rng.uniform(0, 120) for _ in range(60))
        for k, (t, ok) in enumerate(zip(times, fold(times, 3, 10.0), strict=True)):
            rows.append((client, len(rows), t))
            wanted[len(rows) - 1] = ok
    df = spark.createDataFrame([*rows, ("a", 999, None)], "client string, n int, t double").repartition(3)
    got = {r.n: r.allowed for r in limiter.rate_limit(df, client="client", time="t", most=3, window_s=10.0, tie="n").collect()}
    assert got == {**wanted, 999: False}
    edge = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 0.9), ("a", 1.2)], "client string, t double")
    assert [r.allowed for r in limiter.rate_limit(edge, client="client", time="t", most=2, window_s=1.0).orderBy("t").collect()] == [True, True, False, True]


def test_terms_need_sources_and_age(spark):
    entries = spark.createDataFrame([("f1", "trash that with"), ("f2", "Trash and THAT"), ("f2", "that"), ("f1", None)], "feed string, body string")
    counts = terms.candidates(entries, feed="feed", content=F.col("body"))
    assert {(r.term, r.feed, r.n) for r in counts.collect()} == {("that", "f1", 1), ("with", "f1", 1), ("and", "f2", 1), ("that", "f2", 1)}
    none = spark.createDataFrame([], "term string")
    assert [(r.term, r.category, r.sources) for r in terms.promote(counts, none).collect()] == [("that", "hard_terms", 2)]
    now = datetime(2024, 5, 2, 12)
    pending = spark.createDataFrame([("h", "old", (now - timedelta(hours=25)).isoformat(), 2, 2), ("h", "young", (now - timedelta(hours=1)).isoformat(), 2, 2), ("h", "junk", "junk", 2, 2), ("h", "none", None, 2, 2)], "category string, term string, added string, sources long, weight int")
    assert {r.term for r in terms.refresh(pending, counts, none, now).collect()} == {"young", "junk", "none", "that"}


def png(pixels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    y, x = np.mgrid[:100, :100]
    pictures = {"plain": np.full((100, 100, 3), 77), "check": np.repeat((((x // 10 + y // 10) % 2) * 255)[..., None], 3, 2), "stripes": np.repeat(((x // 10 % 2) * 255)[..., None], 3, 2)}
    for name, p in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png(p.astype(np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    hashed = images.hash_images(readers.images(spark, str(tmp_path))).select(F.regexp_extract("image.origin", r"(\w+)\.png$", 1).alias("name"), "phash")
    got = {r.name: r.phash for r in hashed.collect()}
    known = {k: v for k, v in got.items() if k in pictures}
    assert known["plain"] == 0 and known["check"] != known["stripes"] and 0 not in (known["check"], known["stripes"])
    assert all(0 <= v < 1 << 63 and v.bit_count() <= 31 for v in known.values())
    listed = spark.createDataFrame([(f"{known['check'] ^ 0b101:016x}",)], "known string")
    out = {r.name: r for r in images.assess_images(hashed.where("name <> ''"), listed, key="name").collect()}
    assert out["check"].action == "BLOCK" and out["check"].min_distance == 2 and out["check"].matches[0].dist == 2
    assert out["stripes"].action == "ALLOW" and out["plain"].phash == "0" * 16
    nearest = {r.name: r.min_distance for r in images.nearest_known(hashed.where("phash is not null"), listed, key="name").collect()}
    assert nearest["check"] == 2 and nearest["stripes"] > 10
    uploads = {r.path.rsplit("/", 1)[1]: r.status for r in readers.image_uploads(spark, str(tmp_path), Config(max_image_bytes=50)).collect()}
    assert uploads["broken.png"] == 200 and uploads["check.png"] == 413
    assert out["check"].reason == "CSAM image match detected (min hamming distance: 2)"
    bad = images.assess_images(spark.createDataFrame([("b", None, None), ("c", None, 200_000_000)], "name string, phash long, pixels long"), listed, key="name").orderBy("name").collect()
    assert [r.action for r in bad] == ["BLOCK"] * 2 and "error" in bad[0].reason and "limits" in bad[1].reason


def test_hash_list(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"known_csam_phashes": ["00ff00ff00ff00ff", "255"]}')
    assert {r.known for r in readers.known_hashes(spark, str(tmp_path / "h.json")).collect()} == {"00ff00ff00ff00ff", "00000000000000ff"}


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One</title><description>d</description></item></channel></rss>")
    row = readers.feed_entries(spark, str(tmp_path / "a.xml")).first()
    assert row.title == "One" and row.feed.endswith("a.xml")


def test_metrics(spark):
    rows = [(1, True, "ALLOW", "a", None)] * 3 + [(2, False, "BLOCK", "b", "HIGH"), (3, False, "BLOCK", "c", None)]
    df = spark.createDataFrame(rows, "n int, allow boolean, action string, reason string, severity string")
    s = metrics.summary(df).first()
    assert (s.total, s.allows, s.blocks, s.block_rate) == (5, 3, 2, 0.4)
    assert metrics.summary(df.limit(0)).first().block_rate == 0
    assert [r.reason for r in metrics.top_reasons(df, "n", 2).collect()] == ["a", "b"]
    assert {(r.action, r.category, r.n) for r in metrics.decision_counter(df).collect()} == {("ALLOW", "ALLOW", 3), ("BLOCK", "HIGH", 1), ("BLOCK", "UNKNOWN", 1)}


def test_audit_holds_digests_only(spark, tmp_path):
    df = assess(spark.createDataFrame([(1, "secret words")], "id int, prompt string"))
    audit.append(audit.audit_rows(df, request_id="id", prompt="prompt"), str(tmp_path / "log"))
    raw = spark.read.text(str(tmp_path / "log")).first()[0]
    assert "secret" not in raw and "prompt_sha256" in raw


def test_requests_source(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "1", "prompt": "hello"}\n{"id": "2"}\n')
    rows = readers.text_requests(spark, str(tmp_path / "r.json")).orderBy("id").collect()
    assert [(r.prompt, r.do_fun_rewrite) for r in rows] == [("hello", False), (None, False)]


def test_scans_are_pruned(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", T.deobfuscate(F.col("text")).alias("d")).where("doc_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "GreaterThan(doc_id,5)" in plan


@pytest.mark.parametrize("trust", [True, False])
def test_client_key(spark, trust):
    df = spark.createDataFrame([("h", " 1.1.1.1 , 2.2.2.2"), ("h", None)], "host string, f string")
    assert [r[0] for r in df.select(limiter.client_key(F.col("host"), F.col("f"), trust)).collect()] == (["1.1.1.1", "h"] if trust else ["h", "h"])


@pytest.mark.parametrize(("taken", "collections"), [(751, 1), (750, 0)])
def test_stored_steps_release_the_drivers_heap(spark, monkeypatch, taken, collections):
    """A step that leaves more than half of the heap taken is followed by a collection."""
    runtime = Mock(**{"totalMemory.return_value": taken, "maxMemory.return_value": 1500})
    release, jvm = session.heap_released, Mock()
    jvm._jvm.java.lang.Runtime.getRuntime.return_value = runtime
    monkeypatch.setattr(session, "heap_released", lambda _: release(jvm))
    assert persisted(spark.range(3)).count() == 3
    assert runtime.gc.call_count == collections
