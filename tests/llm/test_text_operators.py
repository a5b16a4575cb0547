"""Fingerprints, packing, sentence pieces, language ID and toxicity."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from palisade.llm import fingerprint, language_id, packing, queries, sampling, sentence_pieces, toxicity
from palisade.llm.arrow_text import blocks, buffers, words

SHIPPED = "/root/testdata/sf0.01"


def test_words_split_on_ascii_space_only():
    texts = ["a\tb\x0bc d", "", None, "x\xa0y", " z "]
    data, offsets = buffers(pa.array(texts))
    starts, ends = words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "c", "d", "x\xa0y", "z"]


def test_blocks_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "b" * 50, "", None, "c"])], names=["t"])
    assert [b.num_rows for b in blocks(batch, "t", 10)] == [1, 1, 3]


# fingerprints


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_likeness_is_edit_distance():
    texts = [prose(i, 200) for i in range(6)] + [prose(0, 200)[:600] + prose(9, 60)]
    a = fingerprint.of_texts(texts)
    common = fingerprint._common(a.signs[0][:6], a.lengths[0][:6], a.signs[0][1:], a.lengths[0][1:])
    signs = [a.text(i).split(":")[1] for i in range(7)]
    assert common.tolist() == [naive_lcs(x, y) for x, y in zip(signs, signs[1:], strict=False)]
    assert all(fingerprint.of_texts([t]).text(0) == a.text(i) for i, t in enumerate(texts))
    assert fingerprint.likeness(a, a).tolist() == [1.0] * 7
    assert fingerprint.likeness(a.take(np.array([0])), a.take(np.array([6])))[0] > 0.3


def test_neighbours_equal_brute_force(spark, messy, no_docs):
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    out = {r.doc_id: r for r in fingerprint.compare_neighbours(docs, partition_bytes=2000).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprint.of_texts([x]) for x in (t, changed, following))
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.text(0), b.text(0))
        assert r.near_edited == pytest.approx(fingerprint.likeness(a, b)[0]) and r.near_next == pytest.approx(fingerprint.likeness(a, c)[0])
    assert out[2].fingerprint == out[1].fingerprint and out[2].near_next == 1.0
    assert fingerprint.compare_neighbours(messy).count() == messy.count()
    assert fingerprint.compare_neighbours(no_docs).count() == 0
    assert fingerprint.fingerprints(messy.withColumn("fingerprint", F.lit(1))).where("fingerprint is null").count() == 0


# packing


def test_cached_tokeniser_equals_the_tokeniser():
    fast = packing.CachedTokenizer.of(packing.default_tokenizer())
    texts = [prose(3, 400), "a  b\n\n c", "don't we'll I'M it's  ", "³ ½ a_b __", "日本語 text", "<|endoftext|> x", "a\x85b \x1f c", " ", "", "é€5 “q” …"]
    for text, raw in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == fast.inner.encode(text, add_special_tokens=False).ids


def check_packing(rows, most):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(used)


def test_packing_keeps_every_token(messy, no_docs):
    tokens = packing.CachedTokenizer.of(packing.default_tokenizer())
    rows = packing.pack(messy, most=64).collect()
    sequences = check_packing(rows, 64)
    total = sum(r.length for r in rows)
    assert sequences <= total / 64 * 1.2 + 2
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        if r.doc_id != 15:  # a repeated row
            assert r.start == len(by.setdefault(r.doc_id, []))
            by[r.doc_id] += r.ids
    for i, text in messy.select("doc_id", "text").where("doc_id is null or doc_id <> 15").collect():
        assert by[i] == [*tokens.inner.encode(text or "", add_special_tokens=False).ids, 2]
    assert all(r.length == 64 for r in rows if r.doc_id == 14 and r.piece)
    assert packing.pack(no_docs).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    packer = packing.BestFit(10, open_bins=2)
    assert packer.place(6) == (0, 0) and packer.place(7) == (1, 0)
    assert packer.place(3) == (1, 7)  # free 3 fits better than free 4
    assert packer.place(5) == (2, 0)
    assert packer.place(9) == (3, 0)  # both open: the fullest, bin 0, has closed
    assert packer.place(4) == (2, 5)
    with pytest.raises(ValueError, match="tokens"):
        packer.place(11)


# sentence pieces


def test_pieces_equal_the_library(spark, messy):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentence_pieces.default_model())
    machine = sentence_pieces.PieceTransducer.of(sentence_pieces.default_model())
    rng = random.Random(0)
    letters = "aabbcdeeinrst   ..,!?\n1\té日▁\x00'\"-()/"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [prose(8, 300), "Hello  world", ""]
    for text in texts:
        ids = machine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert machine.decode(ids) == text.replace("▁", " ")
    rows = sentence_pieces.decode(sentence_pieces.encode(messy.withColumn("ids", F.lit(1)))).collect()
    assert all(r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") for r in rows)
    assert sentence_pieces.digests(messy).where("not round_trip").count() == 0


def test_unigram_models_take_the_cheapest_path():
    def piece(text, score, kind=None):
        import struct

        raw = text.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", score) + (b"\x18" + bytes([kind]) if kind else b"")
        return b"\x0a" + bytes([len(body)]) + body

    model = piece("<unk>", 0.0, 2) + piece("a", -1.0) + piece("b", -1.5) + piece("ab", -2.0) + piece("aba", -5.0) + piece("▁", -0.5)
    spec = b"\x1a\x06\x18\x01\x20\x00\x28\x01"
    machine = sentence_pieces.PieceTransducer(model + b"\x12\x02\x18\x01" + spec)
    assert [machine.pieces[i] for i in np.frombuffer(machine.encode("abaz"), "<u4")] == ["▁", "ab", "a", "<unk>"]


# language ID


def languages(n):
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    rng = random.Random(4)
    return [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(12)), k) for i in range(n) for k in [rng.choice(list(kinds))]]


def test_language_is_learned_and_nothing_else_is_read(spark, messy, no_docs):
    docs = spark.createDataFrame(languages(300), "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["xx", "yy", "zz"]
    out = language_id.identify(docs.withColumn("score", F.lit("mine")), model).withColumn("held", sampling.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in out if r.held]) > 0.95
    assert sum(r.rejected for r in out) <= 3 and all(0 <= r.score <= 1 for r in out)
    blind = language_id.identify(docs.select("doc_id", "text", F.lit("qq").alias("lang")), model).select("doc_id", "lang_pred").collect()
    assert sorted(blind) == sorted((r.doc_id, r.lang_pred) for r in out)
    rows = language_id.identify(messy, model, keep_text=False).collect()
    assert len(rows) == messy.count() and "text" not in rows[0].asDict()
    assert {r.lang_pred for r in rows if r.doc_id in (6, 7, 8, 18)} == {"und"} and all(r.rejected for r in rows if r.doc_id in (6, 7, 8, 18))
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.identify(messy, nothing).collect()} == {"und"}


def test_held_out_is_crc32_modulo_four(spark):
    rows = spark.range(200).withColumn("h", sampling.held_out(F.col("id"))).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]


# toxicity


def toxic_tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 40).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(("scoundrel", "dirtbag", "rotter"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_are_found_in_disguise(spark, messy, no_docs):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").where(sampling.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    hidden = ["ba ke sc0undrel lo", "ba r o t t e r mi", "tu d.i.r.t.b.a.g ra", "lo d1rtb4g so", "so rotttterrrr ba", "scoundrel"]
    clean = ["ba ke lo mi", "", None, "tu 123 ra", "keke!!! lolo???"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(hidden + clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, model, with_restored=True).collect()}
    assert [got[i].predicted for i in range(len(hidden))] == [1] * len(hidden)
    assert [got[i].predicted for i in range(len(hidden), len(rows.collect()))] == [0] * len(clean)
    assert got[0].restored[0].text == "scoundrel" and got[1].restored[0].start == 3
    assert toxicity.score(messy.withColumn("predicted", F.lit("x")), model).count() == messy.count()
    assert toxicity.score(no_docs, model).count() == 0
    unlearned = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs.limit(5), unlearned).collect()} == {0}


def test_plain_words_are_left_alone():
    model = toxicity.CharModel()
    restore = toxicity.Restorer(model)
    data, offsets = buffers(pa.array(["plain words, here! 1234 5.6 the&&& of%%%"]))
    assert restore.texts(data, offsets)[1] == []


def letters_of(*texts):
    code = [toxicity._CODE.get(c, len(toxicity._CODE)) for c in " ".join(texts * 200)]
    n = len(toxicity.CharModel().cost)
    return toxicity.CharModel.of_counts(np.bincount([(a * n + b) * n + c for a, b, c in zip(code, code[1:], code[2:])], minlength=n**3))


def test_long_spans_are_restored_whole():
    restore = toxicity.Restorer(letters_of("scoundrel", "plain words"))

    def read(text):
        return restore.texts(*buffers(pa.array([text])))[1]

    assert read("sc0" + "u" * 100 + "ndrel") == ["scoundrel"] and read("s" + "." * 40 + "c.0.u.n.d.r.e" + "." * 40 + "l") == ["scoundrel"]
    assert "scoundrel" in read("x" * 70 + "." + "sc0undrel")[0]
    for shift in range(12):  # some word lies across every 32nd letter
        assert read(" ".join("scoundrel"[shift % 9 :] + "scoundrel" * 8))[0].count("scoundrel") >= 8
    began = time.monotonic()
    read("sc0undrel" * 5000)
    read("-a" * 20_000 + "." * 20_000)
    assert time.monotonic() - began < 20


def test_accented_letters_are_kept(spark):
    docs = spark.createDataFrame([("estúpido imbécile идиот ngốc " * 50,)], "text string")
    restore = toxicity.Restorer(toxicity.CharModel.of_counts(toxicity.letter_counts(docs)))

    def read(text):
        return restore.texts(*buffers(pa.array([text])))[1]

    assert read("ba estúp1do ke") == ["estúpido"] and read("1mbécile") == ["imbécile"] and read("ESTÚP1DO") == ["estúpido"]
    assert read("ba e s t ú p i d o") and read("estúpido") == []
    assert read("e s t ú p i d o")[0] == read("e.s.t.ú.p.i.d.o")[0] == "estúpido"
    assert read("estúúúúpido") == ["estúpido"] and read("ngốốốốc") == ["ngốc"] and read("и д и о т") == ["идиот"]
    assert read("estu\u0301p1do") == ["estu\u0301pido"] and read("• • • • •") == []


def test_accented_disguises_are_toxic():
    texts = [f"{prose(i, 20)} {'estúpido' if i % 3 == 0 else ''}" for i in range(300)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)], letters_of("estúpido", *texts[:3]))
    rows = ["ba estúp1do ke", "ba e s t ú p i d o", "ba estúúúpido", "ba ke lo"]
    assert [s >= toxicity.THRESHOLD for s in model.scores(*buffers(pa.array(rows)), toxicity.Restorer(model.letters))] == [True, True, True, False]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_maps_equal_the_library(rule):
    library = pytest.importorskip("sentencepiece").SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=False, add_dummy_prefix=False, escape_whitespaces=False)
    spec = next(value for number, value in sentence_pieces._fields(library.serialized_model_proto()) if number == 3)
    compiled = sentence_pieces.CharacterMap(dict(sentence_pieces._fields(spec))[2])
    texts = ["", "Hello  W\u00f6rld", "\uff46\uff55ll \u2460\u2461", "A\u030angstr\u00f6m e\u0301", "\ufb01ne", "\u200bzero\xa0b\tsp\r\n x", "\uff76\uff9e", "\u00bd\u2122\u2026", "\U0001f600!"]
    texts += ["".join(map(chr, range(a, a + 40))) for a in range(0x20, 0x3400, 211)]
    assert [compiled.apply(t) for t in texts] == [library.Normalize(t) for t in texts]


def _held_out_rows(spark, query, columns):
    docs = spark.read.parquet(f"{SHIPPED}/documents.parquet").join(spark.read.parquet(f"{SHIPPED}/labels.parquet"), "doc_id", "left")
    return query(spark, SHIPPED).where("held_out").join(docs.select("doc_id", *columns), "doc_id").collect()


def test_languages_of_held_out_documents(spark):
    rows = [r for r in _held_out_rows(spark, queries.op8_language_id, ["lang"]) if r.lang]
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_toxicity_of_held_out_documents(spark):
    rows = [r for r in _held_out_rows(spark, queries.op10_toxicity, ["toxic"]) if r.toxic is not None]
    toxic, clean = ([r for r in rows if r.toxic == v] for v in (1, 0))
    won = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert won >= 0.7 and sum(r.predicted for r in clean) <= 0.02 * len(clean) and 2 * sum(r.predicted for r in toxic) >= len(toxic)
