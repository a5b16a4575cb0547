"""The pipeline's stages against brute force, each on its own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
from llm_fixtures import prose
from test_sets_and_spans import brute_components
from test_text_operators import check_packing

from palisade.llm import language_id, packing, toxicity
from palisade.llm.arrow_text import buffers
from palisade.session import persisted

SF = "/root/testdata/sf0.001"


def removed(texts, length):
    """What remains of each text, and whether anything went; spans are cut back to whole characters."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        went = any(gone)
        for m in re.finditer(b"\x01+", bytes(gone)):
            a, z = m.span()
            while a < z and b[a] & 0xC0 == 0x80:  # the beginning of this character stays, so all of it does
                gone[a] = 0
                a += 1
            while z < len(b) and z > a and b[z] & 0xC0 == 0x80:
                z -= 1
                gone[z] = 0
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(), went))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language ID", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        frame = persisted(stage(spark, docs, SF))
        after = frame.collect()
        if name != "best-fit packing":
            assert frame.columns == columns
        if name == "language ID":
            model = language_id.fit(docs)
            p = model.probabilities(*buffers(docs.toArrow().column("text")))
            ids = [r.doc_id for r in docs.collect()]
            sure = {i for i, x in zip(ids, p.max(axis=1), strict=True) if x >= model.threshold and any(c.isalpha() for c in before[i].text or "")}
            assert {r.doc_id for r in after} == sure and len(sure) >= 0.97 * len(ids)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            s = model.scores(*buffers(docs.toArrow().column("text")), toxicity.Restorer(model.letters))
            assert {r.doc_id for r in after} == {r.doc_id for r, x in zip(docs.collect(), s, strict=True) if x < 0.3}
        if name == "n-gram Jaccard join":
            groups = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
            assert {r.doc_id for r in after} == {i for i, (_, c) in groups.items() if i == c}
        if name == "suffix-array dedup":
            wanted = {i: (t, went) for i, (t, went) in zip(before, removed([r.text for r in before.values()], pipeline.PASSAGE_BYTES), strict=True)}
            assert {r.doc_id: r.text for r in after} == {i: t for i, (t, went) in wanted.items() if not went or t.strip()}
            assert all(r.n_chars == len(r.text) for r in after if wanted[r.doc_id][1])
        if name == "best-fit packing":
            check_packing(after, packing.SEQUENCE_TOKENS)
            tokens = packing.CachedTokenizer.of(packing.default_tokenizer())
            for i, r in before.items():
                ids = [*tokens.inner.encode(r.text or "", add_special_tokens=False).ids, 2]
                own = sorted((p for p in after if p.doc_id == i), key=lambda p: p.piece)
                assert sum(p.length for p in own) == len(ids)
                assert all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in own)
        else:
            assert all(r.text == before[r.doc_id].text for r in after) or name == "suffix-array dedup"
            docs, before = frame, {r.doc_id: r for r in after}


def test_different_texts_under_one_id_are_judged_each_by_itself(spark):
    one, two, three = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(5, one), (5, two), (5, two), (4, two + " end"), (6, three), (6, three + " end"), (7, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k int")
    kept = sorted((r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert len(kept) == 5 and {(5, one), (4, two + " end"), (7, ""), (8, "")} <= set(kept) and sum(i == 6 for i, _ in kept) == 1
    assert pipeline.passage_stage(spark, docs, SF).columns == docs.columns


def test_messy_and_empty_tables_pass_every_stage(spark, messy, no_docs):
    for name, stage in pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        out = stage(spark, messy, SF)
        assert out.count() > 0 or name == "language ID"
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, messy, SF).collect()}
    assert {1, 6, 7, 9, 15, None} <= kept and not {2, 3, 4, 5, 11} & kept
    assert pipeline.near_duplicate_stage(spark, messy, SF).where("doc_id = 15").count() == 1
