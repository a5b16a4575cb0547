"""Every registered query of the engine against its SQL, and the entry module with and without the other subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from palisade.plans import catalog
from palisade.plans import oracles as O

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v).removesuffix(".0")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", ["decide_documents", "flagship", "metrics_counter", "metrics_reasons", "metrics_summary"])
def test_short_documents_equal_sql(spark, tmp_path, name):
    """Texts of one window, whose second pass turns on the letters of ASCII alone."""
    texts = ["Laßer.", "Moßern.", "Tröß.", "Loßr.", "Clwnn.", "Lessr.", "Straß ve.", "Foll.", "Erö."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def completed(sql):
    """The SQL of a decision with its fuzzy pass made whole: windows of two and three tokens, and all three tests, as the
    SQL of ``second_pass_parts`` states them. The registered SQL has single tokens and the phonetic test only."""
    lexicon = [t for t in O._CONFIG.lexicon if t not in O._CONFIG.adult_assertions]
    runs = r"list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))"
    whole = rf"""windows AS (SELECT doc_id, unnest(list_distinct(list_filter({runs}, lambda w: length(w) <= 32))) AS w FROM (SELECT doc_id, string_split_regex(q, '\s+') AS ws FROM s2)),
lex AS (SELECT unnest([{', '.join(map(O._quote, lexicon))}]) AS t), listed AS (SELECT DISTINCT w FROM windows),
wsim AS ({O._simhash('listed', 'w', 'w')}), tsim AS ({O._simhash('lex', 't', 't')}),
tried AS (SELECT w, t, bit_count(xor(('0x' || wsim.sim)::UBIGINT, ('0x' || tsim.sim)::UBIGINT)) AS d, {O._gram_set('w')} AS a, {O._gram_set('t')} AS b FROM wsim, tsim),
met AS (SELECT DISTINCT w FROM tried WHERE d <= 5 OR 100 * len(list_intersect(a, b)) >= 80 * len(list_distinct(list_concat(a, b))) OR abs(length(t) - length(w)) <= 2 AND length(w) >= 5 AND ({O._soundex('t')}) = ({O._soundex('w')})),
fuzzy AS (SELECT doc_id, count(DISTINCT w) AS k FROM windows JOIN met USING (w) GROUP BY doc_id),
"""
    out, n = re.subn(r"windows AS \(.*?(?=s3 AS)", lambda _: whole, sql, flags=re.S)
    assert n == 1
    return out


@pytest.mark.parametrize("name", ["decide_documents", "flagship", "metrics_counter", "metrics_reasons", "metrics_summary"])
def test_short_documents_with_terms_equal_completed_sql(spark, tmp_path, name):
    """Texts whose windows pass the SimHash test, one of the shipped tables' word pairs among them, or have two tokens."""
    texts = ["The pathetic.", "Que stupid.", "Ungge pathetic.", "Disgusting$$$ ouai.$$$", "Moron th moron.", "Ssm | |", "Clwnn.", "Loser.", "Er an the."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(completed(catalog.oracle_sql()[name])).df()
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
    if name == "decide_documents":
        assert list(got.sort_values("doc_id").action[:6]) == ["BLOCK"] * 6


def test_every_query_has_sql_or_is_compared_elsewhere():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"decide_strict"}


def test_entry_works_without_the_other_subpackage():
    code = (
        "import importlib.util, sys\n"
        "find = importlib.util.find_spec\n"
        "importlib.util.find_spec = lambda n, *a: None if n.startswith('palisade.llm') or n == 'corpus_pipeline' else find(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert 'flagship' in e.queries() and not [n for n in e.queries() if n.startswith('op')] and 'pipeline' not in e.queries()\n"
        "assert not [m for m in sys.modules if m.startswith('palisade.llm')]\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
