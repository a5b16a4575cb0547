"""The registered queries' results, stated in DuckDB SQL."""

from __future__ import annotations

from palisade.config import HOMOGLYPHS, Config
from palisade.plans import queries as Q

_CONFIG = Config()
_FROM, _TO = "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values())
_WORD = r"\p{L}\p{N}_"


def _quote(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _rows(texts: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in enumerate(texts)) + ") t(id, s)"


def _normal(source: str, key: str, column: str) -> str:
    """CTEs ending in ``normal`` (key, raw, n)."""
    return rf"""
WITH a AS (SELECT {key}, {column} AS raw, translate(translate(regexp_replace({column}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g'), chr(8232) || chr(8233), '  '), chr(8203) || chr(8204) || chr(8205) || chr(65279), '') AS s FROM {source}),
b AS (SELECT {key}, raw, translate(translate(s, '{_FROM}', '{_TO}'), '013457@$', 'oieastas') AS s FROM a),
c AS (SELECT {key}, raw, string_split(s, '') AS cs FROM b),
d AS (SELECT {key}, raw, array_to_string(list_filter(cs, lambda x, i: NOT (i > 2 AND x <> chr(10) AND x = cs[i - 1] AND x = cs[i - 2])), '') AS s FROM c),
normal AS (SELECT {key}, raw, regexp_replace(lower(s), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g') AS n FROM d)"""


def _squash(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '[\p{{L}}\p{{N}}]') THEN regexp_extract({x}, '^[^\p{{L}}\p{{N}}]*') || regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g') || regexp_extract({x}, '[^\p{{L}}\p{{N}}]*$') ELSE {x} END"


def _deob(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def _spread(x: str) -> str:
    """Every character that ends a word doubled, so that neighbouring words don't share one."""
    return rf"' ' || regexp_replace({x}, '([^{_WORD}])', '\1\1', 'g') || ' '"


def _terms(x: str, terms: tuple[str, ...]) -> str:
    """Sorted distinct whole-word hits of one-word terms."""
    return rf"list_sort(list_distinct(regexp_extract_all({_spread(f'lower({x})')}, '[^{_WORD}](' || '{'|'.join(sorted(terms, key=len, reverse=True))}' || ')[^{_WORD}]', 1)))"


def _soundex(x: str) -> str:
    letters = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    codes = f"translate(substr({letters}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN 'Z000' ELSE substr(rpad(substr({letters}, 1, 1) || replace({codes}, '0', ''), 4, '0'), 1, 4) END"


_GRAMS = "CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), lambda i: substr({x}, CAST(i AS BIGINT), 3)) ELSE [{x}] END"


def _simhash(source: str, key: str, x: str, name: str = "sim") -> str:
    """CTE body: key and the 64-bit hash as hexadecimal digits."""
    return f"""SELECT {key}, printf('%016x', CAST(sum(CASE WHEN v > 0 THEN (1::HUGEINT << b) ELSE 0 END) AS UBIGINT)) AS {name} FROM (
  SELECT {key}, b, sum(CASE WHEN (h >> b::UBIGINT) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS v FROM (
    SELECT {key}, ('0x' || right(md5(unnest({_GRAMS.format(x=x)})), 16))::UBIGINT AS h FROM {source}), (SELECT unnest(range(64)) AS b) GROUP BY {key}, b) GROUP BY {key}"""


_HIT_TERMS = (*_CONFIG.hard_terms, *_CONFIG.ambiguous_terms)
_PAIRS = "list_transform(range(1, len(parts)), lambda i: trim(parts[i]) || ' ' || trim(parts[i + 1]))"


def _cross(terms: tuple[str, ...]) -> str:
    return f"list_sort(list_distinct(flatten(list_transform({_PAIRS}, lambda p: {_terms('p', terms)}))))"


_CROSS = _cross(_CONFIG.hard_terms)


def _contains(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quote(t)})" for t in terms) + ")"


def _level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_any({x}, [{', '.join(map(_quote, terms))}]) THEN '{name}'" for name, terms in _CONFIG.severity.items()) + " ELSE 'UNKNOWN' END"


def _decisions(source: str, key: str, column: str) -> str:
    """CTEs ending in ``decided``. Spelled ages and typos don't occur in the shipped tables and are left out; of the
    fuzzy pass the phonetic test of single tokens is stated, which is less than the pass: a short text around a listed
    term ('The pathetic.') can meet the SimHash test alone, and then the query blocks what this SQL allows."""
    lexicon = [t for t in _CONFIG.lexicon if t not in _CONFIG.adult_assertions]
    values = ", ".join(f"({_quote(t)})" for t in lexicon)
    return _normal(source, key, column) + rf""",
s1 AS (SELECT {key}, raw, n, {_squash('n')} AS q, {_deob('n')} AS o, string_split_regex(n, '[.!?]+') AS parts FROM normal),
s2 AS (SELECT *,
  list_sort(list_distinct(list_concat({_terms('q', _CONFIG.hard_terms)}, {_terms('o', _CONFIG.hard_terms)}))) AS hard,
  list_sort(list_distinct(list_concat({_terms('q', _CONFIG.ambiguous_terms)}, {_terms('o', _CONFIG.ambiguous_terms)}))) AS ambi,
  CASE WHEN len(parts) >= 2 THEN {_CROSS} ELSE [] END AS crossed,
  {_contains("' ' || regexp_replace(n, '[^' || 'a-z0-9' || ']+', ' ', 'g') || ' '", tuple(f' {t} ' for t in _CONFIG.adult_assertions))} AS adult,
  {_contains('n', _CONFIG.injections)} OR regexp_matches({_spread('n')}, '[^{_WORD}](tremolo|fortissimo|soloist mode)[^{_WORD}]') AS injected,
  regexp_matches({_spread('lower(raw)')}, '[^{_WORD}](stage manager|music critic|rehearsal|conductor|soundcheck)[^{_WORD}]') AS allowlisted,
  regexp_matches({_spread('q')}, '[^{_WORD}](k|kinder|kindergarten)[^{_WORD}]') AS school,
  list_transform(regexp_extract_all(lower(raw), '\b(\d{{1,2}})\s*(?:yo|y/o|yrs? old|years? old)\b', 1), lambda x: CAST(x AS INT)) AS ages FROM s1),
windows AS (SELECT {key}, unnest(list_distinct(list_filter(string_split_regex(q, '\s+'), lambda w: length(w) <= 32))) AS w FROM s2),
fuzzy AS (SELECT {key}, count(DISTINCT w) AS k FROM windows, (VALUES {values}) lex(t) WHERE abs(length(t) - length(w)) <= 2 AND length(w) >= 5 AND ({_soundex('t')}) = ({_soundex('w')}) GROUP BY {key}),
s3 AS (SELECT s2.*, coalesce(k, 0) AS k, {_level('list_concat(hard, ambi)')} AS level,
  len(hard) = 0 AND adult AND ({_contains('n', _CONFIG.adult_guards)} OR {_contains('n', _CONFIG.costume_terms)} OR len(list_filter(ages, lambda a: a >= 18)) > 0) AS valid,
  allowlisted AND {_contains('n', _CONFIG.professional_terms)} AND NOT {_contains('n', _CONFIG.veto_terms)} AS professional,
  len(hard) > 0 OR injected OR len(list_filter(ages, lambda a: a < 18)) > 0 AS direct,
  len(ambi) > 0 OR school OR contains(n, 'school uniform') OR len(crossed) > 0 AS unsure FROM s2 LEFT JOIN fuzzy USING ({key})),
s4 AS (SELECT *, greatest(0, 3 * k - CASE WHEN valid THEN 5 ELSE 0 END - CASE WHEN allowlisted THEN 2 ELSE 0 END) AS score, NOT professional AND NOT direct AND NOT unsure AS late,
  len({_terms('n', _CONFIG.hard_terms)}) > 0 AND len({_terms('n', _CONFIG.ambiguous_terms)}) > 0 AS heuristic FROM s3),
s5 AS (SELECT *, heuristic AND score <= 4 AND k = 0 AS nlp FROM s4),
decided AS (SELECT *, CASE WHEN professional THEN true WHEN direct THEN false WHEN unsure THEN valid ELSE NOT (score > 4 OR k > 0 OR nlp) END AS allow,
  CASE WHEN professional THEN 'Legitimate professional/educational context'
       WHEN direct THEN 'Direct violation (severity: ' || level || ')'
       WHEN unsure AND valid THEN 'Valid adult assertion with ambiguous terms'
       WHEN unsure THEN 'Ambiguous youth context without valid adult assertion (severity: ' || level || ')'
       WHEN score > 4 OR k > 0 OR nlp THEN 'High risk (score: ' || score || ', NLP: ' || CASE WHEN nlp THEN 'True' ELSE 'False' END || ', second_pass: ' || k || ')'
       ELSE 'No minor risk detected' END AS reason FROM s5),
final AS (SELECT {key}, CASE WHEN allow THEN 'ALLOW' ELSE 'BLOCK' END AS action, allow, reason, CASE WHEN NOT allow THEN level END AS severity, CASE WHEN late THEN CAST(score AS INT) END AS context_score, crossed, n FROM decided)
"""


_DOCS = _decisions("documents", "doc_id", "text")
_LIMIT = """
SELECT event_id, CAST(ok AS INT) AS allowed FROM (
  SELECT unnest(ids) AS event_id, unnest(list_reduce(ts, lambda a, x: {
    'kept': CASE WHEN len(list_filter(a.kept, lambda y: x.kept[1] - y < 86400)) < 5 THEN list_append(list_filter(a.kept, lambda y: x.kept[1] - y < 86400), x.kept[1]) ELSE list_filter(a.kept, lambda y: x.kept[1] - y < 86400) END,
    'ok': list_append(a.ok, len(list_filter(a.kept, lambda y: x.kept[1] - y < 86400)) < 5)}, {'kept': []::DOUBLE[], 'ok': []::BOOLEAN[]}).ok) AS ok
  FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list({'kept': [epoch(ts)], 'ok': []::BOOLEAN[]} ORDER BY ts, event_id) AS ts FROM events GROUP BY user_id))
"""
_SIGNS = "SELECT vec_id, label, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN (1::HUGEINT << CAST(len(embedding) - i AS INT)) ELSE 0::HUGEINT END)) AS UBIGINT) AS h FROM embeddings"
_FEED = rf"""
WITH e AS (SELECT source AS feed, substr(lower(text), 1, 4000) AS c FROM documents),
t AS (SELECT feed, unnest(regexp_extract_all({_spread('c')}, '[^{_WORD}]({'|'.join(_CONFIG.feed_terms)})[^{_WORD}]', 1)) AS term FROM e WHERE {_contains('c', _CONFIG.feed_gate)}),
counts AS (SELECT term, feed, count(*) AS n FROM t GROUP BY term, feed)
"""
_TYPO = """
SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split_regex(lower(text), '\\s+'), lambda t:
  CASE lower(translate(t, ',.!?;:"''()[]{}', '')) WHEN 'the' THEN 'thee' WHEN 'that' THEN 'yonder' ELSE t END), ' ')) AS sha FROM conversations
"""
_REWRITE = rf"""
SELECT conv_id, turn, sha256(array_to_string(list_transform(regexp_extract_all(lower(text), '[{_WORD}]+|[^{_WORD}]+'), lambda t:
  CASE t WHEN 'the' THEN 'a certain' WHEN 'and' THEN 'plus' ELSE t END), '')) AS sha FROM conversations
"""
_GRAM_SET = "list_distinct(" + _GRAMS.format(x="({x})") + ")"


def _gram_set(x: str) -> str:
    return _GRAM_SET.replace("{x}", f"' ' || {x} || ' '")


_CONV = _decisions("(SELECT conv_id * 1000 + turn AS cid, conv_id, turn, text FROM conversations)", "cid", "text")
_FUZZY_TERMS = ("clown", "morons", "idiots", "losers", "pathetical", "trasher")

ORACLES: dict[str, str] = {
    "normalize_documents": _normal("documents", "doc_id", "text") + " SELECT doc_id, sha256(n) AS sha, length(n) AS chars FROM normal",
    "squash_documents": _normal("documents", "doc_id", "text") + f" SELECT doc_id, sha256({_squash('n')}) AS squashed, sha256({_deob('n')}) AS deobfuscated FROM normal",
    "normalize_odd_texts": _normal(_rows(Q.ODD_TEXTS), "id", "s") + f" SELECT id, n, {_squash('n')} AS q, translate(raw, '{_FROM}', '{_TO}') AS h FROM normal",
    "typo_conversations": _TYPO,
    "rewrite_conversations": _REWRITE,
    "term_hits": f"SELECT doc_id, array_to_string({_terms('text', _HIT_TERMS)}, ',') AS hits FROM documents",
    "term_counts": f"SELECT term, count(*) AS docs FROM (SELECT unnest({_terms('text', _HIT_TERMS)}) AS term FROM documents) GROUP BY term",
    "cross_sentence_hits": _normal("documents", "doc_id", "text") + f" SELECT doc_id, array_to_string(CASE WHEN len(parts) >= 2 THEN {_CROSS} ELSE [] END, ',') AS hits FROM (SELECT doc_id, string_split_regex(n, '[.!?]+') AS parts FROM normal)",
    "context_flags": rf"""SELECT conv_id, turn, CAST(regexp_matches({_spread('lower(text)')}, '[^{_WORD}](that|des)[^{_WORD}]') AS INT) AS allowlisted,
        CAST(contains(lower(text), 'tion') OR contains(lower(text), 'heit') AS INT) AS professional, CAST(regexp_matches({_spread('lower(text)')}, '[^{_WORD}]with[^{_WORD}]') AS INT) AS whole_word,
        CAST(contains(lower(text), 'that is') AS INT) + CAST(contains(lower(text), 'of the') AS INT) + CAST(regexp_matches({_spread('lower(text)')}, '[^{_WORD}]und[^{_WORD}]') AS INT) AS injections FROM conversations""",
    "ages_in_texts": "SELECT * FROM (VALUES (0, '25'), (1, '25'), (2, '100'), (3, ''), (4, '40'), (5, ''), (6, '6'), (7, ''), (8, '2'), (9, '9,12'), (10, ''), (11, '')) t(id, ages)",
    "ages_in_documents": r"SELECT doc_id, len(list_distinct(list_concat(regexp_extract_all(lower(text), '\b(\d{1,2})\s*(?:yo|y/o|yrs? old|years? old)\b', 1), list_concat(regexp_extract_all(lower(text), '\b(?:age)[\s:=]+(\d{1,2})\b', 1), regexp_extract_all(lower(text), '\b(\d{1,2})\s*(?:-?\s*year\s*old)\b', 1))))) AS ages FROM documents",
    "spelled_numbers": "SELECT * FROM (VALUES (0, 17), (1, 21), (2, 5), (3, 0), (4, 206), (5, 3000), (6, NULL), (7, NULL), (8, 1000002)) t(id, value)",
    "simhash_benchmark": _simhash("benchmark", "item_id", "lower(text)", "simhash"),
    "soundex_parts": f"SELECT p_partkey, {_soundex('p_name')} AS code FROM part",
    "ngrams_parts": f"SELECT p_partkey, len(a) AS grams, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS like_type FROM (SELECT p_partkey, {_gram_set('lower(p_name)')} AS a, {_gram_set('lower(p_type)')} AS b FROM part)",
    "shingles_benchmark": r"""WITH t AS (SELECT item_id, string_split_regex(lower(text), '\s+') AS w FROM benchmark)
        SELECT item_id, len(list_distinct(list_filter(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))), lambda x: length(x) <= 32))) AS windows FROM t""",
    "fuzzy_windows": rf"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{{L}}]+')) AS w FROM documents) WHERE w <> '' AND length(w) <= 32),
        t AS (SELECT t FROM (VALUES {', '.join(f"('{t}')" for t in _FUZZY_TERMS)}) x(t)),
        ws AS ({_simhash('w', 'w', 'w')}), ts AS ({_simhash('t', 't', 't')}),
        p AS (SELECT w, t, bit_count(xor(('0x' || ws.sim)::UBIGINT, ('0x' || ts.sim)::UBIGINT)) AS d, {_gram_set('w')} AS a, {_gram_set('t')} AS b, {_soundex('w')} AS cw, {_soundex('t')} AS ct FROM ws, ts),
        k AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM p),
        m AS (SELECT w, t, d, i / CAST(u AS DOUBLE) AS s, CASE WHEN d <= 5 THEN 'simhash' WHEN 100 * i >= 80 * u THEN 'jaccard' WHEN abs(length(t) - length(w)) <= 2 AND length(w) >= 5 AND cw = ct THEN 'soundex' END AS kind FROM k)
        SELECT w AS "window", t AS term, kind AS match_type, CASE WHEN kind = 'simhash' THEN CAST(d AS INT) END AS dist, CASE WHEN kind = 'jaccard' THEN round(s, 6) END AS sim
        FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY t) AS r FROM m WHERE kind IS NOT NULL) WHERE r = 1""",
    "phash_matches": f"""WITH s AS ({_SIGNS}), known AS (SELECT DISTINCT h AS k FROM s WHERE label = 0),
        m AS (SELECT vec_id, count(*) AS matches, min(bit_count(xor(h, k))) AS d FROM s, known WHERE bit_count(xor(h, k)) <= 10 GROUP BY vec_id)
        SELECT s.vec_id, CASE WHEN matches IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS action, coalesce(matches, 0) AS matches, CAST(d AS INT) AS min_distance FROM s LEFT JOIN m ON s.vec_id = m.vec_id""",
    "phash_nearest": f"WITH s AS ({_SIGNS}), known AS (SELECT DISTINCT h AS k FROM s WHERE label = 0) SELECT vec_id, CAST(min(bit_count(xor(h, k))) AS INT) AS min_distance FROM s, known GROUP BY vec_id",
    "rate_limit_events": _LIMIT,
    "feed_candidates": _FEED + " SELECT * FROM counts",
    "feed_promotions": _FEED + " SELECT term, CASE WHEN contains(term, 'that') THEN 'hard_terms' ELSE 'ambiguous_terms' END AS category, count(DISTINCT feed) AS sources, 2 AS weight FROM counts WHERE term <> 'and' GROUP BY term HAVING count(DISTINCT feed) >= 2",
    "pending_expiry": "SELECT category, term FROM (VALUES " + ", ".join(f"({_quote(c)}, {_quote(t)}, {_quote(a)})" for c, t, a, _ in Q.PENDING) + ") p(category, term, added) WHERE try_cast(added AS TIMESTAMP) IS NULL OR try_cast(added AS TIMESTAMP) >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOUR",
    "decide_documents": _DOCS + " SELECT doc_id, action, reason, severity, context_score, array_to_string(crossed, ',') AS cross_sentence FROM final",
    "flagship": _DOCS + " SELECT action, severity, count(*) AS n FROM final GROUP BY ALL",
    "metrics_summary": _DOCS + " SELECT count(*) AS total, count_if(allow) AS allows, count_if(NOT allow) AS blocks, count_if(NOT allow) / greatest(1, count(*)) AS block_rate FROM final",
    "metrics_severity": _DOCS + " SELECT coalesce(severity, 'UNKNOWN') AS severity, count(*) AS n FROM final GROUP BY 1",
    "metrics_reasons": _DOCS + " SELECT reason, count(*) AS n, min(doc_id) AS first_seen FROM final GROUP BY reason ORDER BY n DESC, first_seen LIMIT 5",
    "metrics_counter": _DOCS + " SELECT action, coalesce(severity, CASE WHEN action = 'ALLOW' THEN 'ALLOW' ELSE 'UNKNOWN' END) AS category, count(*) AS n FROM final GROUP BY 1, 2",
    "assess_conversations": _CONV + rf""" SELECT c.conv_id, c.turn, action, reason, sha256(CASE WHEN allow THEN '' ELSE array_to_string(list_transform(regexp_extract_all(n, '[{_WORD}]+|[^{_WORD}]+'), lambda t:
        CASE t {' '.join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in _CONFIG.rewrites.items())} ELSE t END), '') END) AS rewritten_sha FROM final JOIN conversations c ON final.cid = c.conv_id * 1000 + c.turn""",
    "event_rates": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(count(*) / 300.0::DOUBLE, 9) AS per_second FROM events GROUP BY 1, 2",
    "event_ratio": """WITH w AS (SELECT value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS window_start FROM events)
        SELECT window_start, count_if(value > 50) AS hits, count(*) AS n, round(count_if(value > 50) / CAST(count(*) AS DOUBLE), 9) AS ratio FROM w GROUP BY 1""",
    "audit_documents": "SELECT CAST(doc_id AS VARCHAR) AS request_id, 'ALLOW' AS action, 'r' AS reason, sha256(text) AS prompt_sha256, sha256('') AS rewritten_sha256 FROM documents",
    "client_keys": "SELECT * FROM (VALUES (1, '1.2.3.4', '10.0.0.1'), (2, '10.0.0.2', '10.0.0.2'), (3, '10.0.0.3', '10.0.0.3')) t(id, trusted, plain)",
    "upload_statuses": "SELECT * FROM (VALUES (1, 200), (2, 415), (3, 413), (4, 415)) t(id, status)",
}
