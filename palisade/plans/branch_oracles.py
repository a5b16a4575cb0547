"""The branch queries' results, stated in DuckDB SQL."""

from __future__ import annotations

from palisade.plans import branch_queries as Q
from palisade.plans.oracles import _FEED, _contains, _cross, _decisions, _deob, _gram_set, _normal, _quote, _simhash, _soundex, _spread, _squash, _terms
from palisade.sources.readers import VERSION

_TURNS = "(SELECT conv_id * 1000 + turn AS cid, conv_id, turn, role, text FROM conversations)"
_S = Q.SCORING


def _list(values) -> str:
    return "[" + ", ".join(_quote(str(v)) for v in values) + "]"


def _weight(t: str) -> int:
    return _S.ambiguous_weights.get(t, _S.default_weight)


_AGED = "(SELECT conv_id * 1000 + turn AS cid, text || ' she is ' || CAST(12 + conv_id % 10 AS VARCHAR) || ' years old' AS text FROM conversations)"
_WEIGHTS = " + ".join(f"CASE WHEN list_contains(ambi, {_quote(t)}) THEN {_weight(t)} ELSE 0 END" for t in _S.ambiguous_terms)
_LESS = " + ".join(f"CASE WHEN list_contains(ambi, {_quote(t)}) THEN {max(1, _weight(t) - 2)} ELSE 0 END" for t in _S.ambiguous_terms)
_PENDING = " + ".join(f"CASE WHEN contains(n, {_quote(t)}) THEN {_S.pending_weights.get(t, _S.default_weight)} ELSE 0 END" for t in (*_S.pending_hard, *_S.pending_ambiguous))
_CLUSTERS = " + ".join(f"CASE WHEN len(list_intersect(string_split(n, ' '), {_list(sorted(c))})) >= 2 THEN 3 ELSE 0 END" for c in _S.clusters)
_SCORES = _normal(_AGED, "cid", "text") + rf""",
a1 AS (SELECT cid, raw, n, {_deob('n')} AS o, string_split_regex(n, '[.!?]+') AS parts FROM normal),
a2 AS (SELECT *, list_distinct(list_concat({_terms('n', _S.hard_terms)}, {_terms('o', _S.hard_terms)})) AS hard,
  list_distinct(list_concat({_terms('n', _S.ambiguous_terms)}, {_terms('o', _S.ambiguous_terms)})) AS ambi,
  {_terms('n', ('est', 'is', 'une', 'ein'))} AS school, CASE WHEN len(parts) >= 2 THEN {_cross(_S.hard_terms)} ELSE [] END AS crossed,
  {' + '.join(f"CASE WHEN contains(n, {_quote(t)}) THEN 1 ELSE 0 END" for t in _S.injections)} AS inj,
  regexp_matches({_spread('lower(raw)')}, '[^\p{{L}}\p{{N}}_](et|that)[^\p{{L}}\p{{N}}_]') AS allowlisted, {_CLUSTERS} AS cluster, {_PENDING} AS pending,
  list_transform(regexp_extract_all(lower(raw), '\b(\d{{1,2}})\s*(?:yo|y/o|yrs? old|years? old)\b', 1), lambda x: CAST(x AS INT)) AS ages FROM a1),
a3 AS (SELECT *, len(list_filter(ages, lambda a: a >= 18)) > 0 AS grown, len(list_filter(ages, lambda a: a < 18)) > 0 AS minor FROM a2),
a4 AS (SELECT *, len(hard) = 0 AND {_contains('n', _S.adult_assertions)} AND (grown OR {_contains('n', _S.adult_guards)} OR {_contains('n', _S.costume_terms)}) AS valid FROM a3),
a5 AS (SELECT *, CASE WHEN grown THEN {_LESS} ELSE 5 * len(hard) + {_WEIGHTS} + pending END + 2 * len(school) + 6 * inj + CASE WHEN minor THEN 7 ELSE 0 END + 4 * len(crossed) + cluster - CASE WHEN valid THEN 5 ELSE 0 END AS s FROM a4)
SELECT cid, CAST(greatest(0, CASE WHEN allowlisted THEN greatest(0, s - 2) ELSE s END) AS INT) AS score, CAST(cluster AS INT) AS cluster, CAST(len(hard) AS INT) AS hard, CAST(valid AS INT) AS valid FROM a5"""

_C = Q.NAMES
_LEXICON = [t for t in _C.lexicon if t not in _C.adult_assertions]
_SECOND = rf"""WITH w AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS w FROM part), t AS (SELECT unnest({_list(_LEXICON)}) AS t),
ws AS ({_simhash('w', 'w', 'w')}), ts AS ({_simhash('t', 't', 't')}),
p AS (SELECT w, t, bit_count(xor(('0x' || ws.sim)::UBIGINT, ('0x' || ts.sim)::UBIGINT)) AS d, {_gram_set('w')} AS a, {_gram_set('t')} AS b, {_soundex('w')} AS cw, {_soundex('t')} AS ct FROM ws, ts),
k AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM p),
m AS (SELECT w, t, d, i / CAST(u AS DOUBLE) AS s, CASE WHEN d <= 5 THEN 'simhash' WHEN 100 * i >= 80 * u THEN 'jaccard' WHEN abs(length(t) - length(w)) <= 2 AND length(w) >= 5 AND cw = ct THEN 'soundex' END AS kind FROM k),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY t) AS r FROM m WHERE kind IS NOT NULL) WHERE r = 1)
SELECT p_partkey, CASE WHEN f.t IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS action, f.t AS term, kind AS match_type, CASE WHEN kind = 'simhash' THEN CAST(d AS INT) END AS dist, CASE WHEN kind = 'jaccard' THEN round(s, 6) END AS sim
FROM part LEFT JOIN f ON replace(lower(p_name), ' ', '') = f.w"""

_CONV = _decisions("(SELECT conv_id * 1000 + turn AS cid, text FROM conversations)", "cid", "text")
_REFRESH = _FEED + f""", pending(category, term, added, sources, weight) AS (VALUES {', '.join(f"({_quote(c)}, {_quote(t)}, {_quote(a)}, {s}, {w})" for c, t, a, s, w in Q.PENDING)}),
kept AS (SELECT * FROM pending WHERE try_cast(added AS TIMESTAMP) IS NULL OR try_cast(added AS TIMESTAMP) >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOUR),
fresh AS (SELECT CASE WHEN contains(term, 'that') THEN 'hard_terms' ELSE 'ambiguous_terms' END AS category, term, '{Q.NOW.isoformat()}' AS added, count(DISTINCT feed) AS sources, 2 AS weight
  FROM counts WHERE term NOT IN ({', '.join(map(_quote, Q.KNOWN))}) AND term NOT IN (SELECT term FROM kept) GROUP BY term HAVING count(DISTINCT feed) >= 2),
after AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
"""
_TERMS_BY_TURN = f"array_to_string(CASE WHEN turn < 2 THEN {_terms('text', ('the', 'les'))} ELSE {_terms('text', ('the', 'les', 'und', 'des'))} END, ',')"
#: cos of the transform's first eight rows, scaled; then rows, columns, and the comparison with the median.
_IMAGES = r"""WITH px AS (SELECT vec_id, y, x, greatest(0, least(255, floor(CAST(embedding[((y * 5 + x * 3) % 64) + 1] AS DOUBLE) * 200 + 128))) AS v
  FROM embeddings, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x)),
zero AS (SELECT vec_id, v AS v0 FROM px WHERE y = 0 AND x = 0),
basis AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 64.0) * 0.25 / CASE WHEN k = 0 THEN sqrt(2.0) ELSE 1 END AS c FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(32)) AS i)),
across AS (SELECT vec_id, y, k AS h, sum((v - v0) * c) AS s FROM px JOIN zero USING (vec_id) JOIN basis ON x = i GROUP BY ALL),
down AS (SELECT vec_id, k * 8 + h AS pos, CAST(sum(s * c) AS FLOAT) AS f FROM across JOIN basis ON y = i GROUP BY vec_id, k, h),
low AS (SELECT *, median(f) OVER (PARTITION BY vec_id) AS m FROM down WHERE pos > 0)
SELECT vec_id, printf('%016x', CAST(sum(CASE WHEN f > m THEN (1::HUGEINT << CAST(63 - pos AS INT)) ELSE 0 END) AS UBIGINT)) AS phash FROM low GROUP BY vec_id"""

BRANCH_ORACLES: dict[str, str] = {
    "context_scores": _SCORES,
    "school_contexts": f"""WITH t AS (SELECT p_partkey, {_list(Q.GRADES)}[1 + p_partkey % 12] || ' grade' AS g, {_list(Q.PLACES)}[1 + p_partkey % 5] AS p FROM part)
        SELECT p_partkey, array_to_string(list_sort(CASE WHEN p = 'library' THEN [g] ELSE [g, p] END), ',') AS school FROM t""",
    "spelled_ages": "SELECT p_partkey, CAST(1 + p_partkey % 99 AS VARCHAR) AS ages FROM part",
    "wide_letters": _normal("(SELECT p_partkey, lower(p_name) AS s FROM part)", "p_partkey", "s") + " SELECT p_partkey, n FROM normal",
    "second_pass_parts": _SECOND,
    "classified_conversations": f"""WITH t AS (SELECT cid, least(4000, 4 * (length(text) + 1)) AS n FROM {_TURNS})
        SELECT cid, CASE WHEN n % 5 = 0 THEN 'none' WHEN n % 3 = 0 THEN 'NSFW' WHEN n % 3 = 1 THEN 'LABEL_1' ELSE 'SAFE' END AS label,
               CAST(CASE WHEN n % 5 = 0 THEN cid % 2 = 0 ELSE n % 3 < 2 AND n % 10 > 7 END AS INT) AS flagged FROM t""",
    "verbose_conversations": _normal(_TURNS, "cid", "text") + f" SELECT cid, sha256(n) AS normal_sha, sha256({_squash('n')}) AS squashed_sha FROM normal",
    "decision_json": _CONV + " SELECT cid, action, reason, sha256(n) AS normal_sha, 1 AS null_kept, 'none' AS model FROM final",
    "audit_decisions": _CONV + " SELECT CAST(cid AS VARCHAR) AS request_id, action, reason, sha256(c.text) AS prompt_sha256 FROM final JOIN conversations c ON cid = c.conv_id * 1000 + c.turn",
    "text_request_files": f"SELECT CAST(cid AS VARCHAR) AS id, sha256(CASE WHEN turn < 6 THEN text ELSE '?' END) AS prompt_sha, CAST(turn % 2 = 0 AS INT) AS rewrite, 0 AS verbose FROM {_TURNS}",
    "known_hash_files": "SELECT printf('%016x', p_partkey) AS known FROM part UNION ALL SELECT 'default 00000000000000ff'",
    "feed_files": rf"SELECT CAST(cid AS VARCHAR) AS title, role AS description, sha256(regexp_replace(text, '\s+', ' ', 'g')) AS content_sha, 1 AS named FROM {_TURNS}",
    "metric_files": "SELECT role AS endpoint, count(*) AS n FROM conversations GROUP BY role",
    "refreshed_terms": _REFRESH + " SELECT * FROM after",
    "term_churn": _REFRESH + """ SELECT 'held' AS action, category, count(*) AS n FROM after GROUP BY category
        UNION ALL SELECT 'added', category, count(*) FROM (SELECT category, term FROM after EXCEPT SELECT category, term FROM pending) GROUP BY category
        UNION ALL SELECT 'expired', category, count(*) FROM (SELECT category, term FROM pending EXCEPT SELECT category, term FROM after) GROUP BY category""",
    "reloaded_terms": f"SELECT cid, {_TERMS_BY_TURN} AS hits FROM {_TURNS}",
    "image_hashes": _IMAGES,
    "service_constants": f"SELECT 'healthy' AS status, {_quote(VERSION)} AS version, 'Config missing keys: [''ambiguous_youth'', ''adult_assertions'', ''fuzzy_threshold'', ''context_threshold'', ''professional_terms'', ''sexual_terms'', ''costume_terms'', ''known_csam_phashes'', ''phash_match_thresh'', ''pending_ttl_hours'', ''pending_confirmation_threshold'']' AS refused",
    "mapped_config": f"SELECT cid, array_to_string({_terms('text', ('the', 'les', 'und', 'des'))}, ',') AS hits, 9 + 3 + 3 + 90 + 5 + 7 AS numbers FROM {_TURNS}",
}
