"""DuckDB SQL for the training-data queries that SQL can express."""

from docsense.llm import chat, decontaminate, licenses, mixing, phrases, topk, warc

_DOCS = r"""docs AS (
  SELECT doc_id, coalesce(source, '') AS source,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens
  FROM documents)"""

_KEY = "('0x' || substr(md5(concat_ws(':', {parts})), 1, 15))::BIGINT"

SOURCE_MIXING = f"""
WITH RECURSIVE {_DOCS},
totals AS (SELECT source, sum(tokens)::BIGINT AS total FROM docs GROUP BY source),
shares AS (SELECT source, total, total::DOUBLE / (SELECT sum(total)::DOUBLE FROM totals) AS p FROM totals),
ends AS (SELECT max(1 / p) / min(1 / p) AS at_zero FROM shares),
bisect(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT b.i + 1,
         CASE WHEN max(pow(p, (low + high) / 2) / p) / min(pow(p, (low + high) / 2) / p) <= {mixing.REPETITIONS} THEN any_value(low) ELSE any_value((low + high) / 2) END,
         CASE WHEN max(pow(p, (low + high) / 2) / p) / min(pow(p, (low + high) / 2) / p) <= {mixing.REPETITIONS} THEN any_value((low + high) / 2) ELSE any_value(high) END
  FROM bisect b CROSS JOIN shares WHERE b.i < {mixing.STEPS} GROUP BY b.i),
exponent AS (SELECT round(CASE WHEN (SELECT at_zero FROM ends) <= {mixing.REPETITIONS} THEN 0.0 ELSE (SELECT high FROM bisect WHERE i = {mixing.STEPS}) END, 9) AS a),
powers AS (SELECT source, total, pow(total::DOUBLE, a) AS up, pow(total::DOUBLE, a - 1) AS rel FROM totals, exponent),
plan AS (
  SELECT source, total, floor(rel / (SELECT min(rel) FROM powers) * total::DOUBLE)::BIGINT AS budget,
         greatest(1, round({float(mixing.BLOCK_TOKENS)}::DOUBLE * (up / (SELECT sum(up) FROM powers))))::BIGINT AS quota
  FROM powers),
uses AS (
  SELECT doc_id, d.source, tokens, p AS pass, total, budget, quota,
         {_KEY.format(parts=f"'{mixing.SEED}', p::VARCHAR, coalesce(doc_id::VARCHAR, '')")} AS key
  FROM docs d JOIN plan USING (source), unnest(range(0, budget // total + 1)) AS t(p)
  WHERE p < budget // total OR budget % total > 0),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY key RANGE UNBOUNDED PRECEDING)
            - sum(tokens) OVER (PARTITION BY source, pass, key) AS cut
  FROM uses),
kept AS (
  SELECT doc_id, source, tokens, pass, ((pass * total + cut) // quota)::BIGINT AS block
  FROM placed WHERE pass < budget // total OR cut < budget % total)
SELECT doc_id, source, tokens, pass, block,
       row_number() OVER (PARTITION BY block ORDER BY {_KEY.format(parts=f"'{mixing.SEED}', 'block', block::VARCHAR, pass::VARCHAR, coalesce(doc_id::VARCHAR, '')")},
                          doc_id, pass, source, tokens) AS position
FROM kept
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + {decontaminate.SHINGLE - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {decontaminate.SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
bs AS (SELECT DISTINCT r, item_id, array_to_string(w[i:i + {decontaminate.SHINGLE - 1}], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - {decontaminate.SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*)::BIGINT AS item_shingles FROM bs GROUP BY r)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, item_shingles, count(*)::DOUBLE / item_shingles::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.r = bs.r
GROUP BY ds.r, doc_id, bs.r, item_id, item_shingles
HAVING count(*) >= {decontaminate.CONTAINMENT} * item_shingles
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines(text: str) -> str:
    bare = f"regexp_replace(lower(coalesce({text}, '')), {_quoted('(?m)' + licenses.COPYRIGHT_LINE)}, '', 'g')"
    spaced = f"'  ' || replace(regexp_replace({bare}, {_quoted(licenses.PUNCTUATION)}, '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for other, usual in licenses.SPELLINGS.items():
        spaced = f"replace({spaced}, '  {other}  ', '  {usual}  ')"
    return f"list_filter(list_transform(string_split({spaced}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


LICENSES = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.known_texts())}),
registry AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256(array_to_string({_canonical_lines("text")}, '  ')) AS digest FROM known) GROUP BY digest),
lines AS (SELECT doc_id, {_canonical_lines("text")} AS l FROM documents),
digests AS (SELECT doc_id, list_prepend(sha256(array_to_string(l, '  ')), list_transform(l, lambda x: sha256(x))) AS d FROM lines),
units AS (SELECT doc_id, i AS pos, d[i + 1] AS digest FROM digests, unnest(range(0, len(d))) AS t(i))
SELECT doc_id, CASE WHEN pos = 0 THEN 'document' ELSE 'line' END AS unit, (pos - 1)::BIGINT AS line, license_id, digest
FROM units JOIN registry USING (digest)
"""


def _escaped(text: str) -> str:
    for plain, entity in chat.ENTITIES:
        text = f"replace({text}, '{plain}', '{entity}')"
    return text


CHAT_FORMAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

TOPK = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::HUGEINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, greatest(len(q.w), len(c.w)) + 1), lambda i: coalesce(q.w[i], 0) * coalesce(c.w[i], 0)))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {topk.K}
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p WHERE strlen(h) >= {warc.LEAST} GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (h)
"""

# CRC-32 by single bits: an item below 256 is a byte of the text, 256 a shift.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))), lambda a, o: CASE WHEN o < 256 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"

TRIE = rf"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
dug AS (SELECT c, turn, md5(length(role)::VARCHAR || ':' || role || text) AS dig, len(regexp_extract_all(text, '[^ 	-
]+'))::BIGINT AS w FROM said),
t AS (SELECT c, dig, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS pos FROM dug),
ids AS (SELECT c, c - c % 20 AS lender, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
own AS (SELECT c, pos, dig, w FROM t JOIN ids USING (c) WHERE pos > h
        UNION ALL SELECT ids.c, pos, dig, w FROM ids JOIN t ON t.c = ids.lender AND pos <= h),
told AS (SELECT ids.c, coalesce(string_agg(dig, '' ORDER BY pos), '') AS path, coalesce(list(w ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ws FROM ids LEFT JOIN own ON own.c = ids.c GROUP BY ids.c),
n AS (SELECT substr(path, 1, 32 * d) AS p, d, min(c) AS conv_id, count(*)::BIGINT AS n_convs, coalesce(any_value(ws[d]), 0) AS w,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length(path) = 32 * d), '')) AS ends
      FROM told, unnest(range(0, length(path) // 32 + 1)) AS r(d) GROUP BY 1, 2),
kids AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, d - 1 AS d, count(*)::BIGINT AS k FROM n WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT substr(n.p, 1, 32 * u) AS p, u AS d, sum((n_convs - 1) * w)::BIGINT AS saved, count(*) FILTER (k IS NULL)::BIGINT AS leaves
          FROM n LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d, unnest(range(0, n.d + 1)) AS r(u) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN below ON below.p = n.p AND below.d = n.d LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d
LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.p = substr(n.p, 1, 32 * (n.d - 1))
"""

COLLOCATIONS = rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.SUPPORT}),
cut AS (
  SELECT lang, k, phrase, a, 1 AS x, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT cut.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
around AS (SELECT lang, p, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS p FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN around ON around.lang = low.lang AND around.p = low.phrase WHERE most IS NULL OR 100 * most < {phrases.COVERED} * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= {phrases.TOP}
"""

SQL = {
    "op1_source_mixing": SOURCE_MIXING,
    "op3_licenses": LICENSES,
    "op5_chat_format": CHAT_FORMAT,
    "op6_topk": TOPK,
    "op7_decontamination": DECONTAMINATION,
    "op11_collocations": COLLOCATIONS,
    "op12_warc": WARC,
    "op13_trie": TRIE,
}
