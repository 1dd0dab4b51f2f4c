"""SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from callquality.llm.chat import CONTROLS, MARKS
from callquality.llm.quality import BASE_RULES, METHOD_RULES, Rule
from callquality.llm.stats import SYMBOLS, stop_word_list

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
  g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""

_PATTERN = "|".join("".join("\\" + c if c in "[]/<>" else c for c in control) for control in sorted(CONTROLS, key=len, reverse=True))
# Escaping puts one more character into each control string; only lengths matter here.
_CONTROL_COUNT = rf"len(regexp_extract_all(replace(coalesce(text, ''), '\', '\\'), '{_PATTERN}'))"
_MARK_CHARS = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items()) + f" ELSE {len('[ROLE][/ROLE]</s>')} + length(role) END"

OP2 = rf"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(replace(coalesce(text, ''), '\', '\\')) + {_CONTROL_COUNT} + {_MARK_CHARS} AS shown FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def _fails(rule: Rule) -> str:
    bottom = f"greatest({rule.bottom}, 1)" if rule.bottom else "1"
    tests = ([f"{rule.top} < {bottom} * {rule.low}::DOUBLE"] if rule.low is not None else []) + ([f"{rule.top} > {bottom} * {rule.high}::DOUBLE"] if rule.high is not None else [])
    return "(" + " OR ".join(tests) + ")"


_STOPS = ", ".join(f"'{w}'" for w in stop_word_list())
OP6 = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
  p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3), g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM p),
  h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g), r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM h, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
  s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: list_contains([{_STOPS}], lower(regexp_replace(x, '[^0-9A-Za-z_]+$', ''))))) AS n_stop_words FROM w LEFT JOIN r USING (doc_id)),
  v AS (SELECT *, {" OR ".join(map(_fails, BASE_RULES))} AS base_failed, {" OR ".join(map(_fails, METHOD_RULES))} AS failed FROM s)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR failed) AS kept FROM v"""

OP8 = rf"""WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight FROM s), f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_level FROM w),
  l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f WINDOW o AS (ORDER BY full_level, source IS NULL, encode(source))),
  t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT min_by(level, full_level) FROM l WHERE level <= full_level) * weight, 'inf'::DOUBLE)) AS target FROM l),
  j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j"""

OP9 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
  p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM h WHERE n >= 50)),
  m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM p) WHERE low < doc_id),
  b AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM m),
  g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b), r AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY ALL),
  k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
  c AS (SELECT h.doc_id, h.n, h.x, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS rest FROM k JOIN h USING (doc_id) GROUP BY ALL)
  SELECT h.doc_id, h.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h.x))) AS kept_sha256 FROM h LEFT JOIN c ON h.doc_id = c.doc_id"""

OP10 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
  r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.a, r.low FROM r JOIN e ON e.b = r.doc_id)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(low) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

# CRC-32 of a list of bytes, by the table that the polynomial gives.
CRC_TABLE = """steps(i, k, v) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
  crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""


def crc_sql(codes: str) -> str:
    return f"xor(4294967295::BIGINT, list_reduce({codes}, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{0}", "text"))
OP11 = f"""WITH RECURSIVE {CRC_TABLE},
  d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_LEAF.format("n_chars")}) AS leaf,
    CASE WHEN {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF.format("(n_chars + 1)")}) END AS changed FROM documents, crc),
  l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
  e AS (SELECT g, 0 AS lev, i, leaf AS h, n FROM l UNION ALL SELECT g, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM e WHERE n > 1 GROUP BY g, lev, i // 2, n),
  s AS (SELECT g, h AS subroot, lev AS height, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM e WHERE n = 1),
  f AS (SELECT 0 AS lev, i, subroot AS h, n FROM s UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM f WHERE n > 1 GROUP BY lev, i // 2, n),
  a AS (SELECT g, lev, i, h FROM e WHERE n > 1 UNION ALL SELECT s.g, s.height + f.lev, f.i, f.h FROM f, s WHERE f.n > 1),
  w AS (SELECT l.g, l.i AS leaf_at, lev, CASE WHEN lev < height THEN l.i >> lev ELSE s.i >> (lev - height)::BIGINT END AS spot FROM l JOIN s USING (g), range(0, 200) r(lev) WHERE lev < height + ceil(log2(s.n))),
  p AS (SELECT w.g, leaf_at, w.lev, a.h, spot & 1 AS odd FROM w LEFT JOIN a ON a.g = w.g AND a.lev = w.lev AND a.i = xor(spot, 1)),
  q AS (SELECT g, leaf_at, sha256(coalesce(string_agg(h, '' ORDER BY lev), '')) AS proof_sha256, list({{'h': coalesce(h, ''), 'odd': odd}} ORDER BY lev) AS path FROM p GROUP BY ALL),
  z AS (SELECT doc_id, leaf, subroot, (SELECT h FROM f WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(changed, leaf) AS h, coalesce(path, []) AS path, 1 AS k FROM l JOIN s USING (g) LEFT JOIN q ON q.g = l.g AND q.leaf_at = l.i
    UNION ALL SELECT doc_id, leaf, subroot, root, proof_sha256, CASE WHEN path[k].odd = 1 THEN sha256(path[k].h || h) ELSE sha256(h || path[k].h) END, path, k + 1 FROM z WHERE k <= len(path))
  SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM z WHERE k = len(path) + 1"""

OP13 = f"""WITH RECURSIVE {CRC_TABLE},
  r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
  u AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
  h AS (SELECT *, {crc_sql("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))")} AS h FROM u, crc),
  w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
  v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
  k AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS open, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
  p AS (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b USING (open) WHERE a.word <> b.word UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = cut UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = cut),
  b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word), c AS (SELECT p.word, min(near) AS near, any_value(top) AS top, any_value(n_near) AS n_near FROM p JOIN b USING (word) WHERE p.n = top GROUP BY p.word),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * v.n THEN near END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN c USING (word)),
  z AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.ahead)
  SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word AND z.ahead IS NULL"""

ORACLES = {"op1_warc": OP1, "op2_chat_format": OP2, "op6_quality_rules": OP6, "op8_mix": OP8, "op9_suffix_dedup": OP9, "op10_jaccard_join": OP10, "op11_manifest": OP11, "op13_variants": OP13}
