"""DuckDB SQL of the queries that SQL can express."""

#: The word pattern, in DuckDB's regular expressions.
_W = r"'[^\x20\x09-\x0D]+'"


def _uniform(x: str) -> str:
    m = 2147483647
    x = f"((coalesce({x}, -1) % {m} + {m}) % {m} + CAST('0x' || substr(md5(coalesce(text, '')), 1, 12) AS BIGINT)) % {m}"
    steps, last = [], "x0"
    for i, k in enumerate((48271, 69621, 16807)):
        steps.append(f"u{i} AS (SELECT *, ((({last} * {k} + 11) % {m}) * (({last} * {k} + 11) % {m}) + 12345) % {m} AS x{i + 1} FROM {'d' if not i else f'u{i - 1}'})")
        last = f"x{i + 1}"
    return x, ",\n".join(steps), f"(({last} + 1) / {m + 1}.0)"


def _near(x: str, usual: float, slope: float) -> str:
    one = "CAST(1 AS DOUBLE)"
    return f"({one} / ({one} + abs({x} - CAST({usual} AS DOUBLE)) * CAST({slope} AS DOUBLE)))"


_X, _STEPS, _U = _uniform("doc_id")

SOURCE_MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_W})) AS size, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>{{}}=@_/]')) AS DOUBLE) AS odd, CAST(len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS DOUBLE) AS marks, CAST({_X} AS BIGINT) AS x0 FROM documents),
{_STEPS},
k AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size, -ln(CAST({_U} AS DOUBLE)) / (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * ({_near('chars / CAST(greatest(size, 1) AS DOUBLE)', 6.0, 0.125)} * {_near('odd / greatest(chars, CAST(1 AS DOUBLE))', 0.0, 16.0)} * {_near('marks / CAST(greatest(size, 1) AS DOUBLE)', 0.08, 4.0)})) AS key FROM u2),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level < ratio THEN weight * (SELECT level FROM l WHERE level < ratio ORDER BY ratio, source LIMIT 1) ELSE CAST(cap AS DOUBLE) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
      sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * least(epochs + CASE WHEN upto - size / 2.0 <= budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM q"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n_shingles + y.n_shingles - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT n.doc_id, n.n_shingles, min(reach.other) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY 1, 2"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_W}) GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY doc_id),
f AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower FROM d LEFT JOIN l ON l.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR n_upper > n_lower OR word_chars > 15 * n_words AS soft_failed FROM f),
o AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft_failed) AS DOUBLE) AS failed FROM b GROUP BY source),
m AS (SELECT (sum(failed) + 0.5) / (sum(n) + 1.0) AS mean, sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) * (sum(failed) / sum(n)) AS variance, (count(*) - 1) / sum(n) AS noise, sum(n * n) / sum(n) / sum(n) AS own FROM o),
e AS (SELECT mean, variance - noise * mean * (1 - mean) AS between_hosts, mean * (1 - mean) * (1 - own - noise) AS most FROM m),
v AS (SELECT mean, CASE WHEN between_hosts > 0 AND most > 0 THEN greatest(most / between_hosts - 1, 0.0) END AS strength FROM e),
rate AS (SELECT source, greatest(CASE WHEN strength IS NULL THEN mean ELSE (failed + mean * strength) / (n + strength) END, 0.5 / (n + 1)) AS host_rate, mean, coalesce(sqrt(mean * (1 - mean) / (strength + 1)), 0) AS deviation FROM o, v),
scaled AS (SELECT *, mean / host_rate AS scale, host_rate >= 0.5 AND host_rate > mean + 2 * deviation AS host_bad FROM rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR host_bad OR 10 * n_symbols > n_words * scale OR 10 * n_dup_lines > 3 * n_lines * scale OR n_upper > n_lower * scale OR word_chars > 15 * (n_words * scale)) AS kept
FROM b JOIN scaled ON b.source IS NOT DISTINCT FROM scaled.source"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
#: CRC-32 (reflected polynomial 0xEDB88320) of the id's decimal text, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS leaf,
       CASE WHEN {_CRC} % 2 = 0 THEN sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_LEAF} || {_field("text")}) END AS checked FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(source, level, i, h) AS (SELECT source, 0, i, leaf FROM o UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY source, level, i // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM (SELECT * FROM t QUALIFY level = max(level) OVER (PARTITION BY source))),
u(level, i, h) AS (SELECT 0, i, h FROM s UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY level, i // 3),
depth AS (SELECT source, max(level) AS top FROM t GROUP BY source),
steps AS (SELECT o.doc_id, o.leaf, o.checked, s.h AS subroot, depth.top + (SELECT max(level) FROM u) AS steps, o.source, o.i, depth.top, s.i AS root_place FROM o JOIN depth ON o.source IS NOT DISTINCT FROM depth.source JOIN s ON o.source IS NOT DISTINCT FROM s.source),
nodes AS (SELECT source, false AS over, level, i, h FROM t UNION ALL SELECT NULL, true, level, i, h FROM u),
walk(doc_id, leaf, source, step, place, top, root_place, steps, proof, h) AS (SELECT doc_id, leaf, source, 0, i, top, root_place, steps, '', checked FROM steps UNION ALL
  SELECT w.doc_id, w.leaf, w.source, w.step + 1, w.p // 3, w.top, w.root_place, w.steps, w.proof || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> w.p), ''), sha256(string_agg(CASE WHEN n.i = w.p THEN w.h ELSE n.h END, '' ORDER BY n.i))
  FROM (SELECT *, CASE WHEN step = top THEN root_place ELSE place END AS p FROM walk WHERE step < steps) w
  JOIN nodes n ON n.over = (w.step >= w.top) AND n.level = w.step - CASE WHEN w.step >= w.top THEN w.top ELSE 0 END AND n.i // 3 = w.p // 3 AND (n.over OR n.source IS NOT DISTINCT FROM w.source)
  GROUP BY w.doc_id, w.leaf, w.source, w.step, w.p, w.top, w.root_place, w.steps, w.proof, w.h)
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM walk w JOIN s ON s.source IS NOT DISTINCT FROM w.source, (SELECT h FROM u ORDER BY level DESC LIMIT 1) r WHERE w.step = w.steps"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""

#: Header and footer lengths of the template, and its control strings with any backslashes behind their first character.
_AROUND = "CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 18 WHEN 'assistant' THEN 10 ELSE 23 + length(role) + len(regexp_extract_all(role, {0})) END"
_CONTROL = r"'<\\*(/?s>)|\[\\*(/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|TEXT\])'"

CHAT_FORMAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_AROUND.format(_CONTROL)} + length(text) + len(regexp_extract_all(text, {_CONTROL}))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
