"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import chat, imatch, secrets
from .common import WORD


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, {_sql_text(control)}, {_sql_text(control[0] + chr(92) + control[1:])})"
    return out


_OVERHEAD = len(chat.ROLE) + len(chat.TEXT) + len(chat.END)

OP5 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                            text NULLS FIRST) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', {_sql_text(chat.PROBE)}
        UNION ALL SELECT -7, 1, 'assistant', {_sql_text(chat.PROBE)}))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('said')}) + {_OVERHEAD}) AS BIGINT)
    AS formatted_chars
FROM rows GROUP BY conv_id"""

# The targets are worked out by resharing, round after round, not by the sorted level.
OP6 = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
sources AS (
  SELECT key, source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS w,
         (row_number() OVER (ORDER BY key) - 1) % 3 AS klass
  FROM (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key)),
rounds AS (
  SELECT 0 AS step, key, w, klass, source_size, false AS full_up FROM sources
  UNION ALL
  SELECT step + 1, key, w, klass, source_size, full_up OR 2.0 * source_size <=
      w * (1.5 * sum(source_size) OVER () - sum(CASE WHEN full_up THEN 2.0 * source_size ELSE 0 END) OVER ())
        / nullif(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER (), 0)
  FROM rounds WHERE step < 40),
targets AS (
  SELECT key, klass, source_size, CASE WHEN full_up THEN 2.0 * source_size ELSE
      w * (1.5 * sum(source_size) OVER () - sum(CASE WHEN full_up THEN 2.0 * source_size ELSE 0 END) OVER ())
        / nullif(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER (), 0) END AS target
  FROM rounds WHERE step = 40),
placed AS (
  SELECT sized.*, source_size, target, klass, size / 2 + coalesce(sum(size) OVER (
      PARTITION BY sized.key ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mid
  FROM sized JOIN targets USING (key)),
timed AS (
  SELECT *, CASE WHEN mid > target THEN NULL WHEN target > 0 THEN mid / target ELSE 0.0 END AS part
  FROM placed)
SELECT doc_id, size, source_size, CAST(round(target, 6) AS DOUBLE) AS target,
  CAST(size * ((mid <= target)::INT + (mid + source_size <= target)::INT) AS BIGINT) AS taken,
  round(CASE klass WHEN 0 THEN 1.5 - sqrt(2.25 - 2 * part) WHEN 1 THEN part
             ELSE sqrt(0.25 + 2 * part) - 0.5 END, 9) AS first_position
FROM timed"""


# Exact links by joining the shingle sets, components by spreading the smallest id.
OP1 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM worded),
shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


OP8 = """
WITH valid AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS BIGINT[]) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM valid a JOIN valid b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

OP9 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)"""


def _spans(kind: str, regex: str, group: int, least: int, order: int) -> str:
    """Matches and the texts between them, in DuckDB: start of a match = lengths of both so far."""
    return f"""
  SELECT id, '{kind}' AS kind, {order} AS ord, start, start + length(hit) AS stop FROM (
    SELECT id, hit, value, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (
        PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT id, unnest(regexp_extract_all(text, {_sql_text(regex)})) AS hit,
                 unnest(regexp_extract_all(text, {_sql_text(regex)}, {group})) AS value,
                 unnest(string_split_regex(text, {_sql_text(regex)})[1:-2]) AS gap,
                 generate_subscripts(regexp_extract_all(text, {_sql_text(regex)}), 1) AS n
          FROM docs WHERE regexp_matches(text, {_sql_text(regex)}))
    WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)) WHERE length(value) >= {least}"""


OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_spans(r.kind, r.regex, r.group, r.least, n) for n, r in enumerate(secrets.RULES))}),
marked AS (
  SELECT *, kind || ':' || start || ':' || stop AS span FROM found)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(secrets.BASE_RULES)}), ''))
    AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans
FROM docs LEFT JOIN marked USING (id) GROUP BY id, doc_id"""


# The checksum of a list of bytes, given the table of the checksums of single ones.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def _crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {code}), "
            "lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))")


# Repair by the states of the grammar instead of by lengths: from the last row to the first, the
# cheapest rest from each state (0: nothing yet, 1: assistant due, 2: user due after system,
# 3: user due). The edits at hand differ in their letter, so the least string is the least pair.
def _emit(role: str, to: str) -> str:
    return f"CASE WHEN NOT gone THEN {{'c': extra + (CASE initial WHEN '{role}' THEN 0 ELSE 3 END) + {to}.c, 'a': (CASE initial WHEN '{role}' THEN 'K' ELSE 'R' END) || {to}.a}} END"


def _edit(cost: int, letters: str, to: str) -> str:
    return f"{{'c': {cost} + {to}.c, 'a': '{letters}' || {to}.a}}"


OP11 = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
hits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) FROM hits WHERE hit > 0)),
placed AS (
  SELECT *, coalesce('=' || conv_id, '') AS conv, substr(role, 1, 1) AS initial, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
faults AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY place) || initial AS step,
    CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM faults),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv),
walk AS (
  SELECT conv, max(place) + 1 AS place, {{'c': 0::BIGINT, 'a': ''}} AS w0, {{'c': 3::BIGINT, 'a': 'I'}} AS w1,
    {{'c': 6::BIGINT, 'a': 'II'}} AS w2, {{'c': 0::BIGINT, 'a': ''}} AS w3 FROM rows GROUP BY conv
  UNION ALL
  SELECT conv, place, list_min([v0, {_edit(3, 'I', 'v1')}]), list_min([v1, {_edit(3, 'I', 'v3')}]),
    list_min([v2, {_edit(3, 'I', 'v1')}, {_edit(6, 'II', 'v3')}]), list_min([v3, {_edit(3, 'I', 'v1')}])
  FROM (
    SELECT rows.conv, rows.place,
      list_min([{_edit(4, 'D', 'w0')}, {_emit('u', 'w1')},
        CASE WHEN initial = 's' AND NOT gone THEN {{'c': extra + w2.c, 'a': 'K' || w2.a}} END]) AS v0,
      list_min([{_edit(4, 'D', 'w1')}, {_emit('a', 'w3')}]) AS v1,
      list_min([{_edit(4, 'D', 'w2')}, {_emit('u', 'w1')}]) AS v2,
      list_min([{_edit(4, 'D', 'w3')}, {_emit('u', 'w1')}]) AS v3
    FROM walk JOIN rows ON rows.conv = walk.conv AND rows.place = walk.place - 1)),
audits AS (SELECT conv, w0.c AS cost, w0.a AS audit FROM walk WHERE place = 1),
letters AS (
  SELECT conv, n, audit[n] AS edit, n - length(replace(audit[1:n], 'I', '')) AS inserted,
    length(replace(audit[1:n], 'D', '')) - 1 - length(replace(audit, 'D', '')) % 2 AS spot
  FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS n FROM audits)),
lines AS (
  SELECT letters.conv, n, CASE WHEN edit = 'K' THEN role WHEN spot % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM letters LEFT JOIN rows ON rows.conv = letters.conv AND rows.place = n - inserted AND edit <> 'I'
  WHERE edit <> 'D'),
repaired AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY n)) AS sha FROM lines GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM conversations)
LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired USING (conv)"""


# Digits, letters and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _terms(column: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            f"'abcdefghijklmnopqrstuvwxyz'), '{TERM}')")


OP12 = f"""
WITH crc AS ({CRC_TABLE}),
docs AS (SELECT row_number() OVER () AS id, doc_id, {_terms('text')} AS terms FROM documents),
used AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT term, count(*) AS n FROM (SELECT unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
hashed AS (SELECT term, {_crc32("term")} % 10000 AS bucket
  FROM (SELECT DISTINCT term FROM used UNION SELECT term FROM wanted), crc),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM used JOIN hashed USING (term) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM wanted JOIN hashed USING (term) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000)
    / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT id, sum(n * gain) AS total FROM used JOIN hashed USING (term) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT id, doc_id, CAST(len(terms) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % len(terms)) + len(terms)) % len(terms)) // len(terms), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (id)),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS rank,
    count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (id)"""


OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER w AS id, doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS following
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, '')))),
twice AS (
  SELECT id, 0 AS kind, text FROM docs UNION ALL
  SELECT id, 1, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) FROM docs),
found AS (SELECT id, kind, unnest(list_distinct({_terms('text')})) AS term FROM twice),
lexicon AS (SELECT term FROM found WHERE kind = 0 GROUP BY term
  HAVING 1000 * count(*) >= {imatch.LEAST} * (SELECT count(*) FROM docs) AND 1000 * count(*) <= {imatch.MOST} * (SELECT count(*) FROM docs)),
known AS (SELECT * FROM found SEMI JOIN lexicon USING (term)),
used AS (
  SELECT id, kind, term FROM known UNION ALL
  SELECT id, kind, term FROM found ANTI JOIN known USING (id, kind) UNION ALL
  SELECT id, kind, text FROM twice ANTI JOIN found USING (id, kind)),
levels AS (
  SELECT term, family, 16 - CASE piece WHEN 0 THEN 0 ELSE length(bin(piece)) END AS level
  FROM (SELECT term, family, ('0x' || sha256((family // 16) || ':' || term)[1 + 4 * (family % 16):4 + 4 * (family % 16)])::INT AS piece
        FROM (SELECT DISTINCT term FROM used), (SELECT unnest(range({imatch.FAMILIES})) AS family))),
subsets AS (
  SELECT id, kind, family, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {imatch.HEX}) AS hash
  FROM (SELECT id, kind, family, term, level, max(level) OVER (PARTITION BY id, kind, family) AS most
        FROM used JOIN levels USING (term)) WHERE level = most GROUP BY ALL),
whole AS (SELECT id, kind, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 16) AS hash FROM used GROUP BY ALL),
prints AS (
  SELECT id, kind, any_value(whole.hash) || ':' || string_agg(subsets.hash, '' ORDER BY family) AS print,
    list(subsets.hash ORDER BY family) AS parts
  FROM subsets JOIN whole USING (id, kind) GROUP BY id, kind),
near AS (
  SELECT a.id, a.kind, b.kind AS other, b.id AS other_id,
    len(list_filter(list_zip(a.parts, b.parts), lambda x: x[1] = x[2])) / {imatch.FAMILIES}.0::DOUBLE AS near
  FROM prints a JOIN prints b ON b.kind = 1 AND b.id = a.id
    OR b.kind = 0 AND b.id = a.id % (SELECT count(*) FROM docs) + 1 WHERE a.kind = 0)
SELECT doc_id, length(docs.text) AS n_chars, sha256(e.text) AS edited_sha256, p.print AS fingerprint,
  q.print AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM docs JOIN twice e ON e.id = docs.id AND e.kind = 1
JOIN prints p ON p.id = docs.id AND p.kind = 0 JOIN prints q ON q.id = docs.id AND q.kind = 1
JOIN near x ON x.id = docs.id AND x.other = 1 JOIN near y ON y.id = docs.id AND y.other = 0"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op4_secrets": OP4, "op5_chat": OP5, "op6_mix": OP6, "op8_topk": OP8, "op9_embeddings": OP9,
            "op11_repair": OP11, "op12_resample": OP12, "op13_imatch": OP13}
