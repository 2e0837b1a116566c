"""SQL that computes the same rows as those of the queries that SQL can express, by other means."""

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

#: Op 4: every window of 35 words as a digest, counted over all documents; covered words are left out of what is joined again.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT doc_id, k, md5(string_agg(x, ' ') OVER o) AS h, count(*) OVER o AS n FROM t
      WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, k FROM g WHERE n = 35 AND h IN (SELECT h FROM g WHERE n = 35 GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM r),
l AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM t ANTI JOIN c USING (doc_id, k) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(m.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Op 6: all pairs by their common shingles, and the closure of the links.
JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT doc_id, n, k, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM t),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE k <= greatest(n - 3, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT f.b, r.m FROM r JOIN f ON f.a = r.doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) c USING (doc_id)
"""

#: Op 5: templates as text in place of hashes.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, pos, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09\x0B-\x0D]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM l),
n AS (SELECT doc_id, text, pos, t, len(t) AS n, (len(t) - 3) // 3 AS one, 2 * (len(t) - 3) // 3 AS two FROM k WHERE len(t) >= 1),
q AS (SELECT doc_id, text, pos, greatest(2, ceil(40.0 / n)) AS needs, n || '|0|' || array_to_string(t, ' ') AS key FROM n
  UNION ALL SELECT doc_id, text, pos, 10, n || '|1|' || array_to_string(t[1:3] || ['|'] || t[one + 4:two + 3] || ['|'] || t[two + 4:], ' ') FROM n WHERE n >= 8
  UNION ALL SELECT doc_id, text, pos, 10, n || '|2|' || array_to_string(t[1:3] || ['|'] || t[4:one + 3] || ['|'] || t[two + 4:], ' ') FROM n WHERE n >= 8
  UNION ALL SELECT doc_id, text, pos, 10, n || '|3|' || array_to_string(t[1:3] || ['|'] || t[4:one + 3] || ['|'] || t[one + 4:two + 3], ' ') FROM n WHERE n >= 8),
o AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY 1),
r AS (SELECT key, needs, min(o.first) AS first FROM q JOIN o USING (text) GROUP BY 1, 2 HAVING count(DISTINCT text) >= needs),
x AS (SELECT DISTINCT q.doc_id, q.pos FROM q JOIN r USING (key, needs) JOIN o USING (text) WHERE o.first <> r.first),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN x USING (doc_id, pos) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(c.n, 0) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(s.text, '') END AS text
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _round(k: int) -> str:
    """The assignment under the codebooks c<k>, and the codebooks after it."""
    return f"""
a{k} AS (SELECT vec_id, p.j AS j, any_value(y) AS y, min(struct_pack(d := list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m FROM p JOIN c{k} ON c{k}.j = p.j GROUP BY vec_id, p.j),
n{k} AS (SELECT j, e, list(CASE WHEN s % n < 0 THEN (s - (s % n + n)) // n ELSE (s - s % n) // n END ORDER BY i) AS c FROM (SELECT j, m.e AS e, i, CAST(sum(y[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT o.j AS j, o.e AS e, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n ON n.j = o.j AND n.e = o.e),"""


#: Op 13: every distance, every time. The tables' vectors have 64 components and ids of their own.
VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
j AS (SELECT unnest(range(16)) AS j),
p AS (SELECT vec_id, j, x[4 * j + 1:4 * j + 4] AS y FROM k, j),
s AS (SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
c0 AS (SELECT j, e, x[4 * j + 1:4 * j + 4] AS c FROM s, j WHERE e < 64),{_round(0)}{_round(1)}
f AS (SELECT vec_id, p.j AS j, min(struct_pack(d := list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m FROM p JOIN c2 ON c2.j = p.j GROUP BY vec_id, p.j),
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h
"""


def _edit(letter: str, cost: str, line: str, after: str) -> str:
    return f"struct_pack(c := {cost} + {after}.c, a := '{letter}' || {after}.a, t := {line} || {after}.t)"


#: After nothing, s, u and a: the state that the role that is due leads to, the role, and where keeping a row of an initial leads.
_DUE = ((2, "user", {"s": 1, "u": 2}), (2, "user", {"u": 2}), (3, "assistant", {"a": 3}), (2, "user", {"u": 2}))
_EXTRA = "CASE fate WHEN 'truncated' THEN 3 ELSE 0 END"


def _before(q: int) -> str:
    """The cheapest edits of a row and all after it, the first in ASCII, by state; without Insert before it."""
    due, role, keeps = _DUE[q]
    keep = " ".join(f"WHEN '{g}' THEN {_edit('K', _EXTRA, 'line', f'v[{to + 1}]')}" for g, to in keeps.items())
    again = f"CASE WHEN fate <> 'gone' THEN {_edit('R', f'3 + {_EXTRA}', f"'{role}:' || text || chr(10)", f'v[{due + 1}]')} END"
    return f"list_min([{_edit('D', '4', repr(''), f'v[{q + 1}]')}, CASE WHEN fate <> 'gone' THEN CASE initial {keep} END END, {again}])"


def _inserted(q: int) -> str:
    one, role, _ = _DUE[q]
    two, next_role, _ = _DUE[one]
    first = _edit("I", "3", f"'{role}:' || chr(10)", f"w[{one + 1}]")
    second = _edit("II", "6", f"'{role}:' || chr(10) || '{next_role}:' || chr(10)", f"w[{two + 1}]")
    return f"list_min([w[{q + 1}], {first}, {second}])"


_END = "[struct_pack(c := 0, a := '', t := ''), struct_pack(c := 6, a := 'II', t := 'user:' || chr(10) || 'assistant:' || chr(10)), struct_pack(c := 3, a := 'I', t := 'assistant:' || chr(10)), struct_pack(c := 0, a := '', t := '')]"

#: Op 11: whole edit sequences by state, row by row from the end. The tables' turns differ within a conversation.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS said FROM conversations),
y AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(said, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS hit FROM z),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM y WHERE hit <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS initial,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM d),
g AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM r),
f AS (SELECT conv_id, i, initial, text, role || ':' || text || chr(10) AS line, CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' ELSE fault END AS fate FROM g),
b AS (SELECT conv_id, max(i) + 1 AS i, {_END} AS v FROM f GROUP BY 1
  UNION ALL SELECT conv_id, i, [{', '.join(map(_inserted, range(4)))}] FROM (SELECT b.conv_id, f.i AS i, [{', '.join(map(_before, range(4)))}] AS w FROM b JOIN f ON f.conv_id = b.conv_id AND f.i = b.i - 1)),
s AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT o.conv_id AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(left(v[1].t, CASE WHEN v[1].t = '' THEN 0 ELSE length(v[1].t) - 1 END), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id = o.conv_id LEFT JOIN (SELECT conv_id, v FROM b WHERE i = 1) e ON e.conv_id = o.conv_id
"""
