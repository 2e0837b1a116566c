"""Lexicon packs: sentences made of the packs' terms by each document's id, before its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.lexicon import NEAR, find_phrases, lexicon_findings, lexicon_table
from spanveil.plans.catalogue import query
from spanveil.rules.lexica import PACKS
from spanveil.session import table

#: Longer than NEAR, and without any term.
_PAUSE = " ~ " * 20
_TERMS = [(p.id, *t) for p in PACKS for t in p.terms()]
_LABELS = {(p, c): t for p, k, c, t in reversed(_TERMS) if k == "label"}
_NEGATIVE = {p: t for p, k, _, t in _TERMS if k == "negative"}
_LEAD = {(p, k): t for p, k, _, t in _TERMS if k in ("honorific", "context")}


def _sentences() -> list[str]:
    """For every term a sentence: alone, behind its label, and near a negative term; and the frames of names."""
    out = []
    for p, k, c, t in _TERMS:
        if k == "sensitive":
            label = _LABELS.get((p, c), _LABELS[p, "name"])
            out += [f"~ {t.upper()} ~", f"~ {label} : {t} ~", f"~ {_NEGATIVE[p]} , {t} ~"]
        else:
            out.append(f"~ {t} ~")
    for (p, k), t in _LEAD.items():
        out += [f"~ {t} Quirin Zabel ~", f"~ {_LABELS[p, 'name']}: {t} Zabel ~", f"~ {t} {_NEGATIVE[p].title()} ~"]
    return out


SENTENCES = _sentences()


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*')"
_HITS = f"""
WITH v AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_quoted(x)})" for i, x in enumerate(SENTENCES))}) t(k, said)),
d AS (SELECT doc_id, said || '{_PAUSE}' || coalesce(text, '') AS text FROM documents JOIN v ON k = doc_id % {len(SENTENCES)}),
l AS (SELECT pack, kind, category, lower(array_to_string({_WORDS.format('term')}, ' ')) AS key, len({_WORDS.format('term')}) AS n FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, t)) + ')' for t in _TERMS)}) t(pack, kind, category, term)),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*') AS g FROM d),
t AS (SELECT doc_id, text, unnest(w) AS x, unnest(g[1:len(w)]) AS gap, unnest(range(len(w))) AS i FROM w),
p AS (SELECT *, sum(length(gap) + length(x)) OVER o AS e FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
q AS ({' UNION ALL '.join(f"SELECT doc_id, text, i, {n} AS n, e - length(x) AS s, last_value(e) OVER o{n} AS e, lower(string_agg(x, ' ') OVER o{n}) AS key, count(*) OVER o{n} AS many FROM p WINDOW o{n} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in range(1, 5))}),
a AS (SELECT DISTINCT doc_id, text, pack, kind, category, n, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM q JOIN l USING (key, n) WHERE many = n),
h AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.pack = a.pack AND b.kind = a.kind AND b.s < a.e AND a.s < b.e AND (b.n > a.n OR (b.n = a.n AND b.s < a.s))))
"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    said = spark.createDataFrame(list(enumerate(SENTENCES)), "k long, said string")
    docs = table(spark, sf, "documents").join(F.broadcast(said), F.col("doc_id") % len(SENTENCES) == F.col("k"))
    return docs.select("doc_id", F.concat("said", F.lit(_PAUSE), F.coalesce("text", F.lit(""))).alias("text"))


@query("q_lexicon_terms", f"{_HITS} SELECT doc_id, pack, kind, category, s, e, substr(text, s + 1, e - s) AS value FROM h")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    """All terms of all packs in all texts, the longest first in each pack and kind."""
    return find_phrases(_docs(spark, sf), lexicon_table(spark), per=("pack", "kind"))


@query(
    "q_lexicon_findings",
    f"""{_HITS},
f AS (SELECT doc_id, text, pack, category, s, e FROM h WHERE kind = 'sensitive' UNION
  SELECT doc_id, text, pack, 'name', CAST(e + length(m[1]) AS INT), CAST(e + length(m[1]) + length(m[2]) AS INT) FROM (SELECT *, [regexp_extract(substr(text, e + 1, 120), '^(\\.?[ \\t]+|:[ \\t]*)\\p{{Lu}}\\p{{Ll}}', 1),
    regexp_extract(substr(text, e + 1, 120), '^(?:\\.?[ \\t]+|:[ \\t]*)(\\p{{Lu}}\\p{{Ll}}+(?:-\\p{{Lu}}\\p{{Ll}}+)*(?:[ \\t]\\p{{Lu}}\\p{{Ll}}+(?:-\\p{{Lu}}\\p{{Ll}}+)*){{0,2}})', 1)] AS m FROM h WHERE kind IN ('honorific', 'context')) WHERE m[2] <> '')
SELECT doc_id, pack, category, s, e, substr(text, s + 1, e - s) AS value,
  CASE WHEN EXISTS (SELECT 1 FROM h b WHERE b.doc_id = f.doc_id AND b.pack = f.pack AND b.kind = 'label' AND b.category = f.category AND b.e <= f.s AND f.s - b.e <= {NEAR}) THEN 'medium' ELSE 'low' END AS confidence
FROM f WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = f.doc_id AND b.pack = f.pack AND b.kind = 'negative' AND b.s - f.e <= {NEAR} AND f.s - b.e <= {NEAR})
""",
)
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon_findings(_docs(spark, sf), lexicon_table(spark))
