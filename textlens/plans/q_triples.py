"""Queries for knowledge-triple parsing and ingestion."""

from __future__ import annotations

from textlens.functions.text import WS_RE2
from textlens.operators import triples as T
from textlens.plans.fixtures import fresh, with_views
from textlens.plans.registry import query

ORDER = ["batch_id", "line_no", "line_idx"]
N_TARGET = T.TARGET_COUNT

_RELS = ", ".join(f"'{r}'" for r in T.TRIPLE_RELATIONS)
_NUM = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


_NOISE_RE2 = rf"(?m)(```[\s\S]*?```|^#.*|Examples?:.*|Note:.*|\b[\p{{L}}\p{{N}}_]+:{WS_RE2}*|\*+)"

_T01_CTES = rf"""
c AS (SELECT batch_id, line_no, string_split(regexp_replace(line, '{_NOISE_RE2}', '', 'g'), chr(10)) AS ls
      FROM v_triple_lines),
l AS (SELECT batch_id, line_no, unnest(ls) AS l, unnest(generate_series(0, len(ls) - 1)) AS line_idx FROM c),
s AS (SELECT batch_id, line_no, line_idx, {_strip('l')} AS l FROM l),
q AS (SELECT batch_id, line_no, line_idx, regexp_replace(l, '{WS_RE2}{{2,}}', ',', 'g') AS l2
      FROM s WHERE length(l) >= 10),
p AS (SELECT batch_id, line_no, line_idx,
             CASE WHEN contains(l2, '","')
                  THEN list_transform(string_split(l2, '","'), lambda x: regexp_replace(x, '^"+|"+$', '', 'g'))
                  ELSE regexp_split_to_array(l2, '[,|]{WS_RE2}*') END AS p FROM q),
f AS (SELECT batch_id, line_no, line_idx,
             lower(replace({_strip('p[1]')}, ' ', '_')) AS source_concept,
             lower({_strip('p[2]')}) AS relation_type,
             lower(replace({_strip('p[3]')}, ' ', '_')) AS target_concept,
             CASE WHEN regexp_full_match({_strip('p[4]')}, '{_NUM}')
                  THEN round(TRY_CAST({_strip('p[4]')} AS DOUBLE), 1) END AS weight
      FROM p WHERE len(p) = 4),
t AS (SELECT * FROM f WHERE relation_type IN ({_RELS}) AND weight BETWEEN 0.5 AND 2.5
        AND length(source_concept) >= 2 AND length(target_concept) >= 2)"""

_W03_CTES = _T01_CTES + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY source_concept, relation_type, target_concept
                                   ORDER BY batch_id, line_no, line_idx, weight) AS rn FROM t),
k AS (SELECT source_concept, relation_type, target_concept, weight, batch_id, line_no, line_idx FROM r
      WHERE rn = 1 ORDER BY batch_id, line_no, line_idx, source_concept, relation_type, target_concept
      LIMIT {N_TARGET})"""


def parsed(spark, sf):
    return T.parse_triples(fresh(spark, sf, "v_triple_lines"), "line", keep=["batch_id", "line_no"])


@query("t01_parse_triples", with_views("WITH" + _T01_CTES + "\nSELECT * FROM t", "v_triple_lines"))
def t01(spark, sf):
    return parsed(spark, sf)


W03_ORACLE = with_views("WITH" + _W03_CTES + "\nSELECT * FROM k", "v_triple_lines")


@query("w03_first_n_distinct", W03_ORACLE)
def w03(spark, sf):
    return T.first_n_distinct(parsed(spark, sf), ORDER, N_TARGET)


@query("a15_ingest_progress", with_views("WITH" + _W03_CTES + f""",
pb AS (SELECT batch_id, count(*) AS parsed FROM t GROUP BY batch_id),
ab AS (SELECT batch_id, count(*) AS added FROM k GROUP BY batch_id),
j AS (SELECT pb.batch_id, pb.parsed, coalesce(ab.added, 0) AS added FROM pb LEFT JOIN ab ON pb.batch_id = ab.batch_id)
SELECT batch_id, parsed, added, sum(added) OVER (ORDER BY batch_id) AS total,
       sum(added) OVER (ORDER BY batch_id) >= {N_TARGET} AS target_reached FROM j
""", "v_triple_lines"))
def a15(spark, sf):
    return T.ingest_progress(parsed(spark, sf), "batch_id", ORDER, N_TARGET)
