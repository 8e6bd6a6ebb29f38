"""Portable input views over the driver's tables (FIXTURES.md, section B).

Each view is one SQL text accepted unchanged by Spark SQL and DuckDB.  On the
Spark side the base tables are read as parquet and the view text runs through
``spark.sql``; on the oracle side the same text becomes a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from textlens.operators.knowledge import EMOJI, SLANG

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


VIEWS: dict[str, str] = {
    "v_text": """
SELECT d.doc_id, d.text, d.lang, l.toxic AS label, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_corpus": """
SELECT d.doc_id, d.text, d.lang, l.toxic AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_dialog_turns": """
SELECT conv_id, turn, text,
       turn = max(turn) OVER (PARTITION BY conv_id) AS is_response,
       CASE WHEN conv_id % 3 = 0 THEN 'SARCASM' ELSE 'NOT_SARCASM' END AS label
FROM conversations""",
    "v_social": """
SELECT doc_id, concat('@user', CAST(doc_id % 7 AS STRING), ' #tag ', text,
       CASE doc_id % 5 WHEN 0 THEN ' 🔥🔥 lol' WHEN 1 THEN ' 😂 idk http://t.example/x?y=1'
                       WHEN 2 THEN ' ❤️ tbh  ngl' WHEN 3 THEN ' 🙄!? $5' ELSE '' END) AS text
FROM documents""",
    "v_slang": f"SELECT * FROM (VALUES {_values(SLANG)}) t(slang, expansion)",
    "v_emoji": f"SELECT * FROM (VALUES {_values(EMOJI)}) t(emoji, meaning)",
    "v_lexicon": """
SELECT word, CAST(pos AS DOUBLE) AS positive, CAST(neg AS DOUBLE) AS negative
FROM (VALUES ('the',0.125,0.0),('of',0.0,0.25),('and',0.5,0.125),('de',0.25,0.25),
  ('la',0.0,0.625),('that',0.375,0.0),('is',0.0,0.125)) t(word, pos, neg)""",
    "v_emotion": """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'anger' WHEN 1 THEN 'annoyance' WHEN 2 THEN 'disgust'
    WHEN 3 THEN 'disapproval' WHEN 4 THEN 'disappointment' WHEN 5 THEN 'amusement'
    WHEN 6 THEN 'joy' WHEN 7 THEN 'excitement' ELSE 'neutral' END AS label,
  CAST((doc_id * 13) % 101 AS DOUBLE) / 100 AS score
FROM documents""",
    "v_pred": """
SELECT doc_id, y, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM (
  SELECT doc_id, toxic AS y, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p FROM labels) t""",
    "v_pred_long": """
SELECT doc_id, task, y, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM (
  SELECT doc_id, 'sarcasm' AS task, toxic AS y, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p FROM labels
  UNION ALL SELECT doc_id, 'hostile', quality, CAST((doc_id * 53) % 101 AS DOUBLE) / 100 FROM labels
  UNION ALL SELECT doc_id, 'contempt', CAST(doc_id % 2 AS INT), CAST((doc_id * 71) % 101 AS DOUBLE) / 100 FROM labels
  UNION ALL SELECT doc_id, 'humor', CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT), CAST(0.25 AS DOUBLE) FROM labels) t""",
    "v_spans": """
SELECT l_orderkey AS doc_id, n * 10 AS span_start,
       n * 10 + CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 8 END AS span_end,
       p_name AS word, 'MISC' AS entity_group,
       CAST(70 + l_partkey % 31 AS DOUBLE) / 100 AS score
FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) l
JOIN part ON p_partkey = l_partkey""",
    "v_terms": """
SELECT CASE WHEN length(p_name) % 2 = 0 THEN upper(p_name) ELSE p_name END AS term,
       min(concat(p_name, ', ', p_type)) AS explanation
FROM part GROUP BY 1""",
    "v_triple_lines": """
SELECT p_partkey % 50 AS batch_id, p_partkey AS line_no,
  CASE p_partkey % 10
    WHEN 0 THEN concat(p_name, ',causes,', p_type, ',', w)
    WHEN 1 THEN concat(p_name, ' | antonym | ', p_brand, ' | ', w)
    WHEN 2 THEN concat('"', p_name, '","entails","', p_type, '","', w, '"')
    WHEN 3 THEN concat(p_name, '  has_context  ', p_type, '  ', w)
    WHEN 4 THEN concat(p_name, ',likes,', p_type, ',', w)
    WHEN 5 THEN concat(p_name, ',causes,', p_type, ',9.9')
    WHEN 6 THEN concat('# ', p_name, ',causes,', p_type, ',', w)
    WHEN 7 THEN concat('Note: ', p_name, ' is ignored')
    WHEN 8 THEN 'a,b,c'
    ELSE concat(upper(p_name), ', Causes, ', p_type, ', ', w) END AS line
FROM (SELECT part.*, CAST(CAST(0.5 + (p_partkey % 21) / 10.0 AS DECIMAL(3,1)) AS STRING) AS w FROM part) t""",
    "v_entities": """
SELECT concat('Q', CAST(p_partkey AS STRING)) AS qid, p_name AS label,
       concat(p_type, ' ', p_brand) AS description FROM part""",
    "v_entity_props": """
SELECT concat('Q', CAST(p_partkey AS STRING)) AS qid, 'P31' AS prop, p_type AS value FROM part
UNION ALL SELECT concat('Q', CAST(p_partkey AS STRING)), 'P279', p_brand FROM part
UNION ALL SELECT concat('Q', CAST(l_partkey AS STRING)), 'P361', s_name
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "v_edges": """
SELECT DISTINCT concat('S', CAST(l_suppkey AS STRING)) AS src,
  CASE l_returnflag WHEN 'A' THEN 'antonym' WHEN 'N' THEN 'related_to' ELSE 'derived_from' END AS rel,
  concat('P', CAST(l_partkey AS STRING)) AS dst FROM lineitem""",
    "v_attempts": """
SELECT event_id, ts, user_id AS worker_id, event_type <> 'error' AS ok, value AS seconds FROM events""",
}


def tables_used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture view as a DataFrame over ``sf_dir``'s parquet files.

    Table names become DataFrame arguments of ``spark.sql`` (short-lived
    generated view names), so no session-wide temp view is created or
    replaced."""
    sql = VIEWS[name]
    used = tables_used(sql)
    templ = re.sub(r"\b(" + "|".join(used) + r")\b", r"{\1}", sql) if used else sql
    return spark.sql(templ, **{t: table(spark, sf_dir, t) for t in used})


def fresh(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or scan-only view, dealt over the cores when it is read as a
    few large splits (see :func:`textlens.plans.sizing.spread`)."""
    from textlens.plans.sizing import spread

    return spread(view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name))


def with_views(body: str, *names: str) -> str:
    """DuckDB oracle text: the fixture views as CTEs in front of ``body``.

    ``body`` may itself start with ``WITH``; its CTEs are appended.
    """
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    b = body.strip()
    if b[:4].upper() == "WITH":
        return f"WITH {ctes},\n{b[4:].lstrip()}"
    return f"WITH {ctes}\n{b}"
