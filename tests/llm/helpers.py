"""Shared by the tests of the training-data operators."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
TABLES = ("documents", "labels", "embeddings")


def connection(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canon(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def table_rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in records), key=repr)


def same_as_sql(df, sql, sf=SF):
    cur = connection(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table_rows(df.columns, [tuple(r) for r in df.collect()]) == table_rows(names, cur.fetchall())


def ascii_lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def words(text):
    """Words by the rule [^\\x20\\x09-\\x0D]+, without a regex."""
    out, cur = [], ""
    for c in text or "":
        if c in WS:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


#: Rows that every document operator must take: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, "Alpha beta gamma delta. Alpha beta gamma delta.", "en", "s1"),
    (1, "Alpha beta gamma delta. Alpha beta gamma delta.", "en", "s1"),
    (2, "Alpha beta gamma delta. Alpha beta gamma delta.", None, None),
    (3, None, "en", "s1"), (4, "", "en", "s2"), (5, " \t\r\x0b\x0c ", "en", "s2"), (6, "\n\n\n", None, "s2"),
    (None, "no id here", "en", None), (None, None, None, None),
    (7, "word " * 3000, "en", "s1"), (8, "x" * 5000, "en", "s3"), (9, "ÀÉÎ  éè \U0001f525 中文  a b", "fr", "s3"),
    (10, "one", "en", "s3"), (11, "one two", "en", "s3"),
]


def odd_documents(spark, extra=()):
    """``ODD`` as documents, with extra columns of the given names."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, lang, s, None if t is None else len(t)) + tuple(f"{c}-{k}" for c in extra) for k, (i, t, lang, s) in enumerate(ODD)]
    return spark.createDataFrame(rows, kind + "".join(f", `{c}` string" for c in extra))


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
