"""Knowledge-base candidates and relation summaries.

Candidate search (J06) matches a term against entity names by
case-insensitive substring.  Instead of a nested loop it uses an exact
n-gram index of the different names: every name containing the term contains
each of the term's character n-grams, so joining on the term's *rarest* n-gram
(n = 3, or the term length when shorter) and verifying with ``contains`` finds all matches
with equi-joins only.  Ranking keeps the best ``limit`` per term through a
WindowGroupLimit, and property lists are aggregated per ``(entity, prop)``
for the kept candidates only, before any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.functions.text import py_strip
from textlens.plans.sizing import tasks_for
from textlens.session import materialize, scratch_dir
from textlens.sources.keystore import KeyStore

SEP = " | "
GRAM = 3

# Properties read for each entity, their relation label and
# weight, in configuration order.
RELATION_CONFIG = (
    ("P31", "实例类型", 0.8),
    ("P279", "上级分类", 0.7),
    ("P527", "组成部分", 0.6),
    ("P361", "所属系列", 0.5),
)


def _grams(col: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(
        F.length(col) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substring(col, i, n))),
    ).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- A07
def grouped_distinct_concat(df: DataFrame, keys: Sequence[str], val: str, sep: str = SEP,
                            out_col: str = "vals") -> DataFrame:
    """Distinct values per key, sorted, joined by ``sep``.  The distinct runs
    as its own shuffle on (keys, value), so a hot key is spread before its
    values are gathered."""
    d = df.select(*keys, val).where(F.col(val).isNotNull()).distinct()
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(val)), sep).alias(out_col))


def sample_description(entities: DataFrame, key: str = "qid", desc: str = "description") -> DataFrame:
    """One description per entity (the smallest; ``''`` when none)."""
    return entities.groupBy(key).agg(F.coalesce(F.min(desc), F.lit("")).alias(desc))


def property_lists(props: DataFrame, config=RELATION_CONFIG, key: str = "qid", prop: str = "prop",
                   val: str = "value") -> DataFrame:
    """Entity rows with one ``' | '`` list column per configured property
    (``p31s`` ...; ``''`` when the entity has none).  One distinct on
    (entity, prop, value), one grouping per entity; the per-property lists
    are cut out of the grouped pairs by a projection (no pivot pass)."""
    ids = [p for p, _, _ in config]
    d = props.where(F.col(prop).isin(ids) & F.col(val).isNotNull()).select(key, prop, val).distinct()
    g = d.groupBy(key).agg(F.collect_list(F.struct(F.col(prop).alias("p"), F.col(val).alias("v"))).alias("_pv"))

    def one(p: str) -> Column:
        vals = F.transform(F.filter("_pv", lambda x: x["p"] == F.lit(p)), lambda x: x["v"])
        return F.array_join(F.array_sort(vals), SEP).alias(f"{p.lower()}s")

    return g.select(key, *[one(p) for p in ids])


# ---------------------------------------------------------------- J06 + L02
def candidate_matches(terms: DataFrame, names: DataFrame, term: str = "term", key: str = "qid",
                      name: str = "name") -> DataFrame:
    """All ``(term, key, name)`` with ``lower(name)`` containing ``lower(term)``."""
    t = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    t = t.withColumn("_lt", F.lower("term")).withColumn("_n", F.least(F.length("_lt"), F.lit(GRAM)))
    n = names.select(F.col(key).alias("_key"), F.col(name).alias("_name")).where(F.col("_name").isNotNull())
    n = n.where(F.col("_key").isNotNull()).repartition(tasks_for(names), "_key").distinct().withColumn("_ln", F.lower("_name"))
    n = n.withColumn("_h", F.xxhash64("_ln"))
    # Gram sizes are 1..GRAM whatever the terms; only (hash, size, gram) of the
    # different names is exploded, the few that share a rare gram meet all rows
    # of their name again (names of equal hash are told apart by ``contains``).
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("_n"), _grams(F.col("_ln"), k).alias("_gs"))
                                for k in range(1, GRAM + 1)])).alias("_s")
    used = t.select("_n").distinct()  # at most GRAM rows
    ngrams = n.select("_h", "_ln").distinct().select("_h", sizes).join(F.broadcast(used), F.col("_s._n") == F.col("_n")).select(
        "_h", F.col("_s._n").alias("_n"), F.explode("_s._gs").alias("_g"))
    rarest = _rarest_grams(_term_grams(t), ngrams)
    # Names repeat and compress well, so a file's size says little of its rows,
    # and a broadcast by that size could be of millions of grams: both joins are
    # merge joins, where the skew-join split handles a common n-gram or name.
    keys = ngrams.join(rarest.hint("merge"), ["_n", "_g"], "inner").select("term", "_lt", "_h").distinct()
    hits = n.join(keys.hint("merge"), "_h").where(F.contains("_ln", "_lt"))
    return hits.select("term", F.col("_key").alias(key), F.col("_name").alias(name))


def _term_grams(t: DataFrame) -> DataFrame:
    return t.select("term", "_lt", "_n", F.explode(_grams(F.col("_lt"), F.col("_n"))).alias("_g"))


def _rarest_grams(term_grams: DataFrame, ngrams: DataFrame) -> DataFrame:
    """Of every term the gram that the fewest names hold."""
    freq = ngrams.groupBy("_n", "_g").agg(F.count(F.lit(1)).alias("_f"))
    tg = term_grams.join(freq.hint("merge"), ["_n", "_g"], "inner")
    w = Window.partitionBy("term").orderBy(F.col("_f").asc(), F.col("_g").asc())
    return tg.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("term", "_lt", "_n", "_g")


class NameIndex:
    """Names by the n-grams they hold, kept on disk: built once, extended by new
    names, read per term (:func:`candidate_matches` without exploding all names
    at every call).

    Postings ``(gram, key, name)`` lie in buckets by gram, so a search reads the
    buckets of its terms' grams and no others.  The names themselves are a
    key store too; a commit there, written last, is what makes its postings
    count, so an extension that was lost half-way leaves no trace."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 256):
        self.spark = spark
        self.names = KeyStore(spark, f"{path}/names", "key STRING, name STRING", ["key", "name"], n_buckets)
        self.grams = KeyStore(spark, f"{path}/grams", "gram STRING, key STRING, name STRING", ["gram", "key", "name"], n_buckets,
                              bucket_by=["gram"])

    def extend(self, names: DataFrame, key: str = "qid", name: str = "name") -> int:
        """Add names (null ones are left out); those already held add nothing.
        Returns how many there are now."""
        given = names.select(F.col(key).cast("string").alias("key"), F.col(name).alias("name")).where(F.col("name").isNotNull())
        number = self.names.next_commit()
        new = materialize(self.names.new_rows(given, ["name"]).select("key", "name"))
        low = F.lower("name")
        each = F.array_distinct(F.flatten(F.array(*[_grams(low, k) for k in range(1, GRAM + 1)])))
        self.grams._write(new.select(F.explode(each).alias("gram"), "key", "name"), number, False, mode="overwrite")
        self.names._write(new, number, False)
        return self.names.count()

    def postings(self, grams: DataFrame) -> DataFrame:
        """``(gram, key, name)`` of the buckets that ``grams(gram)`` fall into."""
        whole = {c.number for c in self.names.commits()}
        return self.grams._read([p for p in self.grams.parts(self.grams.buckets_of(grams)) if p.commit in whole])

    def search(self, terms: DataFrame, term: str = "term", key: str = "qid", name: str = "name") -> DataFrame:
        """All ``(term, key, name)`` with ``lower(name)`` containing
        ``lower(term)``: the postings of each term's rarest gram, verified."""
        t = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
        t = t.withColumn("_lt", F.lower("term")).withColumn("_n", F.least(F.length("_lt"), F.lit(GRAM)))
        asked = materialize(_term_grams(t))
        held = self.postings(asked.select(F.col("_g").alias("gram"))).withColumn("_n", F.length("gram")).withColumnRenamed("gram", "_g")
        rarest = _rarest_grams(asked, held.select("_n", "_g"))
        hits = held.join(rarest, ["_n", "_g"]).where(F.contains(F.lower("name"), "_lt"))
        return hits.select("term", F.col("key").alias(key), F.col("name").alias(name)).distinct()


def rank_candidates(matches: DataFrame, entities: DataFrame, key: str = "qid", label: str = "label",
                    desc: str = "description", limit: int = 10) -> DataFrame:
    """Order per term by: a name equal to the term (case-sensitive), a name
    containing it, the description containing it (all case-insensitive,
    descending), then qid; keep the first ``limit``.

    Matches are dealt by entity, into tasks that follow the number of
    entities: one shuffle serves the grouping and the join, and each task sends
    its first ``limit`` of every term."""
    tests = matches.repartition(tasks_for(entities), key).groupBy("term", key).agg(
        F.max((F.col("name") == F.col("term")).cast("int")).alias("exact_match"),
        F.max(F.contains(F.lower("name"), F.lower("term")).cast("int")).alias("label_match"),
    )
    ent = entities.select(key, label, F.coalesce(F.col(desc), F.lit("")).alias(desc))
    j = tests.join(ent.hint("merge"), key, "inner").withColumn(
        "desc_match", F.contains(F.lower(desc), F.lower("term")).cast("int"))
    w = Window.partitionBy("term").orderBy(F.col("exact_match").desc(), F.col("label_match").desc(),
                                           F.col("desc_match").desc(), F.col(key).asc())
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def entity_candidates(terms: DataFrame, entities: DataFrame, props: DataFrame, aliases: DataFrame | None = None,
                      limit: int = 10, key: str = "qid", label: str = "label", desc: str = "description",
                      config=RELATION_CONFIG) -> DataFrame:
    """term -> up to ``limit`` ranked entities with description and the
    configured property lists (F10 shape)."""
    names = entities.select(key, F.col(label).alias("name"))
    if aliases is not None:
        names = names.unionByName(aliases.select(key, F.col(aliases.columns[1]).alias("name")))
    ranked = rank_candidates(candidate_matches(terms, names, key=key), entities, key, label, desc, limit)
    path = scratch_dir(terms.sparkSession, "candidates")  # written: two joins read the few rows kept
    ranked.write.parquet(path)
    ranked = terms.sparkSession.read.schema(ranked.schema).parquet(path)
    kept = ranked.select(key).distinct()
    out = ranked.join(property_lists(props.join(kept, key, "left_semi"), config, key), key, "left")
    cols = [f"{p.lower()}s" for p, _, _ in config]
    return out.select("term", "rank", key, label, desc, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])


# ---------------------------------------------------------------- A08
def relation_importance(ents: DataFrame, config=RELATION_CONFIG, key: str = "qid") -> DataFrame:
    """Split the ``' | '`` lists, attach label and weight by property;
    importance = sum of weights rounded to 2; relations sorted by weight
    descending (stable: configuration order, then list order).  One
    projection per row: the few properties are taken in their sorted order,
    so nothing is exploded, grouped or joined."""
    by_weight = sorted(enumerate(config), key=lambda c: (-c[1][2], c[0]))
    kind = "array<struct<relation:string,value:string,weight:double>>"

    def items(p: str, lab: str, w: float) -> Column:
        c = F.col(f"{p.lower()}s")
        made = F.transform(F.split(c, r" \| "), lambda v: F.struct(
            F.lit(lab).alias("relation"), py_strip(v).alias("value"), F.lit(float(w)).alias("weight")))
        return F.when(c.isNotNull() & (c != ""), made).otherwise(F.array().cast(kind))

    relations = F.concat(*[items(*c) for _, c in by_weight])
    out = ents.withColumn("relations", relations)
    score = F.round(F.aggregate("relations", F.lit(0.0), lambda a, r: a + r["weight"]), 2)
    return out.select(*ents.columns, score.alias("importance_score"), "relations")


# ---------------------------------------------------------------- A09
def explanation_text(cands: DataFrame, term: str = "term", rank: str = "rank", desc: str = "description") -> DataFrame:
    """Per term, one ``'term, description'`` line per candidate in rank order."""
    g = cands.groupBy(term).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(desc)))).alias("_c"))
    return g.select(term, F.array_join(F.transform("_c", lambda c: F.concat(F.col(term), F.lit(", "), c[desc])),
                                       "\n").alias("explanation"))
