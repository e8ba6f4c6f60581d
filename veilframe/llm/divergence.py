"""How far the sources of a language differ in their words: shards counted and compared by DuckDB.

Tasks count the terms of their texts; counts are dealt to shards by a hash of
language and term, so whatever concerns one term of a language meets in one
shard.  There SQL adds up the counts, keeps the frequent terms and, once the
totals are known, makes each shard's part of every sum.  Spark merges sums and
ranks.

With f(p, q) = floor((p - q)^2 / (p + q)) and a smoothed p for counts of zero,
a pair's sum over all kept terms needs a meeting of two sources only at terms
that both have: what f gives there goes beside sums over histograms of counts
for the terms that one of them has, and one number for the terms of neither.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from functools import partial

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import partitions, small_batches, stored, tidy, work_dir

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Text that a task counts at a time, and rows of counts that a shard should hold.
TEXT_BYTES, SHARD_ROWS = 24 << 20, 1 << 20
#: Sources of a term that one task compares with all others of the term.
SIDE = 512

COUNT = """
    WITH w AS (SELECT row_number() OVER () AS r, lang, source, text FROM texts),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, $term)) AS term FROM w),
    d AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL)
    SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM d GROUP BY lang, source, term
"""
KEEP = """
    WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY lang, source, term),
    k AS (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS frequency, sum(n) OVER (PARTITION BY lang, term) AS all_n, count(*) OVER (PARTITION BY lang, term) AS sources FROM c)
    SELECT lang, source, term, n, all_n::BIGINT AS all_n, sources FROM k WHERE frequency >= $least
"""
SMOOTH = "(1 + 1000000000::HUGEINT * ({n} + 2) // ({total} + 2 * terms))::BIGINT"
F_SQL = "(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"


def f_sql(p: str, q: str) -> str:
    return F_SQL.format(p=p, q=q)


#: A shard's part of the sums: kinds ``both`` (source a, source b, value), ``one`` (source, its p, how many terms) and ``term`` (source, term, value).
PARTS = f"""
    WITH s AS (SELECT lang, source, term, side, mine, {SMOOTH.format(n="n", total="total")} AS p, {SMOOTH.format(n="0", total="total")} AS p0, {SMOOTH.format(n="all_n", total="lang_total")} AS q FROM counts),
    both_ AS (SELECT a.lang, a.source AS a, b.source AS b, sum({f_sql("a.p", "b.p")} - {f_sql("a.p", "b.p0")} - {f_sql("a.p0", "b.p")} + {f_sql("a.p0", "b.p0")})::BIGINT AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.side = b.side AND a.mine AND a.source < b.source GROUP BY a.lang, a.source, b.source),
    one AS (SELECT lang, source, p, count(*) AS n FROM s WHERE mine GROUP BY lang, source, p),
    best AS (SELECT lang, source, term, {f_sql("p", "q")} AS value FROM s WHERE mine AND p > q),
    term AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(term)) AS r FROM best)
    SELECT 'both' AS kind, lang, a AS source, b AS item, NULL::BIGINT AS p, value FROM both_
    UNION ALL SELECT 'one', lang, source, NULL, p, n FROM one
    UNION ALL SELECT 'term', lang, source, term, NULL, value FROM term WHERE r <= $top
"""
PARTS_SCHEMA = "kind string, lang string, source string, item string, p long, value long"


def _run_sql(sql: str, table: pa.Table, name: str, schema: pa.Schema, **given):
    """Batches of a query over one Arrow table, in memory and in one thread."""
    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
        con.register(name, table)
        got = con.sql(sql, params=given or None).to_arrow_table()
        con.unregister(name)
    return got.cast(schema).to_batches(max_chunksize=1 << 16)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


COUNTED, KEPT = "lang string, source string, term string, n long, docs long", "lang string, source string, term string, n long, all_n long, sources long"


def _counts(batches, most: int, term: str = TERM):
    """Counts of the terms of a task's texts, some megabytes of text at a time."""
    schema, waiting, size = _arrow(COUNTED), [], 0

    def counted():
        texts = pa.Table.from_batches(waiting)
        texts = texts.set_column(texts.schema.get_field_index("text"), "text", pc.ascii_lower(texts["text"]))
        return _run_sql(COUNT, texts, "texts", schema, term=term)

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from counted()
            waiting, size = [], 0
    if waiting:
        yield from counted()


def _shard(batches, sql: str, schema: str, **given):
    """A query over all of a task's shard."""
    rows = list(batches)
    if rows:
        yield from _run_sql(sql, pa.Table.from_batches(rows), "counts", _arrow(schema), **given)


def term_counts(docs: DataFrame, folder: str, least: int = 10) -> DataFrame:
    """Terms in at least ``least`` documents of their language: lang, source, term, n, all_n (in the language), sources (that have it)."""
    spark = docs.sparkSession
    counted = stored(docs.mapInArrow(tidy(partial(_counts, most=TEXT_BYTES)), COUNTED), folder, "counted")
    shards = max(partitions(spark), -(-counted.count() // SHARD_ROWS))
    return stored(counted.repartition(shards, "lang", "term").mapInArrow(tidy(partial(_shard, sql=KEEP, schema=KEPT, least=least)), KEPT), folder, "kept")


def divergence(documents: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """Lang, source, part, item, value and rank: ``pair`` rows for each other source of the language, ``term`` rows for the ``top`` terms that mark the source.

    Null texts, languages and sources are empty; repeated rows all count; texts
    are read whole; ties go by item in byte order.  A source without terms stands
    in its pairs, with value 0 where its language keeps no term.  An empty table
    gives no rows; other columns are left aside.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    docs = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = term_counts(docs, folder, least)
    # N of each group and language, V of each language; one row a group
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    of_lang = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    known = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    p0 = F.when(F.col("terms") > 0, F.lit(1).cast("long") + F.expr("2000000000L div (total + 2 * terms)"))
    groups = stored(known.withColumn("p0", p0), folder, "groups")

    sides = F.ceil(F.col("sources") / SIDE).cast("int")
    own = F.pmod(F.xxhash64("source"), sides).cast("int")
    rows = kept.join(groups.where("terms > 0").select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    rows = rows.withColumn("own_side", own).withColumn("side", F.explode(F.sequence(F.lit(0), sides - 1))).withColumn("mine", F.col("side") == F.col("own_side"))
    shards = max(partitions(spark), -(-kept.count() // SHARD_ROWS))
    rows = rows.select("lang", "source", "term", "n", "all_n", "total", "lang_total", "terms", "side", "mine").repartition(shards, "lang", "term", "side")
    parts = stored(rows.mapInArrow(tidy(partial(_shard, sql=PARTS, schema=PARTS_SCHEMA, top=top)), PARTS_SCHEMA), folder, "parts")

    # Half of f(p, p0) sums: what the terms that a source has would give against a source that has none of them
    f = F.expr("((p - p0) * (p - p0)) div (p + p0)")
    one = parts.where("kind = 'one'").groupBy("lang", "source", "p").agg(F.sum("value").alias("n"))
    against = one.join(groups.where("terms > 0").select("lang", "p0").distinct(), "lang").groupBy("lang", "source", "p0").agg(F.sum(f * F.col("n")).alias("alone"))
    both = parts.where("kind = 'both'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("met"))
    side = lambda n: groups.select("lang", *(F.col(c).alias(f"{c}_{n}") for c in ("source", "own", "p0")), *(["terms"] if n == "a" else []))
    sums = lambda n, m: against.select("lang", F.col("source").alias(f"source_{n}"), F.col("p0").alias(f"p0_{m}"), F.col("alone").alias(f"alone_{n}"))
    pairs = side("a").join(side("b"), "lang").where("source_a < source_b")
    pairs = pairs.join(sums("a", "b"), ["lang", "source_a", "p0_b"], "left").join(sums("b", "a"), ["lang", "source_b", "p0_a"], "left")
    pairs = pairs.join(both.withColumnsRenamed({"a": "source_a", "b": "source_b"}), ["lang", "source_a", "source_b"], "left")
    none = F.expr("(terms - own_a - own_b) * (((p0_a - p0_b) * (p0_a - p0_b)) div (p0_a + p0_b))")
    # `met` holds f(p0, p0) for each term of both, which the last number takes away twice
    value = F.coalesce("met", F.lit(0)) + F.coalesce("alone_a", F.lit(0)) + F.coalesce("alone_b", F.lit(0)) + F.coalesce(none, F.lit(0))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("s"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    terms = parts.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
