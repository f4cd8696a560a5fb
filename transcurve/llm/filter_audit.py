"""What filters of a corpus take out together: a relational pipeline over words.

Words are exploded and counted by (document, word), then by document for totals and
distinct words; the other filters' flags join these counts, and one aggregation of
conditional counts, one for each of the 32 combinations of failures, tells what any order of
the five filters keeps, removes and would have removed anyway.

A row is found again by its doc_id (null: 0) and its text's digest, so texts are dealt to
tasks by both before they are exploded and the two word counts need no further shuffle.
Repeated rows share that key: a null word that each row adds counts them, and the totals
are divided by it. A null text is empty; an empty text fails A and nothing else by itself.
A null doc_id has no labels and is no copy of a smaller one, nor is one a copy of it; equal
texts under one doc_id aren't copies of each other. Several labels of a document count as one
that is set if any is. A null source is the part "". Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

FILTERS = "ABCDE"
#: A: least words. B: least share of distinct words, in hundredths. C: largest share of capitals, in hundredths. D: characters of markup.
WORDS, DISTINCT, CAPITALS, MARKUP = 200, 50, 2, "[#$%&*|]"
#: Text partitions for each of Spark's shuffle partitions: the counts of a task's words stay in memory.
PARTS = 4
SPACE = r"[\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "digest": F.md5("text")})


def word_counts(docs: DataFrame) -> DataFrame:
    """id, digest, words and distinct words of a row's text, a row for each id and text."""
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs).select("id", "digest", "text").repartition(parts, "id", "digest")
    words = rows.select("id", "digest", F.explode(F.concat(F.split("text", SPACE), F.array(F.lit(None).cast("string")))).alias("word")).where("word is null or word <> ''")
    counted = words.groupBy("id", "digest", "word").agg(F.count("*").alias("n"))
    word, copies = F.col("word").isNotNull(), F.sum(F.when(F.col("word").isNull(), F.col("n")))
    return counted.groupBy("id", "digest").agg((F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)) / copies).cast("long").alias("words"), F.count("word").alias("distinct_words"))


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part and, for each row of ``docs``, whether it fails each filter: columns A to E."""
    length = F.length("text")
    rows = _keyed(docs).select(
        "doc_id", "part", "id", "digest",
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITALS * length).alias("C"),
        F.col("text").rlike(MARKUP).alias("D"),
    )
    rows = common.with_least(rows, "digest", "doc_id", "first").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    both = rows.join(word_counts(docs), ["id", "digest"], "left_outer")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    return both.select("doc_id", "part", (words < WORDS).alias("A"), (100 * distinct < DISTINCT * words).alias("B"), "C", "D", "E")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(marked, "doc_id", "left")


def combinations(rows: DataFrame) -> DataFrame:
    """part, and arrays of 32 counts by the mask of failed filters: n, and of rows labelled good and toxic."""
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    masks = range(1 << len(FILTERS))
    counts = [F.count_if((F.col("mask") == m) & also).alias(f"{kind}{m}") for kind, also in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in masks]
    found = rows.withColumn("mask", mask).groupBy("part").agg(*counts)
    return found.select("part", *[F.array(*[f"{kind}{m}" for m in masks]).alias(kind) for kind in ("n", "good", "toxic")])


def report(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of combinations."""
    orders = ",".join(map("".join, itertools.permutations(FILTERS)))
    rows = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    # the bits of the step's filter and of those before it
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda test: sum((F.when(test(at), 1 << i).otherwise(0) for i, (f, at) in enumerate(place.items())), F.lit(0))
    rows = rows.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})

    def total(kind: str, wanted: Callable[[Column], Column], weight: Callable[[Column, Column], Column] = lambda n, m: n) -> Column:
        each = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, m: s + F.when(wanted(m), weight(F.get(F.col(kind), m), m)).otherwise(F.lit(0).cast("long")))

    fails, reached = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) == 0)
    here = lambda m: fails(m) & reached(m)
    # a filter comes first among the k failed ones in one of k orders
    share = lambda n, m: (n * (F.lit(120) / F.bit_count(m)).cast("long")).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: reached(m) & ~fails(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return report(combinations(_labelled(flags(docs), labels)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_filter_audit": query}

#: By the first failed filter of each order, over groups of documents that fail the same ones.
ORACLES: dict[str, str] = {
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS earliest FROM d),
f AS (SELECT doc_id, part,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > earliest THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND a.c <> e.c AND b.c <> c.c AND b.c <> d.c AND b.c <> e.c AND c.c <> d.c AND c.c <> e.c AND d.c <> e.c),
p AS (SELECT g.*, filter_order, least(CASE WHEN contains(fails, 'A') THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN contains(fails, 'B') THEN instr(filter_order, 'B') ELSE 6 END, CASE WHEN contains(fails, 'C') THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN contains(fails, 'D') THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN contains(fails, 'E') THEN instr(filter_order, 'E') ELSE 6 END) AS hit FROM g, o),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
  sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM p, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
}
