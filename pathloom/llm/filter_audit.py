"""Interaction audit of five text filters as a relational word pipeline.

Words are exploded and counted by (document, word), then by document: totals and distinct words. The other flags come
from the text itself and from its digest. Joined by an outer join they give each document a mask of the filters that it
fails (bit k for the k-th letter), and 32 conditional counts for each part hold all that the 120 orders need: the rows of
the result are sums over these counts.

How it scales: the text is shuffled once, by document, and both aggregations of its words keep that partitioning, so no word
leaves its task. Copies of one text are first counted by text, part and label (partial sums before the shuffle), so a text
that holds a third of all rows is a few rows when the least doc_id of each text is looked for. Nothing is collected or
broadcast; what follows the last aggregation has one row for each part.

Defined results: null text is empty; a null lang is the part ''; a repeated row is a document of its own, and copies are only
those of a smaller doc_id; a null doc_id is never a copy and makes no copies; labels that repeat a doc_id
count as 1 if any row of theirs does; no documents give no rows. Rows of one doc_id with different texts are told apart by a
64-bit hash of the text, texts table-wide by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: The white space that parts words, as a regex class body, and the parameters of the filters.
SPACE = "\\x20\\x09-\\x0D"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _texts(docs: DataFrame) -> DataFrame:
    """Rows are known by (id, text_key), which are never null: a null doc_id is 0 there, and told apart in the hash."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.xxhash64(text, docs["doc_id"].isNull()).alias("text_key"),
    )


def _parts(df: DataFrame) -> int:
    """Words weigh several times as much in a hash table as their text in a shuffle, so partitions are smaller than elsewhere."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_counts(texts: DataFrame) -> DataFrame:
    """id, text_key, words and distinct_words of all rows with that key (words of repeated rows add up); texts without a word are absent."""
    held = texts.select("id", "text_key", "text").repartition(_parts(texts), "id", "text_key")
    words = held.select("id", "text_key", F.explode(F.split("text", f"[{SPACE}]+")).alias("word")).where("word <> ''")
    by_word = words.groupBy("id", "text_key", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("id", "text_key").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, 1 << LETTERS.index(letter)).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, text_digest, mask of A to D, good, toxic, doc_id and copies (how many rows are alike)."""
    texts = _texts(docs)
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    own = _bit(100 * capitals > MOST_CAPITALS * F.length("text"), "C") + _bit(F.col("text").rlike(SYMBOLS), "D")
    flags = texts.select("doc_id", "id", "part", "text_key", F.unhex(F.sha2("text", 256)).alias("text_digest"), own.alias("own")).repartition(_parts(texts), "id", "text_key")
    flags = flags.groupBy("doc_id", "id", "part", "text_key", "text_digest", "own").agg(F.count("*").alias("copies"))
    # words of repeated rows have been added up: the number of rows divides the sum again
    flags = flags.withColumn("rows", F.sum("copies").over(Window.partitionBy("id", "text_key")))
    words, distinct = F.coalesce("words", F.lit(0)) / F.col("rows"), F.coalesce("distinct_words", F.lit(0))
    by_words = _bit(words < LEAST_WORDS, "A") + _bit(100 * distinct < LEAST_DISTINCT * words, "B")
    flags = flags.join(word_counts(texts), ["id", "text_key"], "left").select("doc_id", "part", "text_digest", "copies", (F.col("own") + by_words).alias("mask"))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("labelled")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    joined = flags.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return joined.select("part", "text_digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "doc_id", "copies")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each of the 32 masks m: n_m documents, good_m and toxic_m of them."""
    alike = ["part", "text_digest", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    groups = failures(docs, labels).groupBy(*alike).agg(
        F.sum("copies").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("copies"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("least"), F.min_by("copies", F.when(known, F.col("doc_id"))).alias("at_least"),
    )
    # one row for each part and label of a text, however many copies there are: the one of the least doc_id is no copy
    least = F.min("least").over(Window.partitionBy("text_digest"))
    originals = F.col("unnamed") + F.when(F.col("least") == least, F.col("at_least")).otherwise(0)
    groups = groups.select("part", "mask", "good", "toxic", "n", originals.alias("originals"))
    copied = 1 << LETTERS.index("E")
    columns = []
    for m in range(MASKS):
        n = F.when(F.col("mask") == m % copied, F.col("n") - F.col("originals") if m & copied else F.col("originals")).otherwise(0)
        columns += [F.sum(n).alias(f"n_{m}"), F.sum(n * F.col("good")).alias(f"good_{m}"), F.sum(n * F.col("toxic")).alias(f"toxic_{m}")]
    return groups.groupBy("part").agg(*columns)


def _total(counts: str, condition: str) -> Column:
    return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (total, m) -> total + if({condition}, {counts}[m], 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    counts = mask_counts(docs, labels)
    held = counts.select("part", *(F.array(*(F.col(f"{kind}_{m}") for m in range(MASKS))).alias(f"{kind}_of") for kind in ("n", "good", "toxic")))
    steps = held.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    before = " + ".join(f"if(instr(left(filter_order, step - 1), '{x}') > 0, {1 << k}, 0)" for k, x in enumerate(LETTERS))
    steps = steps.withColumn("before", F.expr(before)).withColumn("own", F.expr(f"shiftleft(1, instr('{LETTERS}', substring(filter_order, step, 1)) - 1)"))
    removed = "(m & own) <> 0 and (m & before) = 0"
    return steps.select(
        "part", "filter_order", "step",
        _total("n_of", "(m & (own | before)) = 0").alias("kept"), _total("n_of", removed).alias("removed"), _total("n_of", "(m & own) <> 0 and (m & before) <> 0").alias("redundant"),
        _total("n_of", "m = own").alias("unique_fails"), _total("good_of", removed).alias("good_lost"), _total("toxic_of", removed).alias("toxic_lost"),
        # a document falls to each of the filters that it fails in an equal share of the orders
        F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (total, m) -> total + if((m & own) <> 0, n_of[m] * ({len(ORDERS)} div bit_count(m)), 0L))").alias("shapley"),
    )


#: DuckDB SQL for the rows of the audit: every order is applied to every document's mask.
SQL = """
WITH held AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), flagged AS (
    SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM held
), marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN f.doc_id > least THEN 16 ELSE 0 END AS mask
    FROM flagged f LEFT JOIN marks l ON l.doc_id = f.doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (instr('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) - 1) AS own,
        list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, CAST(k AS INTEGER), 1)) - 1))) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), applied AS (
    SELECT part, filter_order, step, own,
        CAST(sum(CASE WHEN mask & (own | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM applied
"""
