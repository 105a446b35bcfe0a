"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of q distinct shingles is contained in a document when at least
``need = ceil(threshold * q)`` of them occur there.  Of each item the
``q - need + 1`` smallest shingle hashes are its sketch: a document that holds
``need`` shingles cannot miss all of them, so the search loses nothing.  Items
are partitioned by size (powers of two); each partition has its own hash cut
(its largest sketch value) and its own least document size, and a document only
offers the hashes below the cuts of the partitions it is large enough for.
Candidates are verified by exact containment of shingle strings.

DataFrame functions only.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import SPACE, fresh, table
from hearth.llm.registry import register
from hearth.session import cut_lineage

BROADCAST_ROWS = 100_000  # narrow rows (a few longs each) that may be broadcast; more are joined by shuffle


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space (none for null)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def shingle_strings(w: Column, k: int) -> Column:
    """Distinct word shingles; a text of fewer than ``k`` words is one shingle, no word none."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return F.array_distinct(F.when(n >= k, many).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(h: Column, k: int) -> Column:
    """One hash per shingle position from the words' hashes."""
    n = F.size(h)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))


def _hashed(df: DataFrame, text: Column, k: int) -> DataFrame:
    """``df`` with ``_h``: the shingle hashes of ``text``.  Each array is made in
    a projection of its own, as later ones refer to it many times."""
    return (df.withColumn("_w", words(text))
            .withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
            .withColumn("_h", shingle_hashes(F.col("_x"), k)).drop("_w", "_x"))


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, item_id, shared, item_shingles) for each document of
    ``docs(doc_id, text)`` that contains at least ``threshold`` of the distinct
    shingles of an item of ``items(item_id, text)``.

    Null and empty texts hold nothing and are contained nowhere.  An item with
    fewer than ``shingle`` words is one shingle, found only in a document of
    the same words.  Null ids are ids like any other.  Repeated rows and rows
    that share an id and a text are one document (``text_hash`` tells apart
    texts under one id; of an item_id the texts are separate items, and the
    best is reported).  No documents or no items: no rows."""
    items = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where(F.col("text").isNotNull()).distinct())
    told = _hashed(items, F.col("text"), shingle).withColumn("h", F.array_sort(F.array_distinct("_h")))
    told = (told.withColumn("q", F.size("h")).where(F.col("q") > 0)
            .withColumn("need", F.ceil(F.col("q") * threshold - 1e-9).cast("int"))
            .withColumn("need", F.greatest("need", F.lit(1))))
    sketch = (told.withColumn("s", F.slice("h", F.lit(1), F.col("q") - F.col("need") + 1))
              .select("item_id", F.xxhash64("text").alias("item_hash"), "q", "need", "s",
                      F.floor(F.log2("q")).cast("int").alias("part")))
    # at most 31 partitions by size: their cuts are literals of the plan
    parts = sketch.groupBy("part").agg(F.max(F.array_max("s")).alias("cut"), F.min("need").alias("least")).collect()
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, shared long, item_shingles long")
    cut = F.greatest(*[F.when(F.col("n") >= p["least"], F.lit(p["cut"])) for p in parts], F.lit(None).cast("long"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    offered = (_hashed(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), F.col("text"), shingle)
               .withColumn("n", F.size("_h"))
               # the outer form keeps the optimizer from testing the array, and so making it, twice
               .select("doc_id", "text_hash", "n", cut.alias("cut"), F.explode_outer("_h").alias("h"))
               .where(F.col("h") <= F.col("cut")))
    keys = sketch.select("item_id", "item_hash", "need", F.explode("s").alias("h"))
    pairs = cut_lineage(offered.join(keys, "h").where(F.col("n") >= F.col("need"))
                        .select("doc_id", "text_hash", "item_id", "item_hash").distinct())

    few = pairs.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    suspects = hint(pairs.select("doc_id", "text_hash").distinct())
    texts = rows.withColumn("text_hash", F.xxhash64("text")).alias("d").join(
        suspects.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left_semi")
    said = (texts.dropDuplicates(["doc_id", "text_hash"]).withColumn("_w", words(F.col("text")))
            .select("doc_id", "text_hash", F.explode_outer(shingle_strings(F.col("_w"), shingle)).alias("shingle")))
    asked = (items.withColumn("_w", words(F.col("text"))).withColumn("_s", shingle_strings(F.col("_w"), shingle))
             .select("item_id", F.xxhash64("text").alias("item_hash"), F.size("_s").alias("q"), F.explode("_s").alias("shingle")))
    shared = (said.join(asked, "shingle").groupBy("doc_id", "text_hash", "item_id", "item_hash")
              .agg(F.count("*").alias("shared"), F.first("q").cast("long").alias("item_shingles")))
    found = shared.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("item_shingles") * threshold - 1e-9)))
    # the pair must have come through the sketch; by the pigeonhole all do
    found = found.alias("f").join(hint(pairs).alias("p"), F.col("f.doc_id").eqNullSafe(F.col("p.doc_id"))
                                  & (F.col("f.text_hash") == F.col("p.text_hash")) & F.col("f.item_id").eqNullSafe(F.col("p.item_id"))
                                  & (F.col("f.item_hash") == F.col("p.item_hash")), "left_semi")
    best = F.max(F.struct(F.col("shared") / F.col("item_shingles"), "shared", "item_shingles")).alias("b")
    return (found.groupBy("doc_id", "text_hash", "item_id").agg(best)
            .select("doc_id", "text_hash", "item_id", "b.shared", "b.item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` (all columns) that contain no item.  Rows with a null text stay."""
    hits = find_contained(docs, items, threshold, shingle).select("doc_id", "text_hash").distinct()
    hits = cut_lineage(hits)
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    mark = fresh(docs, "text_hash")
    return (docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).alias("d")
            .join(hits.alias("h"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id"))
                  & (F.col(f"d.{mark}") == F.col("h.text_hash")), "left_anti").drop(mark))


def _sql_shingles(name: str, key: str) -> str:
    return f"""
{name}_w AS (SELECT {key}, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {name}),
{name}_s AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {name}_w)"""


OP5_SQL = f"""
WITH {_sql_shingles('documents', 'doc_id')}, {_sql_shingles('benchmark', 'item_id')},
q AS (SELECT item_id, count(*) AS item_shingles FROM benchmark_s GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM documents_s JOIN benchmark_s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM m JOIN q USING (item_id) WHERE shared >= ceil(item_shingles * 0.8 - 1e-9)
"""


@register("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item it contains (five words, 0.8)."""
    found = find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct(F.col("shared") / F.col("item_shingles"), "shared", "item_shingles")).alias("b")
    return (found.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "b.shared", "b.item_shingles", (F.col("b.shared") / F.col("b.item_shingles")).alias("containment")))
