"""Source divergence audit by Gustavson row accumulation.

Within a language every source's term profile is compared with every other's.
The value of a pair is the sum over all kept terms of |p - q|, where almost all
terms are absent from one side or both.  Terms are dealt into buckets; a bucket
holds its part of the term-major index.  For each source (a row) the bucket's
task walks the row's terms, scatters what the index holds for them into one
dense accumulator over all peers and emits only the accumulator.  Every term
starts from the baseline |z - z'| of two zero counts; the row's own terms
correct it on their side, shared terms correct it once more:

    |p - q| = |z - z'| + (|p - z'| - |z - z'|) + (|z - q| - |z - z'|)
              + (|p - q| - |p - z'| - |z - q| + |z - z'|)
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import table
from hearth.llm.registry import register
from hearth.llm.words import lowered, slices
from hearth.session import cut_lineage

# fixed value: a term is a run of these bytes (ASCII letters and all bytes of other characters)
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PRIOR = 5


def count_terms(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents with the term, summed in the
    tasks; a group comes as one row per task and flush (``held`` distinct entries)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(TERM)
        n, df = defaultdict(Counter), defaultdict(Counter)

        def flush():
            for group, counts in n.items():
                terms = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]] * len(terms), pa.string()), pa.array([group[1]] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                     pa.array([df[group][t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "df"])
            n.clear()
            df.clear()
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    words = pattern.findall(lowered(text))
                    if words:
                        n[lang, source].update(words)
                        df[lang, source].update(set(words))
                if sum(map(len, n.values())) > held:
                    yield from flush()
        yield from flush()
    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact beyond 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)"))


def _accumulate(key: tuple, postings: pa.Table, peers: pa.Table) -> pa.Table:
    """One bucket: rows of this block against all peers of the language."""
    out = {"a": [], "b": [], "v": []}
    names = np.sort(peers.column("source").to_numpy(zero_copy_only=False).astype(object))
    z = np.zeros(len(names), np.int64)
    z[np.searchsorted(names, peers.column("source").to_numpy(zero_copy_only=False).astype(object))] = peers.column("z").to_numpy()
    blocks = np.zeros(len(names), np.int64)
    blocks[np.searchsorted(names, peers.column("source").to_numpy(zero_copy_only=False).astype(object))] = peers.column("own").to_numpy()
    row = np.searchsorted(names, postings.column("source").to_numpy(zero_copy_only=False).astype(object))
    _, term = np.unique(postings.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    p = postings.column("p").to_numpy()
    order = np.lexsort((row, term))               # the term-major index
    row, term, p = row[order], term[order], p[order]
    ends = np.searchsorted(term, term, side="right")
    by_row = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[by_row], np.arange(len(names) + 1))
    for g in np.flatnonzero((np.diff(bounds) > 0) & (blocks == key[2].as_py())):
        at = by_row[bounds[g]:bounds[g + 1]]       # index positions of the row's own postings
        base = np.abs(z[g] - z)
        own = np.sort(p[at])
        sums, low = np.concatenate([[0], np.cumsum(own)]), np.searchsorted(own, z)
        # sum of |p - z'| over the row's terms, by where z' falls among them
        acc = (z * low - sums[low]) + (sums[-1] - sums[low] - z * (len(own) - low)) - len(own) * base
        for some in np.array_split(at, max(1, int((ends[at] - at).sum() // 2_000_000))):
            lengths = ends[some] - some - 1        # later rows of the same term
            first = np.repeat(some + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            peer_at = first + np.arange(len(first))
            h, q, mine = row[peer_at], p[peer_at], np.repeat(p[some], lengths)
            np.add.at(acc, h, np.abs(mine - q) - np.abs(mine - z[h]) - np.abs(z[g] - q) + base[h])
        some = np.flatnonzero((acc != 0) & (np.arange(len(names)) != g))
        out["a"].append(names[np.minimum(some, g)])
        out["b"].append(names[np.maximum(some, g)])
        out["v"].append(acc[some])
    a, b, v = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out.values(), (object, object, np.int64)))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(v), pa.string()), "a": pa.array(a, pa.string()),
                     "b": pa.array(b, pa.string()), "v": pa.array(v.astype(np.int64))})


def divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, bucket_rows: int = 200_000,
               row_block: int = 1024) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language with the summed difference, all
    ranks.  Part ``term``: terms commoner in the source than in the language, the first
    ``top_terms``.  Null text, lang and source are ''.  A language without a term in
    ``min_docs`` documents has pairs of value 0 and no terms; a group without terms still
    takes part.  Repeated rows are documents of their own.  No rows: none.

    A term's postings lie in one bucket of about ``bucket_rows``; languages of more than
    ``row_block`` sources are worked on in blocks of rows.  The pairs themselves are the
    output, ``sources^2`` rows for each language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # dealt by language and term, so that sums by source and by term need no further shuffle
    counted = (count_terms(rows).repartition("lang", "term").groupBy("lang", "term", "source")
               .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    of_term = W.partitionBy("lang", "term")
    kept = cut_lineage(counted.withColumn("docs", F.sum("df").over(of_term)).withColumn("all_n", F.sum("n").over(of_term))
                       .withColumn("one", F.when(F.row_number().over(of_term.orderBy("source")) == 1, 1).otherwise(0))
                       .where(F.col("docs") >= min_docs).select("lang", "term", "source", "n", "all_n", "one"))
    langs = kept.groupBy("lang").agg(F.sum("one").alias("terms"), F.sum("n").alias("lang_n"), F.count("*").alias("postings"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["group_n", "terms", "lang_n", "postings"]))
    per_lang = W.partitionBy("lang")
    groups = cut_lineage(groups.withColumn("z", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("group_n"), F.col("terms"))).otherwise(F.lit(0)).cast("long"))
                         .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("postings") / bucket_rows)).cast("int"))
                         .withColumn("blocks", F.ceil(F.count("*").over(per_lang) / row_block).cast("int"))
                         .withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    found = kept.join(groups.drop("postings"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_n"), F.col("terms")).cast("long"))

    above = found.withColumn("value", F.col("p") - _share(F.col("all_n"), F.col("lang_n"), F.col("terms")).cast("long")).where(F.col("value") > 0)
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = (above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))

    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    postings = (found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
                .select("lang", "bucket", block, "source", "term", "p"))
    peers = (groups.where(F.col("terms") > 0).select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "z", "own", "blocks")
             .select("lang", "bucket", block, "source", "z", "own"))
    key = ["lang", "bucket", "block"]
    sums = (postings.groupBy(*key).cogroup(peers.groupBy(*key)).applyInArrow(_accumulate, "lang string, a string, b string, v long")
            .groupBy("lang", "a", "b").agg(F.sum("v").alias("v")))
    left = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "terms", F.col("own").alias("block"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), block)
    both = (left.join(right, ["lang", "block"]).where(F.col("a") < F.col("b")).join(sums, ["lang", "a", "b"], "left")
            .withColumn("value", F.col("terms") * F.abs(F.col("za") - F.col("zb")) + F.coalesce("v", F.lit(0)))
            .select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                              F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value"))
    nearest = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (both.select("lang", "x.*", "value").withColumn("rank", F.row_number().over(nearest))
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"), "rank"))
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(all_n)::HUGEINT AS lang_n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS group_n
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.group_n + 5 * v.terms) AS p,
             1 + (1000000000::HUGEINT * (k.all_n + 5)) // (v.lang_n + 5 * v.terms) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


@register("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all documents against each other and against their language."""
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
