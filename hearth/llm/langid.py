"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded
sample of labelled texts.  A text is lower-cased, reduced to its letters and
apostrophes, cut into blocks, and every block is compressed once per language;
the language whose dictionary gives the smallest total wins.  A text whose
runner-up is nearly as small is flagged ``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import held_out, table, unit
from hearth.llm.registry import register
from hearth.session import cut_lineage

BLOCK = 1024
BROADCAST_ROWS = 200_000
_ASCII_NOT_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}


def clean(text: str) -> str:
    """Lower case, ASCII digits and signs as one space; nothing if no letter is left."""
    words = " ".join(text.lower().translate(_ASCII_NOT_LETTERS).split())
    return words if any(map(str.isalpha, words)) else ""


def learn_dictionaries(docs: DataFrame, lang: str = "lang", rows_per_language: int = 400,
                       dictionary_bytes: int = 65536, share: int = 8, seed: int = 11) -> list[tuple[str, bytes]]:
    """``[(language, dictionary)]`` from ``docs(doc_id, text, <lang>)``, most frequent first.

    The sample is bounded: of each language about ``rows_per_language`` distinct texts,
    drawn by a hash of the text, cleaned in whole, of each of which at most one part in
    ``share`` of ``dictionary_bytes`` goes into the dictionary; where too few texts are
    there to fill it so, what is left over of them follows.  The bounds are the same for every
    input size; every language is learned (one row and one dictionary of each come to the
    driver).  Rows with a null language, a null text or no letter teach nothing, and a
    language without any other has no dictionary and cannot be predicted."""
    rows = docs.select(F.col(lang).cast("string").alias("l"), F.col("text").cast("string").alias("text"),
                       unit(F.lit(seed), F.col("text")).alias("u"))
    rows = rows.where(F.col("l").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("u").alias("texts"))
    # about so many distinct texts of each language; equal texts have one u, so one row of them is kept
    rate = cut_lineage(known.select(F.col("l").alias("k"), "n", (F.lit(float(rows_per_language)) / F.col("texts")).alias("rate")))
    if rate.count() <= BROADCAST_ROWS:  # one row per language; so the texts stay where they are
        rate = F.broadcast(rate)
    drawn = (rows.join(rate, F.col("l") == F.col("k")).where(F.col("u") < F.col("rate"))
             .groupBy("l", "u").agg(F.first("text").alias("text"), F.first("n").alias("n")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [clean(t.as_py()).encode()[:dictionary_bytes] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("n"), b.column("u"), pa.array(whole, pa.binary())], ["l", "n", "u", "piece"])
    pieces = drawn.select("l", "n", "u", "text").mapInArrow(cut, "l string, n long, u double, piece binary").where(F.length("piece") > 0)

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        got = [p.as_py() for p in part.sort_by("u").column("piece")]
        most = dictionary_bytes // share
        first = b" ".join(p[:most] for p in got)[:dictionary_bytes]
        rest = b" ".join(p[most:] for p in got if len(p) > most)[:max(0, dictionary_bytes - len(first))]
        return pa.table({"l": pa.array([key[0].as_py()], pa.string()), "n": part.column("n").slice(0, 1).combine_chunks(), "dictionary": pa.array([first + rest], pa.binary())})
    made = pieces.groupBy("l").applyInArrow(pack, "l string, n long, dictionary binary")
    return [(r["l"], bytes(r["dictionary"])) for r in sorted(made.toLocalIterator(), key=lambda r: (-r["n"], r["l"]))]


class Compressors:
    """One compressor per language; answers (language, score, margin)."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int):
        import zstandard
        self.names = [k for k, _ in dictionaries]
        self.of = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                level, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.of.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        letters = clean(text) if text else ""
        if not letters or not self.names:
            return "und", 0.0, 0.0
        blocks = [letters[i:i + BLOCK].encode() for i in range(0, len(letters), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.of]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        low = sizes[order[0]]
        score = 1.0 / sum(2.0 ** -min(60, x - low) for x in sizes)
        margin = (sizes[order[1]] - low) / low if len(order) > 1 else 1.0
        return self.names[order[0]], score, margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], min_margin: float = 0.02,
             level: int = 6) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for each row of ``docs(doc_id, text)``.

    ``score`` is the winner's share when every byte saved halves the odds of
    the others; ``margin`` is the runner-up's excess over the winner;
    ``rejected`` marks margins under ``min_margin``, whose prediction is still
    given.  Texts that are null or have no letter are ``und``, score 0,
    rejected.  Equal sizes go to the language learned from more rows.  Repeated
    rows repeat; no rows give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or Compressors(dictionaries, level)
            got = [machine.classify(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()),
                 pa.array([g[2] < min_margin for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; dictionaries come from rows whose
    crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = learn_dictionaries(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = identify(docs, learned)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
