"""Text assembly as column expressions (T1-T4) and chunk packing (T5).

Everything except T5 is a built-in expression (whole-stage codegen).  T5 is
a greedy, order-dependent fold, done in segments of bounded length (see
``chunk_numbers``); only ``(group, seq, length)`` triples go through Python,
never the text itself, and chunk texts are then assembled by a normal
``groupBy(chunk)`` whose groups are bounded by the chunk limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import cut_lineage

# Chunk limits of the codebook packer
MAX_CHUNK_CHARS = 9000
CODES_HEAD = 12
CODES_TAIL = 8
CODE_VALUE_CHARS = 60
CODE_TEXT_CHARS = 120
LABEL_CHARS = 200
DESCRIPTION_CHARS = 400
REDUCED_LABEL_CHARS = 120
REDUCED_DESCRIPTION_CHARS = 180
VARS_PER_CHUNK = 30


def normalize_ws(c: Column) -> Column:
    """Whitespace runs -> one space, trimmed; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def truncate_ellipsis(c: Column, m: int) -> Column:
    """T1, then longer than ``m``: first m-3 chars right-trimmed + '...'
    (m <= 3: hard cut, m <= 0: '')."""
    if m <= 0:
        return F.lit("")
    n = normalize_ws(c)
    if m <= 3:
        return F.when(F.length(n) <= m, n).otherwise(F.substring(n, 1, m))
    return F.when(F.length(n) <= m, n).otherwise(F.concat(F.rtrim(F.substring(n, 1, m - 3)), F.lit("...")))


def _trunc_lambda(x: Column, m: int) -> Column:
    return truncate_ellipsis(x, m)


def compact_code_list(codes: Column, head: int = CODES_HEAD, tail: int = CODES_TAIL) -> Column:
    """First ``head`` + last ``tail`` codes as ``- value: text`` lines, header
    with the total and ``(n more omitted)``.  ``codes`` is
    ``array<struct<value string, text string>>``; empty / null -> ''."""
    total = F.size(codes)
    show = head + tail
    picked = F.when(total <= show, codes).otherwise(
        F.concat(F.slice(codes, 1, head), F.slice(codes, F.greatest(total - tail + 1, F.lit(head + 1)),
                                                   F.lit(tail))))

    def line(cv):
        v = _trunc_lambda(cv["value"], CODE_VALUE_CHARS)
        t = _trunc_lambda(cv["text"], CODE_TEXT_CHARS)
        return (F.when((v != "") & (t != ""), F.concat(F.lit("- "), v, F.lit(": "), t))
                .when(v != "", F.concat(F.lit("- "), v))
                .when(t != "", F.concat(F.lit("- "), t)))

    lines = F.filter(F.transform(picked, line), lambda s: s.isNotNull())
    shown = F.size(lines)
    omitted = F.greatest(total - shown, F.lit(0))
    header = F.when(omitted > 0, F.format_string("**Code Values** (%d total; showing %d):\n", total, shown)) \
        .otherwise(F.format_string("**Code Values** (%d):\n", total))
    all_lines = F.when(omitted > 0, F.concat(lines, F.array(F.format_string("- ... (%d more omitted)", omitted)))) \
        .otherwise(lines)
    body = F.concat(header, F.array_join(all_lines, "\n"), F.lit("\n"))
    return F.when(codes.isNull() | (total == 0), F.lit("")).otherwise(body)


def render_variable_block(var_id: Column, label: Column, description: Column, codes: Column,
                          availability: Column) -> Column:
    """T4: ``## id``, label, description when it differs from the label, code
    list, availability; blocks over 9000 chars fall back to a reduced form
    (label <= 120, description <= 180, no codes)."""
    lab_raw = F.coalesce(label.cast("string"), F.lit("N/A"))
    desc_raw = F.coalesce(description.cast("string"), F.lit("N/A"))

    def block(lab_max: int, desc_max: int, with_codes: bool) -> Column:
        lab = truncate_ellipsis(lab_raw, lab_max)
        desc = truncate_ellipsis(desc_raw, desc_max)
        parts = [F.lit("\n## "), var_id.cast("string"), F.lit("\n**Label**: "), lab, F.lit("\n"),
                 F.when((desc != "") & (normalize_ws(desc) != normalize_ws(lab)),
                        F.concat(F.lit("**Description**: "), desc, F.lit("\n"))).otherwise(F.lit(""))]
        if with_codes:
            cb = compact_code_list(codes)
            parts.append(F.when(cb != "", F.concat(F.lit("\n"), cb)).otherwise(F.lit("")))
        parts.append(F.when(availability.isNotNull(),
                            F.concat(F.lit("\n**Availability**: "), availability.cast("string"), F.lit("\n")))
                     .otherwise(F.lit("")))
        return F.concat(*parts)

    full = block(LABEL_CHARS, DESCRIPTION_CHARS, True)
    reduced = block(min(LABEL_CHARS, REDUCED_LABEL_CHARS), min(DESCRIPTION_CHARS, REDUCED_DESCRIPTION_CHARS), False)
    return F.when(F.length(full) > MAX_CHUNK_CHARS, reduced).otherwise(full)


def _trunc_normalized(n: Column, m: int) -> Column:
    """T2 on text that is already whitespace-normalised."""
    if m <= 0:
        return F.lit("")
    if m <= 3:
        return F.when(F.length(n) <= m, n).otherwise(F.substring(n, 1, m))
    return F.when(F.length(n) <= m, n).otherwise(F.concat(F.rtrim(F.substring(n, 1, m - 3)), F.lit("...")))


def staged_code_list(df: DataFrame, codes: str, out: str) -> DataFrame:
    """T3 as staged columns: the truncated lines are computed once and reused
    (CollapseProject keeps non-cheap expressions that are referenced twice)."""
    total = F.size(F.col(codes))
    picked = F.when(total <= CODES_HEAD + CODES_TAIL, F.col(codes)).otherwise(
        F.concat(F.slice(codes, 1, CODES_HEAD),
                 F.slice(F.col(codes), F.greatest(total - CODES_TAIL + 1, F.lit(CODES_HEAD + 1)), F.lit(CODES_TAIL))))

    def line(cv):
        v = _trunc_lambda(cv["value"], CODE_VALUE_CHARS)
        t = _trunc_lambda(cv["text"], CODE_TEXT_CHARS)
        return F.struct(v.alias("v"), t.alias("t"))

    d = df.withColumn("_vt", F.transform(picked, line))
    d = d.withColumn("_lines", F.filter(F.transform("_vt", lambda x: (
        F.when((x["v"] != "") & (x["t"] != ""), F.concat(F.lit("- "), x["v"], F.lit(": "), x["t"]))
        .when(x["v"] != "", F.concat(F.lit("- "), x["v"])).when(x["t"] != "", F.concat(F.lit("- "), x["t"])))),
        lambda y: y.isNotNull()))
    shown = F.size("_lines")
    omitted = F.greatest(total - shown, F.lit(0))
    header = F.when(omitted > 0, F.format_string("**Code Values** (%d total; showing %d):\n", total, shown)) \
        .otherwise(F.format_string("**Code Values** (%d):\n", total))
    all_lines = F.when(omitted > 0, F.concat(F.col("_lines"), F.array(F.format_string("- ... (%d more omitted)", omitted)))) \
        .otherwise(F.col("_lines"))
    body = F.concat(header, F.array_join(all_lines, "\n"), F.lit("\n"))
    return d.withColumn(out, F.when(F.col(codes).isNull() | (total == 0), F.lit("")).otherwise(body)) \
        .drop("_vt", "_lines")


def render_blocks(df: DataFrame, var_id: str, label: str, description: str, codes: str,
                  availability: str, out: str = "block") -> DataFrame:
    """T4 as staged columns: each long text is whitespace-normalised once."""
    d = df.withColumn("_lab_n", normalize_ws(F.coalesce(F.col(label).cast("string"), F.lit("N/A")))) \
          .withColumn("_desc_n", normalize_ws(F.coalesce(F.col(description).cast("string"), F.lit("N/A"))))
    d = staged_code_list(d, codes, "_codes")

    def block(lab: Column, desc: Column, with_codes: bool) -> Column:
        parts = [F.lit("\n## "), F.col(var_id).cast("string"), F.lit("\n**Label**: "), lab, F.lit("\n"),
                 F.when((desc != "") & (desc != lab), F.concat(F.lit("**Description**: "), desc, F.lit("\n")))
                 .otherwise(F.lit(""))]
        if with_codes:
            parts.append(F.when(F.col("_codes") != "", F.concat(F.lit("\n"), F.col("_codes"))).otherwise(F.lit("")))
        parts.append(F.when(F.col(availability).isNotNull(),
                            F.concat(F.lit("\n**Availability**: "), F.col(availability).cast("string"), F.lit("\n")))
                     .otherwise(F.lit("")))
        return F.concat(*parts)

    d = d.withColumn("_full", block(_trunc_normalized(F.col("_lab_n"), LABEL_CHARS),
                                    _trunc_normalized(F.col("_desc_n"), DESCRIPTION_CHARS), True))
    reduced = block(_trunc_normalized(F.col("_lab_n"), min(LABEL_CHARS, REDUCED_LABEL_CHARS)),
                    _trunc_normalized(F.col("_desc_n"), min(DESCRIPTION_CHARS, REDUCED_DESCRIPTION_CHARS)), False)
    d = d.withColumn(out, F.when(F.length("_full") > MAX_CHUNK_CHARS, reduced).otherwise(F.col("_full")))
    return d.drop("_lab_n", "_desc_n", "_codes", "_full")


def _starts(lens: np.ndarray, max_chars: int, max_vars: int) -> np.ndarray:
    """For a chunk that begins at block i: where the next one begins."""
    n = len(lens)
    upto = np.concatenate([[0], np.cumsum(lens + 1)])     # each block with its separator
    # blocks i .. j-1 fit if upto[j] - upto[i] - 1 <= max_chars; one block fits always
    fit = np.searchsorted(upto, upto[:-1] + max_chars + 1, side="right") - 1
    i = np.arange(n)
    return np.minimum(np.maximum(fit, i + 1), i + max_vars)


def _segment_map(max_chars: int, max_vars: int, segment: int):
    """Per segment: for each place at which a chunk may begin in it first (its first
    ``max_vars`` blocks), where the first chunk of the following segment begins and how
    many chunks begin here."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        own = int((~pdf["ahead"]).sum())
        nxt = _starts(pdf["len"].to_numpy(dtype=np.int64), max_chars, max_vars)
        exits, chunks = np.zeros(own, dtype=np.int64), np.zeros(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            inside = nxt[i] < own
            exits[i] = exits[nxt[i]] if inside else nxt[i] - own
            chunks[i] = 1 + (chunks[nxt[i]] if inside else 0)
        m = min(max_vars, own)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "seg": [int(pdf["seg"].iloc[0])], "own": [own],
                             "exits": [exits[:m].tolist()], "chunks": [chunks[:m].tolist()]})
    return run


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group's segments, in order: where its first chunk begins and which number it has."""
    pdf = pdf.sort_values("seg", kind="stable")
    entry, number, out = 0, 0, []
    for seg, own, exits, chunks in zip(pdf["seg"], pdf["own"], pdf["exits"], pdf["chunks"]):
        out.append((seg, entry, number))
        if entry < own:
            entry, number = int(exits[entry]), number + int(chunks[entry])
        else:  # a short last segment that an earlier chunk covers
            entry -= own
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(out), "seg": [o[0] for o in out],
                         "entry": [o[1] for o in out], "number": [o[2] for o in out]})


def _number_blocks(max_chars: int, max_vars: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        own = int((~pdf["ahead"]).sum())
        nxt = _starts(pdf["len"].to_numpy(dtype=np.int64), max_chars, max_vars)
        begins, at = np.zeros(own, dtype=np.int64), int(pdf["entry"].iloc[0])
        while at < own:
            begins[at] = 1
            at = int(nxt[at])
        # blocks ahead of the entry belong to the chunk before
        chunk = int(pdf["number"].iloc[0]) - 1 + np.cumsum(begins)
        return pd.DataFrame({"grp": pdf["grp"].iloc[:own], "seq": pdf["seq"].iloc[:own], "chunk_id": chunk})
    return run


def chunk_numbers(lens: DataFrame, max_chars: int = MAX_CHUNK_CHARS, max_vars: int = VARS_PER_CHUNK,
                  segment: int = 8192) -> DataFrame:
    """(grp, seq, chunk_id) for ``lens(grp, seq, len)``; ``seq`` orders a group and is unique in it.

    A group is cut into segments of ``segment`` blocks that different tasks work on.  A chunk
    holds at most ``max_vars`` blocks, so the first chunk that begins in a segment begins at
    one of its first ``max_vars`` blocks: each segment maps these to the same question for
    the next one (it sees that many blocks ahead).  The maps of a group, one small row per segment, are
    followed from its start; then every segment numbers its own blocks."""
    segment = max(segment, max_vars)
    # in order over the partitions: a block's place is its place in the partition plus what lies before
    placed = lens.repartitionByRange("grp", "seq").withColumn("pid", F.spark_partition_id())
    placed = cut_lineage(placed.select("grp", "seq", "len", "pid"))
    before = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("grp", "pid").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("grp", "pid").orderBy("seq")
    pos = (placed.withColumn("_r", F.row_number().over(inside) - 1).alias("p")
           .join(offsets.select(F.col("grp").alias("_g"), F.col("pid").alias("_p"), "_before"),
                 F.col("grp").eqNullSafe(F.col("_g")) & (F.col("pid") == F.col("_p")))
           .select("grp", "seq", "len", (F.col("_r") + F.col("_before")).alias("pos")))
    seg = F.floor(F.col("pos") / segment).cast("long")
    ahead = (F.col("pos") % segment < max_vars) & (seg > 0)
    where = F.when(ahead, F.array(F.struct(seg.alias("seg"), F.lit(False).alias("ahead")), F.struct((seg - 1).alias("seg"), F.lit(True).alias("ahead")))
                   ).otherwise(F.array(F.struct(seg.alias("seg"), F.lit(False).alias("ahead"))))
    rows = cut_lineage(pos.select("grp", "seq", "len", "pos", F.explode(where).alias("w")).select("grp", "seq", "len", "pos", "w.*"))
    maps = rows.groupBy("grp", "seg").applyInPandas(_segment_map(max_chars, max_vars, segment),
                                                    "grp string, seg long, own long, exits array<long>, chunks array<long>")
    entries = maps.groupBy("grp").applyInPandas(_compose, "grp string, seg long, entry long, number long")
    entries = entries.select(F.col("grp").alias("_g"), F.col("seg").alias("_s"), "entry", "number")
    return (rows.join(entries, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("seg") == F.col("_s"))).drop("_g", "_s")
            .groupBy("grp", "seg").applyInPandas(_number_blocks(max_chars, max_vars), "grp string, seq long, chunk_id long"))


def pack_chunks(blocks: DataFrame, group_col: str, seq_col: str, block_col: str,
                max_chars: int = MAX_CHUNK_CHARS, max_vars: int = VARS_PER_CHUNK, segment: int = 8192) -> DataFrame:
    """T5: greedy packing in ``seq`` order per group: a new chunk starts when
    chars + 1 separator + block > ``max_chars`` or after ``max_vars`` blocks.
    Returns ``(group, chunk_id, n_blocks, text)`` with blocks joined by '\\n'."""
    keyed = blocks.select(F.col(group_col).cast("string").alias("grp"), F.col(seq_col).cast("long").alias("seq"), F.col(block_col).alias("block"))
    assign = chunk_numbers(keyed.select("grp", "seq", F.coalesce(F.length("block"), F.lit(0)).cast("long").alias("len")), max_chars, max_vars, segment)
    assign = assign.select(F.col("grp").alias("_g"), F.col("seq").alias("_s"), "chunk_id")
    j = keyed.join(assign, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("seq") == F.col("_s")))
    return j.groupBy("grp", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda s: s["block"]),
                     "\n").alias("text")).withColumnRenamed("grp", group_col)
