"""Golden tests for text assembly."""

from pyspark.sql import functions as F

from hearth.functions import text as tx


def test_truncate(spark):
    df = spark.createDataFrame([("  hello   big   world  ",), (None,), ("abcdef",)], "t string")
    r = df.select(tx.normalize_ws(F.col("t")).alias("n"), tx.truncate_ellipsis(F.col("t"), 10).alias("a"),
                  tx.truncate_ellipsis(F.col("t"), 3).alias("b"), tx.truncate_ellipsis(F.col("t"), 0).alias("c")).collect()
    assert r[0].n == "hello big world" and r[0].a == "hello b..." and r[0].b == "hel" and r[0].c == ""
    assert r[1].n == "" and r[1].a == ""
    assert r[2].a == "abcdef"


def test_code_list(spark):
    codes = [{"value": str(i), "text": f"level {i}"} for i in range(1, 26)]
    df = spark.createDataFrame([(codes,), ([],), ([{"value": "1", "text": ""}],)],
                               "c array<struct<value:string,text:string>>")
    out = [r.o for r in tx.staged_code_list(df, "c", "o").collect()]
    lines = out[0].rstrip("\n").split("\n")
    assert lines[0] == "**Code Values** (25 total; showing 20):"
    assert lines[1] == "- 1: level 1" and lines[12] == "- 12: level 12" and lines[13] == "- 18: level 18"
    assert lines[-1] == "- ... (5 more omitted)"
    assert out[1] == ""
    assert out[2] == "**Code Values** (1):\n- 1\n"


def test_pack_chunks(spark):
    rows = [("g", i, "x" * n) for i, n in enumerate([4000, 4000, 1500, 8000, 10, 10])]
    rows += [("h", i, "y") for i in range(65)]
    df = spark.createDataFrame(rows, "grp string, seq long, block string")
    out = tx.pack_chunks(df, "grp", "seq", "block", max_chars=9000, max_vars=30)
    got = {(r.grp, r.chunk_id): r.n_blocks for r in out.collect()}
    # g: [4000, 4000] (+1500 would pass 9000), [1500] (+8000 too big), [8000, 10, 10]
    assert got[("g", 0)] == 2 and got[("g", 1)] == 1 and got[("g", 2)] == 3
    # h: 30 + 30 + 5
    assert [got[("h", i)] for i in range(3)] == [30, 30, 5]
    text = {(r.grp, r.chunk_id): r.text for r in out.collect()}
    assert text[("g", 0)] == "x" * 4000 + "\n" + "x" * 4000


def test_detect_categories(spark):
    from hearth.functions import persona_text as pt
    fields = spark.createDataFrame([("head_age_mean",), ("x12_mode",), ("x9_std",), ("mortgage_amt_mean",)], "field string")
    meta = spark.createDataFrame([("x12", "income"), ("x9", "assets")], "var_id string, category string")
    got = {r.category for r in pt.detect_categories(fields, meta).collect()}
    # x9_std keeps its suffix, so no metadata hit for x9; 'head_age' -> demographics, mortgage -> debt
    assert got == {"demographics", "income", "debt"}


def test_pack_chunks_in_segments_equals_one_fold(spark):
    """A group that spans many segments and partitions is packed as by one greedy pass."""
    import random
    from hearth.functions.text import chunk_numbers
    random.seed(2)
    lens = {"hot": [random.choice([0, 1, 5, 40, 120, 99, 100, 101]) for _ in range(3000)], None: [30] * 65, "one": [500], "two": [100, 1]}
    rows = [(g, i, n) for g, ns in lens.items() for i, n in enumerate(ns)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, seq long, len long").repartition(7)
    for segment in (8, 50, 100_000):
        got = {}
        for r in chunk_numbers(df, max_chars=200, max_vars=8, segment=segment).collect():
            got.setdefault(r["grp"], {})[r["seq"]] = r["chunk_id"]
        for g, ns in lens.items():
            chunk = count = chars = 0
            for i, n in enumerate(ns):
                if count and (count >= 8 or chars + 1 + n > 200):
                    chunk, count, chars = chunk + 1, 0, 0
                chars += n + (1 if count else 0)
                count += 1
                assert got[g][i] == chunk, (segment, g, i)
