from zlib import crc32

from helpers import docs, read
from pyspark.sql import functions as F

from hearth.llm.langid import identify, learn_dictionaries, op6_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d = read("documents", SF).set_index("doc_id")
    got = op6_language_id(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(d) and got.score.between(0, 1).all()
    assert (got.held_out == [crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    out = got[got.held_out]
    assert (out.lang_pred == d.lang[out.index]).mean() > 0.95
    rejected = got.rejected & got.held_out
    sure = out[~out.rejected]
    assert (sure.lang_pred == d.lang[sure.index]).mean() >= (out.lang_pred == d.lang[out.index]).mean() and rejected.mean() < 0.2


def test_edges(spark):
    learned = learn_dictionaries(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {k for k, _ in learned} == {"en", "fr", "de", "es"} and all(len(c) <= 65536 for _, c in learned)
    rows = [(1, None), (2, ""), (3, " 12 !! \t"), (4, "the"), (4, "the"), (None, "x" * 300_000)]
    got = identify(docs(spark, rows).withColumn("lang_pred", F.lit(1)), learned).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and all(r["rejected"] and r["score"] == 0 for r in got[:3])
    assert len(got) == 6 and got[3] == got[4] and got[5]["lang_pred"] in {"en", "fr", "de", "es"}
    assert identify(docs(spark, []), learned).count() == 0
    assert learn_dictionaries(docs(spark, [])) == []
    assert identify(docs(spark, [(1, "word")]), []).first()["lang_pred"] == "und"


def test_identify_against_plain_compression(spark):
    """Each block compressed with each language's dictionary, by a plain loop."""
    import zstandard
    from hearth.llm.langid import BLOCK, clean
    learned = learn_dictionaries(spark.read.parquet(f"{SF}/documents.parquet"))
    tools = {}
    for name, content in learned:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=zstandard.ZstdCompressionParameters.from_level(
            6, write_content_size=False, write_checksum=False, write_dict_id=False))
    d = read("documents").head(60)
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(d[["doc_id", "text"]]), learned).collect()}
    for i, text in zip(d.doc_id, d.text):
        letters = clean(text or "")
        if not letters:
            assert got[i]["lang_pred"] == "und"
            continue
        sizes = [(sum(len(c.compress(letters[a:a + BLOCK].encode())) for a in range(0, len(letters), BLOCK)), k) for k, (_, c) in enumerate(tools.items())]
        (low, k), (second, _) = sorted(sizes)[:2]
        assert got[i]["lang_pred"] == learned[k][0] and abs(got[i]["margin"] - (second - low) / low) < 1e-12


def test_languages_without_usable_text_and_hidden_letters(spark):
    rows = [(i, f"der hund und die katze {i} gehen aus dem haus") for i in range(30)]
    late = "1234567890 " * 15_000 + "qwxyz kjhgf " * 50     # letters come after 165,000 other characters
    d = docs(spark, rows).withColumn("lang", F.lit("de"))
    more = docs(spark, [(100, late), (101, "!!! 12"), (102, ""), (103, None)]).withColumn(
        "lang", F.when(F.col("doc_id") == 100, "xx").otherwise("none"))
    learned = dict(learn_dictionaries(d.unionByName(more)))
    assert set(learned) == {"de", "xx"} and b"qwxyz" in learned["xx"] and all(learned.values())
    got = identify(docs(spark, [(1, "qwxyz kjhgf qwxyz"), (2, "die katze und der hund")]), list(learned.items())).collect()
    assert [r["lang_pred"] for r in got] == ["xx", "de"]


def test_one_text_gives_a_share_and_every_language_is_learned(spark):
    big = "mono " * 50_000
    rows = [(0, big), *[(0, big)] * 5, *[(i, f"word{i} other{i} thing{i} " * 40) for i in range(1, 60)]]
    d = docs(spark, rows).withColumn("lang", F.lit("aa"))
    for i in range(300):
        rows.append((1000 + i, f"lang{chr(97 + i % 26)}{chr(97 + i // 26)} speaks so"))
    names = spark.createDataFrame([(1000 + i, rows[-300 + i][1], f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    learned = dict(learn_dictionaries(d.select("doc_id", "text", "lang").unionByName(names), dictionary_bytes=4096))
    assert len(learned) == 301 and next(iter(learned)) == "aa"
    assert learned["aa"][:3500].count(b"mono") <= 4096 // 8 // 5 + 1 and b"word" in learned["aa"]
