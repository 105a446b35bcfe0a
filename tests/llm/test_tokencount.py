import pytest
from helpers import SF, docs, read
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from hearth.llm.tokencount import MARK, VOCABULARY, Counter, load_vocabulary, op10_token_counts, token_counts

SMALL = [("<unk>", 0.0), (MARK, -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), (MARK + "a", -5.0), ("aba", -6.0), ("zz", -1.0), ("c", -9.0)]
BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
SPANNING = [*SMALL, ("a" + MARK + "b", -1.0)]


def reference(vocabulary, text):
    t = Tokenizer(models.Unigram(vocabulary, 0, any(p == "<0x00>" for p, _ in vocabulary)))
    marked = text.replace(" ", MARK)
    return len(t.encode(marked if marked[0] == MARK else MARK + marked, add_special_tokens=False).ids) if text else 0


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(VOCABULARY)


def test_query_matches_the_tokenizer(spark, vocabulary):
    d = read("documents").set_index("doc_id")
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    got = op10_token_counts(spark, SF).toPandas()
    assert len(got) == len(d)
    for r in got.itertuples():
        text = d.text[r.doc_id].replace(" ", MARK)
        assert r.tokens == len(t.encode(text if text[0] == MARK else MARK + text, add_special_tokens=False).ids)


@pytest.mark.parametrize("pieces", [SMALL, SMALL + BYTES, SPANNING, SPANNING + BYTES])
def test_ties_unknowns_and_pieces_across_words(pieces):
    counter = Counter(pieces)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abcz é中 " + MARK), max_size=14))
    def same(text):
        assert counter.count(text)[0] == reference(pieces, text)
    same()


def test_unknown_piece_in_a_text(vocabulary):
    counter = Counter(vocabulary)
    for text in ("a <unk> b", "<unk><unk>", "zሴ<unk>é", "  two  spaces ", "\x00\n\t", "<s> <0x0A>"):
        assert counter.count(text)[0] == reference(vocabulary, text)


def test_memo_is_bounded():
    counter = Counter(SMALL, memo=3)
    for text in ("a", "b", "ab", "ba", "aba", "a b ab ba aba"):
        assert counter.count(text)[0] == reference(SMALL, text)
    assert len(counter.memo) <= 3


def test_edges(spark, vocabulary):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, " "), (4, "y" * 200_000)]
    got = token_counts(docs(spark, rows).withColumn("tokens", F.lit("x")), vocabulary).collect()
    assert [r["tokens"] for r in got[:2]] == [0, 0] and got[2] == got[3] and got[4]["tokens"] == 1 and got[4]["doc_id"] is None and got[5]["tokens"] > 0
    assert token_counts(docs(spark, []), vocabulary).count() == 0
