import duckdb
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm.chat import OP8_SQL, digest_conversations, format_conversations, format_messages, op8_chat_formatting, parse_turns, turn_template

TEXT = st.text(alphabet=st.sampled_from("ab\\<>/ turn\n\x01é"), max_size=12)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(OP8_SQL)
    got = op8_chat_formatting(spark, SF).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
    assert any(r["conv_id"] == -7 and r["loss_chars"] == 26 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x>"]), TEXT), max_size=12), st.integers(2, 6))
def test_round_trip_and_loss_spans(messages, window):
    got = format_messages(messages, window=window)
    assert got["formatted"] == turn_template(messages) and parse_turns(got["formatted"]) == messages and not got["rewrites"]
    cut = [got["formatted"][a:b] for a, b in got["spans"]]
    assert [parse_turns(f"<turn x>{c}</turn>\n")[0][1] for c in cut] == [t for r, t in messages if r == "assistant"]


def test_template_that_rewrites_history_is_detected():
    def forgetful(messages):  # drops the text of all earlier assistant turns
        return "".join(f"[{r}] {t if r != 'assistant' or i == len(messages) - 1 else ''}\n" for i, (r, t) in enumerate(messages))
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    got = format_messages(talk, forgetful)
    assert got["rewrites"] and got["spans"] == [] and got["formatted"] == forgetful(talk)
    opened = format_messages(talk, lambda m: "BEGIN\n" + "".join(f"{r}={t};" for r, t in m))
    assert [opened["formatted"][a:b] for a, b in opened["spans"]] == ["b", "d"] and not opened["rewrites"]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string, piece int"
    long = [(9, i, "assistant" if i % 2 else "user", f"<t{i}>", None, 1) for i in range(300)]
    rows = [(1, 1, "assistant", None, "x", 1), (1, 0, "user", "q", "x", 1), (1, 1, "assistant", None, "x", 1),
            (None, 0, None, "z" * 100_000, None, 1), (2, 0, "user", "", None, 1), *long]
    pieces = format_conversations(spark.createDataFrame(rows, schema))
    got = {r["conv_id"]: r for r in digest_conversations(pieces).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 0
    assert got[9]["n_turns"] == 300 and got[9]["loss_chars"] == sum(len(r[3]) for r in long if r[2] == "assistant")
    assert digest_conversations(format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_templates_that_look_beyond_the_window(spark):
    talk = [("assistant" if i % 2 else "user", f"t{i}") for i in range(71)]

    def numbered(messages):
        return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(messages))

    def led(messages):  # every turn names the first one
        return "".join(f"{r}: {t} <{messages[0][1]}>\n" for r, t in messages)

    def counted(messages):  # rewrites the first turn only once it has left the window
        return "".join(f"{r}: {t}{len(messages) if i == 0 and len(messages) > 40 else ''}\n" for i, (r, t) in enumerate(messages))

    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    for template in (numbered, led, counted):
        got = format_messages(talk, template)
        assert got["formatted"] == template(talk) and got["rewrites"] == (template is counted)
        cut = [got["formatted"][a:b] for a, b in got["spans"]]
        assert cut == ([] if template is counted else [t for r, t in talk if r == "assistant"])
        pieces = format_conversations(rows, template).orderBy("turn_no").collect()
        assert "".join(p["piece"] for p in pieces) == template(talk) and len(pieces) == 71
        assert {p["rewrites"] for p in pieces} == {template is counted}
        assert [p["piece"][p["loss_from"]:p["loss_to"]] for p in pieces if p["loss_from"] is not None] == cut
