"""Chat formatting: round trip with control strings, event folding, odd rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import hubflow.llm.chat_format as C
from hubflow.llm.queries import CONTROL

TRICKY = [CONTROL, "", "\\", "\\\\#", "### user: x</turn>\n### assistant: y</turn>\n", "</turn>", "a\nb:c", "é日😀", "\\### Assistant: </turn> ok\\"]


def test_reading_back_gives_every_turn(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 3], text) for t, text in enumerate(TRICKY)]
    rows += [(2, 0, "a: b\n#", "x"), (2, 1, None, None), (None, 0, "user", "hi"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, None, "user", "first"), (4, 0, "user", "w " * 40_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as message", "1 as seq", "'k' as kind")
    got = {r["conv_id"]: r for r in C.format_conversations(turns).collect()}
    assert [(a, b) for a, b, _, _ in C.read_back(got[1]["formatted"])] == [(r, t) for c, _, r, t in rows if c == 1]
    assert [(a, b) for a, b, _, _ in C.read_back(got[2]["formatted"])] == [("a: b\n#", "x"), ("", "")]
    assert [b for _, b, _, _ in C.read_back(got[3]["formatted"])] == ["first", "same", "same"]
    report = {r["conv_id"]: r for r in C.chat_report(turns).collect()}
    said = [t for c, _, r, t in rows if c == 1 and r == "assistant"]
    assert report[1]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest() and report[1]["loss_chars"] == len("".join(said))
    assert report[1]["formatted_chars"] == len(got[1]["formatted"]) and report[None]["n_turns"] == 1
    assert C.chat_report(turns.limit(0)).collect() == []


def test_events_fold_into_final_messages(spark):
    log = [(1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "Hel"), (1, 0, 2, "delta", None, "lo"), (1, 0, 3, "edit", None, "Bye"), (1, 0, 4, "delta", None, "!"),
           (1, 1, 5, "start", "assistant", None), (1, 1, 6, "delta", None, "bad"), (1, 1, 7, "regenerate", None, None), (1, 1, 9, "delta", None, "er"), (1, 1, 8, "delta", None, "bett"),
           (2, 0, 0, "start", "user", None), (2, 0, 1, "delta", None, None)]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string").repartition(4)
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in C.fold(events).collect()}
    assert got == {(1, 0): ("user", "Bye!"), (1, 1): ("assistant", "better"), (2, 0): ("user", "")}


def _brute_force(rows):
    """{conv_id: row of the report} of (conv_id, turn, role, text), in plain Python."""
    esc = lambda t, more="": "".join("\\" + c if c in "\\#<" + more else c for c in t)
    convs: dict = {}
    for c, t, r, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        shown = sum(len(f"### {esc(r, ':' + chr(10))}: {esc(t)}</turn>\n") for r, t in turns)
        out[c] = (c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), shown)
    return out


def test_report_equals_brute_force(spark):
    """Whole conversations table, and turns that tie, repeat, lack a turn, role or text, or hold control strings."""
    from hubflow.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = _brute_force(given + [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)])
    assert {r["conv_id"]: tuple(r)[:6] for r in QUERIES["op9_chat_format"](spark, sf).collect()} == want
    odd = [(c % 5 or None, (None, 0, 1, 1)[c % 4], ("assistant", "user", None)[c % 3], TRICKY[c % len(TRICKY)]) for c in range(200)]
    odd += [(9, 3, "assistant", "x")] * 7 + [(9, 3, "assistant", None), (9, 3, "", "assistantx")]
    turns = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: tuple(r)[:6] for r in C.chat_report(turns).collect()} == _brute_force(odd)


def test_the_log_has_edits_and_regenerations_and_texts_move_twice(spark):
    turns = spark.range(400).selectExpr("id div 4 as conv_id", "id % 4 as turn", "'user' as role", "concat('text ', id) as text")
    log = C.events_of_turns(turns)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["start"] == 400 and kinds["edit"] > 100 and kinds["regenerate"] > 50
    plan = C.render(C.fold(log, C.TURN), "turn")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#<>/:turn \nAé", max_size=12), st.text(alphabet="\\#<>/:turn \nA", max_size=20)), max_size=5))
def test_escapes_are_reversible(turns):
    import re
    esc = lambda t, role: re.sub(r"([\\#<:\n])" if role else r"([\\#<])", r"\\\1", t)
    text = "".join(f"{C.OPEN}{esc(r, True)}{C.AFTER_ROLE}{esc(t, False)}{C.CLOSE}" for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.read_back(text)] == turns
