import hashlib

from hypothesis import given
from hypothesis import strategies as st

from issuelens.llm import chat

EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"
awkward = st.lists(st.sampled_from([*chat.CONTROL, "\\", "|", "n", "\\|", "<", "[", "\n", "é", ""]), max_size=8).map("".join)


@given(awkward)
def test_escaping_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(awkward, awkward)
def test_pieces_read_back(role, text):
    piece = chat.START + chat.escape(role).replace("\n", "\\n") + "\n" + chat.escape(text) + chat.END
    assert chat.parse(piece) == (role, text)


def messages(spark, rows):
    pieces = chat.render(spark.createDataFrame(rows, EVENT)).collect()
    return [(p.conv_id, p.position, *chat.parse(p.formatted)) for p in sorted(pieces, key=lambda p: (p.conv_id or 0, p.position))]


def test_deltas_edits_and_regenerations_fold(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"),
            (1, 2, 3, "message", "user", "again?"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "New"),
            (1, 2, 6, "message", "user", "fine"), (1, 0, 7, "edit", None, "hi there"), (1, 0, 8, "delta", None, "!")]
    assert messages(spark, rows) == [(1, 0, "user", "hi there!"), (1, 1, "assistant", "New"), (1, 2, "user", "fine")]


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, 0, "message", None, None), (1, 1, 1, "message", "b", "2"), (1, 1, 1, "message", "a", "1"),
            (1, 1, 1, "message", "a", "1"), (None, None, None, "message", "u", "x" * 200_000)]
    assert messages(spark, rows) == [(None, 0, "u", "x" * 200_000), (1, 0, "", ""), (1, 1, "a", "1"), (1, 2, "a", "1"), (1, 3, "b", "2")]
    assert messages(spark, []) == []


def test_query_reads_back_the_probe(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    probe = got[-1]
    said = "".join(f"{r}\n{chat.PROBE}\n" for r in ("user", "assistant"))
    assert probe.n_turns == 2 and probe.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert probe.loss_chars == len(chat.PROBE) and probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert probe.formatted_chars > len(said)
