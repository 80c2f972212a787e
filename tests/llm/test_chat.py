import hashlib
from collections import defaultdict

import pytest

from spindrift.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\s>", "<\\s>", "a</s", "<", "[INST", "", None, "é日本\n\\n", "<s><s>[/INST]\\[INST]", "x" * 70_000]


def turns():
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], NASTY[(c * 5 + t) % len(NASTY)], "x") for c in range(40) for t in range(c % 7)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}", "y") for t in range(3000)]
    return rows + [(7, 0, "user", "again", "z"), (7, 0, "user", "again", "z"), (8, None, "assistant", "no turn", "z"), (None, 1, "assistant", "no conversation", "z")]


def brute(rows):
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, v in by.items():
        v.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x for *_, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [8192, 7])
def test_round_trip(spark, part):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(df, part_turns=part)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == brute(turns())
    whole = defaultdict(dict)
    for r in chats.collect():
        assert r.part not in whole[r.conv_id]
        whole[r.conv_id][r.part] = r.formatted
        for c in chat.CONTROL:  # none but the template's own
            assert r.formatted.count(c) == r.formatted.count("<s>[INST]")
    assert all(sorted(v) == list(range(len(v))) for v in whole.values()) and (part > 7 or len(whole[500]) > 100)


def test_escape_is_reversible():
    import pyarrow as pa

    texts = [t or "" for t in NASTY]
    for before, after in zip(texts, chat.escape(pa.array(texts)).to_pylist()):
        assert not any(c in after for c in chat.CONTROL)
        assert chat.unescape(after.encode()).decode() == before


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(df)).count() == 0


def test_null_roles_can_be_learned(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 1, None, "bé", 2), (1, 2, "", "c", 3)], "conv_id long, turn long, role string, text string, part long")
    got = chat.digests(chat.format_chats(df, learn_role="")).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3, 3, hashlib.sha256("béc".encode()).hexdigest())
