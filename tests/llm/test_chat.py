"""Loss mask, long roles and the encoder of chat formatting."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm.chat import CALL, ChatEncoder, format_conversations, read_back

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def test_long_roles_and_texts(spark):
    plain = "r" * 1_000_000
    mixed = "\\n<[\n\\\\x" * 120_000
    rows = [(1, 0, plain, "t"), (2, 0, mixed, "\n\\"), (3, 0, "assistant", "\\<[" * 300_000), (4, 0, "a" * 3000 + "\n" + "b" * 3000, None)]
    nodes, turns = format_conversations(spark.createDataFrame(rows, SCHEMA), BYTE_BPE)
    got = {r.conv: (r.turns[0].role, r.turns[0].text, r.turns[0].loss) for r in read_back(nodes, turns).collect()}
    assert got == {c: (role, text or "", text if role == "assistant" else "") for c, _, role, text in rows}


def test_mask_covers_the_assistants_texts_and_nothing_else(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = []
    for conv in range(30):
        for turn in range(4):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["", "x", "one [two] <three>\\", "é🙂 ", " [/INST]", None])))
    nodes, turns = format_conversations(spark.createDataFrame(rows, SCHEMA), BYTE_BPE)
    told = {r.conv: "".join(t.loss for t in r.turns) for r in read_back(nodes, turns).collect()}
    assert told == {c: "".join(text or "" for conv, _, role, text in rows if conv == c and role == "assistant") for c in range(30)}
    known = Tokenizer.from_file(BYTE_BPE)
    learned = 0
    for node in nodes.collect():
        assert known.decode(node.ids, skip_special_tokens=False) == node.formatted
        assert (node.learned is None) == (node.masked is None) == (not node.formatted.startswith("<s>[INST] assistant\n"))
        if node.learned:
            learned += 1
            masked = known.decode(node.ids[node.masked.low : node.masked.high], skip_special_tokens=False)
            assert masked == node.formatted[node.learned.low : node.learned.high]
    assert learned > 20


def test_texts_longer_than_a_call_have_the_same_tokens():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "Beta,", "1234", "é", "x.y", "\n\n", "  gap"]) for _ in range(CALL // 2))
    assert len(text) > 2 * CALL
    encoder = ChatEncoder(BYTE_BPE)
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    texts = ["", text, "short", text[:500]]
    assert encoder.seams
    assert [x.tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
