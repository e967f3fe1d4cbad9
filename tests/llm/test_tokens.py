"""The word encoder gives exactly the tokenizer's ids."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm.tokens import WordEncoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_mixed_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, encoder = Tokenizer.from_file(path), WordEncoder(path)
    rng = random.Random(1)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    bits = ["alpha", "Élan", "straße", "x", "don't", "it's", "I'LL", "''", "12", "3.14", "1,000", "...", "?!", "$$$", "a*b", "c++", "e.g.", "end.", ",,", "http://x.y/z?q=1&r=2", "[INST]",
            "naïve", "é", "日本", "🙂", " ", "ŉ", "İ", "ǅ", "½", "²", "_id_", "#!", "<|", "|>", "`~", "\\n", *added, *(t.upper() for t in added)]
    texts = ["", " ", "\n\n"]
    for _ in range(1500):
        texts.append("".join(rng.choice(bits) + rng.choice(["", "", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(12))))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]
