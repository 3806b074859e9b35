"""The cached encoder against the library's own encoding of the whole text."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ctxpress.llm.encode import Encoder, tokenizer_path

_PARTS = (
    "the", "house", "don't", "I'll", "x", "Été", "naïve", "straße", "ʯ", "漢字", "нет", "👍🏽", "é", " ", " ", "　", "\x85", "\x1c",
    "\n", "\n\n", "\r\n", "\t", " ", "  ", "   ", ".", ",", ";:", "?!", "...", "12", "3.5", "1,000", "<|endoftext|>", "</s>", "'s", "'", "_a_", "\x00", "a" * 70,
)


@pytest.mark.parametrize("cache", [0, 7, 300_000])
def test_hostile_texts(cache):
    """Whatever is or is not kept in the dictionaries, ids equal those of the library; each text is encoded twice."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), cache), random.Random(5)
    texts = ["", " ", "a ", " a", "a  b", *("".join(rng.choice(_PARTS) + rng.choice(("", " ", " ")) for _ in range(rng.randint(1, 12))) for _ in range(4000))]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
