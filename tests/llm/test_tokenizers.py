"""Packing asks any tokenizer rightly: by chunks where that gives its own ids, else by whole texts."""

import numpy as np
import pytest
import public_tokenizers
from pathlib import Path

from newsloom.llm import packing

TEXTS = ["", "Hello World. It's 3 o'clock, said  she\n\nTwo\tlines", " lead", "trail ", "ÉCOLE, straße. ıx", "a.b, c. d.", "日本語 x", "MiXeD CaSe  words\r\nnext"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(name):
    encoder = packing.Encoder(Path(public_tokenizers.path(name)).read_text(encoding="utf-8"))
    assert encoder.by_chunks == (name == "word_bpe_49k.json")
    for ids, text in zip(encoder.encode(TEXTS), TEXTS, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
