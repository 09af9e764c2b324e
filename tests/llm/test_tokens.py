"""The encoder in use against the tokenizers library, on texts of any characters and with special tokens in them."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provender.llm import packing

PIECES = ["<|endoftext|>", "<|", "|>", "endoftext", " <|endoftext|> ", "<|endoftext|", "'s", "'LL", "<s>", "[PAD]", " ", "\n", "\t", "\r", " ", "　", "'"]


def text_of(rng):
    def sign():
        r = rng.random()
        if r < 0.3:
            return chr(rng.randint(32, 126))
        if r < 0.5:
            return rng.choice(PIECES)
        c = rng.randint(0, 0x10FFFF if r < 0.7 else 0x3000)
        return "" if 0xD800 <= c <= 0xDFFF else chr(c)

    return "".join(sign() for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("seed", range(4))
def test_same_ids(seed):
    rng = random.Random(seed)
    tokenizer, vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.vocabulary_path()
    for text in [*PIECES, "", *(text_of(rng) for _ in range(500))]:
        assert packing.ids_of(text, vocabulary).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)
