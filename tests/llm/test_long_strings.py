"""Strings that a polynomial hash modulo 2**64 confuses, and secrets of any length."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm import pseudonyms
from siltstone.llm.kernel import slabs
from siltstone.llm.tokens import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_thue_morse_strings_have_ids_hashes_and_lines_of_their_own(n):
    a, b = "x" * 8 + thue_morse(n, "ab"), "x" * 8 + thue_morse(n, "ba")
    plain = Tokenizer.from_file(BPE)
    encoder = Encoder(BPE)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([a, b, f"{b} {a}"])] == [plain.encode(t, add_special_tokens=False).ids for t in (a, b, f"{b} {a}")]
    (s,) = slabs(pa.array([f"{a}\n{b}\n{a}", f"{b} {a}"]))
    assert s.lines[3].tolist() == [False, False, True, False]
    h = s.word_hash
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


@pytest.mark.parametrize("n", [511, 513, 4000, 1_000_000])
def test_long_secrets(n):
    key = b"k" * 32
    value = ("aB3-" * (n // 4 + 1))[:n]
    out = pseudonyms.letters(value, key, "secret")
    assert len(out) == n and out != value and out == pseudonyms.letters(value, key, "secret")
    assert all((x.isdigit(), x.isupper(), x.islower()) == (y.isdigit(), y.isupper(), y.islower()) for x, y in zip(value[:2000], out))
    assert pseudonyms.letters(out, key, "secret", back=True) == value
