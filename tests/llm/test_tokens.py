"""Token counts and ids of texts in many scripts against the library itself, and what a worker remembers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywork.llm import tokens
from tallywork.llm.queries import vocabulary
from tallywork.llm.text import flat

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = (
    "the The THE an don't I'll x1 12 é ê. ü, ß- ô× ÷ Привет мир, До свидания. Ελλάδα; ΆΈ ά· שלום עולם. مرحبا، بكم "
    "你好。 世界， 你好！ こんにちは。カタカナ が か゛ が 한국어 각 각 é é. ́ a̸ ≠ ≮ <|endoftext|> <|ENDOFTEXT|> "
    "<|startoftext|>a <|endof text|> |> ### %%% a### a_b a-b a/b (a) [b] {c} \"q\"     　 \x0b \r\n \n\n \n a\nb é\nñ .\nX ½ ² ١٢ 🙂 a🙂 İ ſ ŉ ﬁ"
)


def direct(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def strings():
    rng = random.Random(7)
    parts = PARTS.split(" ") + [" ", "  ", "\n", "\t", "", " \n", "\n ", " ", " ", " "]
    letters = sorted(set(PARTS))
    out = ["", " ", "\n", PARTS]
    out += ["".join(rng.choice(parts) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_many_scripts(name):
    encoder = tokens.Encoder(vocabulary(name), remembered=1 << 16)
    column = pa.array(strings())
    counts = encoder.counts(column).tolist()
    for i, j, ids, ends in encoder.texts(column):
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            want = direct(encoder.tokenizer, column[i + k].as_py())
            assert ids[a:b].tolist() == want, repr(column[i + k].as_py())
            assert counts[i + k] == len(want)


@pytest.mark.parametrize("line", ["Привет мир, как дела? ", "你好世界。", "שלום עולם. ", "العالم كبير ", "Ελλάδα, είναι "])
def test_texts_of_other_scripts_are_cut(line):
    data, offsets, _ = flat(pa.array([line * 2000]))
    assert tokens.safe_starts(data, 0, int(offsets[-1])).sum() >= 1999


def test_what_is_met_again_is_remembered_within_the_bound():
    encoder = tokens.Encoder(vocabulary(NAMES[0]), remembered=40_000)
    common = pa.array([f" w{k}" for k in range(100)])
    encoder.numbers(common)
    for turn in range(40):
        encoder.numbers(common)
        encoder.numbers(pa.array([f" new{turn}x{k}" for k in range(100)]))
        assert encoder.size() <= 40_000 + 100 * 80
    encoder.forget()
    assert set(encoder.pieces.to_pylist()) == set(common.to_pylist())
    ids = [encoder.ids[encoder.at[k] : encoder.at[k + 1]].tolist() for k in encoder.numbers(common)]
    assert ids == [direct(Tokenizer.from_file(vocabulary(NAMES[0])), p) for p in common.to_pylist()]
    encoder.forget()
    encoder.forget()
    assert not len(encoder.pieces) and len(encoder.at) == 1


def test_empty_pieces_and_numbers():
    encoder = tokens.Encoder(vocabulary(NAMES[1]))
    assert encoder.numbers(pa.array([], pa.string())).tolist() == []
    assert len(np.unique(encoder.numbers(pa.array([" a", " b", " a"])))) == 2
