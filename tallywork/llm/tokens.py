"""Token counts and token ids of whole texts, exactly as the tokenizers library gives them.

A text is cut at safe boundaries, places where no tokenizer step can look across: before
white space that is followed by something else, around a single line break, between a letter and plain
punctuation, and behind the full stops of scripts without spaces. Equal pieces of a byte-balanced block
are encoded once, and a worker remembers pieces, so long texts cost no more per byte than short ones. What is
remembered is bounded by bytes; at the bound, pieces that were not met again are forgotten.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.text import blocks, bound_batches, flat, per_row, released, slices

REMEMBERED_BYTES = 32 << 20  # of pieces and ids in a worker
ENCODED_BYTES = 4 << 20  # of text cut and encoded at once


def _bytes(*values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


# Letters; marks that may start a piece behind a letter, none of which occurs behind a letter in a
# special token; single bytes, and first bytes of UTF-8 sequences, that can't be white space or combine
# with what stands before them.
LETTER = _bytes(*range(0x41, 0x5B), *range(0x61, 0x7B))
MARKS = ".,;:!?#$%&()*+/=@[]^_`{}~\"-"
POINT = _bytes(*map(ord, MARKS))
VISIBLE = LETTER | _bytes(*range(0x30, 0x3A), *map(ord, MARKS + "<>|"))
LEADS = (0xC3, 0xCE, 0xCF, 0xD0, 0xD1, *range(0xE4, 0xEA), 0xEB, 0xEC)
PLAIN = VISIBLE | _bytes(*LEADS)
# First byte of a sequence -> second bytes with which it is such a character.
PLAIN_PAIRS = {0xD7: (0x90, 0xAA), 0xD8: (0xA1, 0xBA), 0xD9: (0x81, 0x8A), 0xE3: (0x81, 0x81)}
# Sequences of two bytes that are letters: first byte -> range of second bytes, and those left out.
LETTER_PAIRS = {
    0xC3: (0x80, 0xBF, (0x97, 0xB7)),
    0xCE: (0x91, 0xBF, (0xA2,)),
    0xCF: (0x80, 0xB5, ()),
    0xD0: (0x80, 0xBF, ()),
    0xD1: (0x80, 0xBF, ()),
}
# Comma and full stops of Chinese and Japanese.
STOPS = (b"\xe3\x80\x81", b"\xe3\x80\x82", b"\xef\xbc\x8c", b"\xef\xbc\x81", b"\xef\xbc\x9f")
IDEOGRAPH = _bytes(*range(0xE4, 0xEA))


def _starts_plainly(part: np.ndarray) -> np.ndarray:
    """Where a character begins that is surely visible and stands for itself."""
    plain = PLAIN[part]
    for first, (low, high) in PLAIN_PAIRS.items():
        at = np.flatnonzero(part[:-1] == first)
        plain[at] = (part[at + 1] >= low) & (part[at + 1] <= high)
    return plain


def _ends_letter(part: np.ndarray) -> np.ndarray:
    """Where a letter surely ends."""
    letter = LETTER[part]
    for first, (low, high, without) in LETTER_PAIRS.items():
        at = np.flatnonzero(part[:-1] == first) + 1
        second = part[at]
        letter[at] = (second >= low) & (second <= high) & ~np.isin(second, without)
    letter[_ideographs(part) + 2] = True
    return letter


def _ideographs(part: np.ndarray) -> np.ndarray:
    """Where ideographs begin, U+4E00 to U+9FBF."""
    at = np.flatnonzero(IDEOGRAPH[part[:-2]])
    first, second = part[at], part[at + 1]
    return at[((first != 0xE4) | (second >= 0xB8)) & ((first != 0xE9) | (second <= 0xBE))]


def safe_starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Which bytes of ``data[begin:end]`` may start a piece of their own.

    A space may when a character follows that is surely not white space; a line break between two
    such characters may, and so may what follows it; a mark may behind a letter, an ideograph behind a stop.
    """
    part = data[begin:end]
    cut = np.zeros(len(part), bool)
    if len(part) < 2:
        return cut
    plain = _starts_plainly(part)
    cut[:-1] = (part[:-1] == 0x20) & plain[1:]
    cut[1:] |= POINT[part[1:]] & _ends_letter(part)[:-1]
    line = np.flatnonzero((part[1:-1] == 0x0A) & VISIBLE[part[:-2]] & plain[2:]) + 1
    cut[line] = True
    cut[line + 1] = True
    wide = _ideographs(part)
    wide = wide[wide >= 3]
    if len(wide):
        last = np.stack([part[wide - 3], part[wide - 2], part[wide - 1]], axis=1)
        stops = np.frombuffer(b"".join(STOPS), np.uint8).reshape(-1, 3)
        cut[wide[(last[:, None, :] == stops[None]).all(axis=2).any(axis=1)]] = True
    return cut


class Encoder:
    """A tokenizer and the pieces it has encoded: piece -> number -> run in one id array."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        special = [t["content"].encode() for t in rules["added_tokens"]]
        # A token that holds a space, or a boundary, could be cut in two.
        self.cuttable = not any(
            b" " in s or b"\n" in s or safe_starts(np.frombuffer(s, np.uint8), 0, len(s)).any() for s in special
        )
        # Where the tokenizer lower-cases, pieces that differ in A-Z only are one.
        steps = rules.get("normalizer") or {}
        steps = steps.get("normalizers", [steps])
        self.lowers = any(step.get("type") == "Lowercase" for step in steps)
        self.remembered = remembered
        self.pieces = pa.array([], pa.string())
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.met = np.zeros(0, bool)  # whether a piece was met again

    def size(self) -> int:
        """Bytes of what is remembered."""
        return self.pieces.nbytes + 4 * int(self.at[-1]) + 9 * len(self.pieces)

    def forget(self) -> None:
        """Forget the pieces that were not met since the last time; all, where that is not half of the bound."""
        kept = np.flatnonzero(self.met)
        lengths = np.diff(self.at)[kept]
        at = np.append(0, np.cumsum(lengths))
        place = np.repeat(self.at[kept] - at[:-1], lengths) + np.arange(at[-1])
        self.pieces = self.pieces.take(pa.array(kept))
        self.ids = np.append(self.ids[place], np.zeros(1 << 16, np.uint32))
        self.at = at
        self.met = np.zeros(len(kept), bool)
        if 2 * self.size() > self.remembered:
            self.forget()

    def numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """The number of each of the ``pieces``, encoding the new ones."""
        if self.size() > self.remembered:
            self.forget()
        if self.lowers:
            # A special token in other letters would become one.
            pieces = pc.if_else(pc.match_substring(pieces, "<"), pieces, pc.ascii_lower(pieces))
        found = pc.index_in(pieces, value_set=self.pieces)
        numbers = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        is_new = numbers < 0
        self.met[numbers[~is_new]] = True
        if is_new.any():
            new = pieces.filter(pa.array(is_new)).dictionary_encode()
            texts = new.dictionary.to_pylist()
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            first = int(self.at[-1])
            ends = first + np.cumsum(lengths)
            if ends[-1] > len(self.ids):
                self.ids = np.resize(self.ids, int(ends[-1] * 1.25) + 1)
            self.ids[first : ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1] - first))
            numbers[is_new] = len(self.pieces) + new.indices.to_numpy(zero_copy_only=False)
            self.pieces = pa.concat_arrays([self.pieces, new.dictionary])
            self.at = np.append(self.at, ends)
            self.met = np.append(self.met, np.zeros(len(got), bool))
        return numbers

    def block(self, data: np.ndarray, buffer: pa.Buffer, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows that are contiguous in ``data``: where each row's pieces begin, and the pieces' numbers."""
        begin, end = int(offsets[0]), int(offsets[-1])
        if begin == end:
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        cut = safe_starts(data, begin, end) if self.cuttable else np.zeros(end - begin, bool)
        rows = offsets[:-1]
        cut[rows[rows < end] - begin] = True
        starts = np.flatnonzero(cut) + begin
        coded = slices(data, buffer, starts, end).dictionary_encode()
        numbers = self.numbers(coded.dictionary.cast(pa.string()))
        return per_row(starts, offsets), numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row; no ids are put together."""
        data, offsets, buffer = flat(column)
        out = np.zeros(len(column), np.int64)
        for i, j in blocks(offsets, ENCODED_BYTES):
            rows, numbers = self.block(data, buffer, offsets[i : j + 1])
            total = np.append(0, np.cumsum(np.diff(self.at)[numbers]))
            out[i:j] = total[rows[1:]] - total[rows[:-1]]
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows ``i:j``: ``(i, j, ids, ends)``, the ids of all rows and each row's end."""
        data, offsets, buffer = flat(column)
        for i, j in blocks(offsets, ENCODED_BYTES):
            rows, numbers = self.block(data, buffer, offsets[i : j + 1])
            lengths = np.diff(self.at)[numbers]
            total = np.append(0, np.cumsum(lengths))
            place = np.repeat(self.at[numbers] - total[:-1], lengths) + np.arange(total[-1])
            yield i, j, self.ids[place], total[rows[1:]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = encoder(path).counts(batch.column("text"))
        _, offsets, _ = flat(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )
        released()


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, in one narrow pass.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give
    repeated results; an empty table gives no rows. Columns beside the two named are ignored.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        partial(_count, path=path, limit=limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
