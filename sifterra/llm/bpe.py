"""Token ids of byte-level BPE for whole columns of texts.

Texts are cut at blanks that follow a non-blank, which no token reaches across.
The parts are looked up in a table of fixed size by their bytes, and only the
parts that it does not hold are encoded, all of a batch in one call.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import binaries, flat_bytes, mix, texts

#: Remembered parts, and most ids of one; a part of more than 15 bytes isn't remembered.
SLOTS, MOST_IDS, MOST_BYTES = 1 << 18, 6, 15
#: Bytes after which a blank begins a new part: those that end no blank of Unicode.
SOLID = np.zeros(256, bool)
SOLID[33:127] = SOLID[128:] = True
SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
#: Bytes of a text that are encoded at a time, and where a text may be cut.
PIECE, SAFE = 1 << 22, re.compile(rb"[!-~](?= )")
#: Low bytes of a word of eight.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0]``, ``starts[0] + 1``, ... for each run of ``sizes``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(text: pa.Array) -> Iterator[pa.Array]:
    """One text in pieces of ``PIECE`` bytes and a little more, so that memory doesn't follow its length."""
    raw, start = binaries(text)[0] or b"", 0
    while len(raw) - start > PIECE and (found := SAFE.search(raw, start + PIECE - 1)):
        yield pa.array([raw[start : found.end()]], pa.binary()).view(pa.string())
        start = found.end()
    yield pa.array([raw[start:]], pa.binary()).view(pa.string())


def _refused(error: BaseException) -> bool:
    """Whether the fast way doesn't take a text: broken UTF-8, and a few extreme texts on which the Rust side panics."""
    return type(error).__name__ in ("PanicException", "ValueError", "UnicodeDecodeError")


class Tokens:
    """Ids as the tokenizer file gives them (without special tokens put around), fast where ``ranks`` and ``pattern`` are given.

    ``pattern`` must be one whose tokens begin at every blank (U+0020) that follows a non-blank.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        self.file, self.fast = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=self.added)
            firsts = {i: raw[:1] for raw, i in table.items()}
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            self.width[list(table.values())] = [len(raw) for raw in table]
            self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
            self.size, self.ids = np.zeros(SLOTS, np.int64), np.zeros(SLOTS * MOST_IDS, np.uint32)
        else:
            # byte-level BPE writes the bytes 0 to 32 and 127 as U+0100 to U+0121: a blank is a letter to isalnum()
            firsts = {i: b" " if "Ā" <= token[0] <= "ġ" else token[0].encode() for token, i in self.slow.get_vocab().items()}
        firsts |= {i: token[:1].encode() for token, i in self.added.items()}
        self.begins = np.zeros(max(firsts) + 1, bool)
        self.begins[[i for i, b in firsts.items() if b < b"\x80" and not b.isalnum()]] = True

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    @cached_property
    def literal(self):
        """The same for texts whose control strings are text."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.file)
        made.encode_special_tokens = True
        return made

    def encode_literal(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of added tokens stand for themselves."""
        if self.fast is not None:
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as error:
                if not _refused(error):
                    raise
        return np.array(self.literal.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_rows(pa.array([text], pa.string()))[0]

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _row(self, text: pa.Array) -> np.ndarray:
        """Ids of one text without added tokens."""
        ids = [np.zeros(0, np.uint32)]
        for piece in _pieces(text):
            try:
                ids.append(self._parts(piece)[0])
            except BaseException as error:
                if not _refused(error):
                    raise
                ids.append(self._one(next(texts(piece))))
        return np.concatenate(ids)

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and the first id of each row (one more at the end); NULL is empty."""
        plain = np.full(len(column), self.fast is not None)
        for token in self.added:
            plain &= ~pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if plain.all() and (pc.max(pc.binary_length(column)).as_py() or 0) <= PIECE:
            try:
                return self._parts(column)
            except BaseException as error:
                if not _refused(error):
                    raise
        rows = [self._row(column.slice(i, 1)) if ok else self._one(next(texts(column.slice(i, 1)))) for i, ok in enumerate(plain.tolist())]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])

    def _parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = flat_bytes(column)
        n = len(data)
        solid = SOLID[data]
        solid[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut = np.zeros(n, bool)
        cut[1:] = (data[1:] == 32) & solid[:-1]
        cut[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        length = np.diff(np.append(starts, n))
        words = np.ndarray(n + 9, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        first = words[starts] & MASKS[np.minimum(length, 8)]
        second = words[np.minimum(starts + 8, n)] & MASKS[np.clip(length - 8, 0, 7)] | (np.minimum(length, 255).astype(np.uint64) << np.uint64(56))
        slot = (mix(first ^ mix(second, 7), 8) & np.uint64(SLOTS - 1)).astype(np.int64)
        short = length <= MOST_BYTES
        hit = short & (self.first[slot] == first) & (self.second[slot] == second)
        size = np.where(hit, self.size[slot], 0)
        # parts that begin with a blank and end with a non-blank can stand one after another
        ends = starts + length - 1
        missed = ~hit
        joined = np.flatnonzero(missed & (data[starts] == 32) & solid[ends])
        alone = np.flatnonzero(missed & ~((data[starts] == 32) & solid[ends]))
        raw = data[spread(starts[joined], length[joined])].tobytes().decode()
        together = self.fast.encode_to_numpy(raw, disallowed_special=()) if raw else np.zeros(0, np.uint32)
        reached = np.concatenate([[0], np.cumsum(self.width[together])])
        stops = np.cumsum(length[joined])
        last = np.searchsorted(reached, stops)
        if not np.array_equal(reached[last], stops):
            raise ValueError("a token reaches across a blank")
        size[joined] = np.diff(last, prepend=0)
        single = [self.fast.encode_to_numpy(data[a : a + b].tobytes().decode(), disallowed_special=()) for a, b in zip(starts[alone].tolist(), length[alone].tolist(), strict=True)]
        size[alone] = [len(x) for x in single]
        place = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(place[-1], np.uint32)
        out[spread(place[:-1][hit], size[hit])] = self.ids[spread(slot[hit] * MOST_IDS, size[hit])]
        out[spread(place[joined], size[joined])] = together
        if single:
            out[spread(place[alone], size[alone])] = np.concatenate(single)
        # what was found just now keeps its place: rare parts don't drive out common ones
        held = np.zeros(SLOTS, bool)
        held[slot[hit]] = True
        fresh = np.flatnonzero(missed & short & (size <= MOST_IDS) & ~held[slot])
        fresh = fresh[np.unique(slot[fresh], return_index=True)[1]]
        self.first[slot[fresh]], self.second[slot[fresh]], self.size[slot[fresh]] = first[fresh], second[fresh], size[fresh]
        self.ids[spread(slot[fresh] * MOST_IDS, size[fresh])] = out[spread(place[fresh], size[fresh])]
        return out, place[np.searchsorted(starts, at)]

    def words(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word, and where it begins: at each of ``starts`` and at a token that begins with a blank or a sign."""
        marks = self.begins[ids]
        marks[starts] = True
        starts = np.flatnonzero(marks)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        return mix(np.add.reduceat(mix(ids.astype(np.uint64) * np.uint64(64) + np.minimum(place, 63).astype(np.uint64), 3), starts), 4), starts


@lru_cache(maxsize=1)
def tokens(tokenizer: str, ranks: str | None, pattern: str | None) -> Tokens:
    return Tokens(tokenizer, ranks, pattern)
