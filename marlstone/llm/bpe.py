"""Token ids of a byte-level BPE tokenizer file, a batch of texts at a time.

The ids are those of ``Tokenizer.from_file(path).encode(text,
add_special_tokens=False)``. Most of a corpus is made of the same pieces (words
with their leading space, numbers, punctuation), so a batch is cut into pieces
with array operations, and each distinct piece is encoded once. Whatever that
cutting isn't made for goes to the library as a whole text: special token
strings, characters outside ASCII and the Latin letters, odd white space, and
tokenizer files of another kind.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd

LETTER, DIGIT, SPACE, BREAK, OTHER, END = 1, 2, 3, 4, 5, 6
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = LETTER
_KIND[[*range(48, 58)]] = DIGIT
_KIND[32] = SPACE
_KIND[[9, 10, 13]] = BREAK
_KIND[255] = END
# What the cutting doesn't know: other control characters, and beyond ASCII all
# but the letters from U+00C0 to U+017F.
_USUAL = bytes([9, 10, 13, *range(32, 127), *range(128, 192), 0xC3, 0xC4, 0xC5])
#: The split pattern of the tokenizers that this module knows (fixed value).
GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def piece_starts(kind: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where pieces start, as the split pattern cuts a text. ``kind`` ends with END."""
    before = np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    white = (kind == SPACE) | (kind == BREAK)
    white_before = np.empty_like(white)
    white_before[0], white_before[1:] = False, white[:-1]
    # A run of one kind is a piece, and takes one space before it.
    starts = np.where(white, ~white_before, (kind != before) & (before != SPACE)) | (kind == END)
    # Of longer white space before a text character the last one stands alone.
    follows = np.empty_like(white)
    follows[-1], follows[:-1] = False, ~white[1:] & (kind[1:] != END)
    starts |= white & follows
    for at in np.flatnonzero((data == 39) & starts):
        two = bytes(data[at + 1 : at + 3])
        size = 2 if two[:1] in (b"s", b"t", b"m", b"d") else 3 if two in (b"re", b"ve", b"ll") else 0
        if size:
            starts[at + 1 : at + size] = False
            starts[at + size] = True
    return starts


class Encoder:
    """Encodes batches of UTF-8 texts; one per Python worker and file."""

    CACHED_PIECES = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.encoding = self._encoding(spec)
        self.line_break = self.encoding.encode_ordinary("\n")[0] if self.encoding else None
        # Pieces by hash, in order, with their ids in a pool.
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        rng = np.random.default_rng(20240229)
        self.mix = rng.integers(0, 2**64, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = self.inverse = np.ones(1, np.uint64)

    @staticmethod
    def _encoding(spec: dict):
        """A quick encoder of single pieces, for files of the usual byte-level form."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        usual = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not usual:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = model["vocab"]
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocabulary["".join(m)] for m in merged]
        if ids != sorted(set(ids)):  # the ids must rank the merges
            return None
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=GPT_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: bytes) -> np.ndarray:
        ids = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, np.uint32)

    def _unusual(self, text: bytes) -> bool:
        return (
            self.encoding is None
            or bool(text.translate(None, _USUAL))
            or b"\xc3\x97" in text
            or b"\xc3\xb7" in text
            or any(s in text for s in self.special)
        )

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) < n:
            size = max(n, 1 << 19)
            self.powers = np.full(size, self.base, np.uint64)
            self.powers[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            inverse = np.full(size, np.uint64(pow(int(self.base), -1, 2**64)), np.uint64)
            inverse[0] = 1
            self.inverse = np.multiply.accumulate(inverse, out=inverse)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.mix[data] * self.powers[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.inverse[starts]
        return found ^ (ends - starts).astype(np.uint64)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.

        Line breaks between pieces are pieces of their own, so one call encodes
        all of them; white space itself goes piece by piece.
        """
        plain = [p for p in pieces if not p.isspace()]
        joined = self.encoding.encode_to_numpy(b"\n".join([*plain, b""]).decode())
        stops = np.flatnonzero(joined == self.line_break)
        sizes = np.diff(stops, prepend=-1) - 1
        ids = joined[joined != self.line_break]
        if len(plain) < len(pieces):
            parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            parts = [
                np.array(self.encoding.encode_ordinary(p.decode()), np.uint32) if p.isspace() else next(parts)
                for p in pieces
            ]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids.astype(np.uint32), sizes

    def _pieces(self, texts: list[bytes]):
        """Of usual texts: a pool of ids, where in it each piece has its ids and how many, and its text."""
        raw = b"".join(t + b"\xff" for t in texts)
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        at = np.flatnonzero(piece_starts(kind, data))
        ends = np.append(at[1:], len(data))
        last = kind[at] == END
        text_of = (np.cumsum(last) - last)[~last]
        at, ends = at[~last], ends[~last]
        which, hashes = pd.factorize(self._hashes(data, at, ends))
        first = np.empty(len(hashes), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == hashes[inside]
        begin, size, pool = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), self.pool
        begin[known], size[known] = self.begin[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(hashes[new])]
            spots = zip(at[first[new]].tolist(), ends[first[new]].tolist())
            ids, size[new] = self._encode([raw[s:e] for s, e in spots])
            begin[new] = len(pool) + np.cumsum(size[new]) - size[new]
            pool = np.concatenate([pool, ids])
            if len(self.keys) < self.CACHED_PIECES:
                self.keys = np.insert(self.keys, place[new], hashes[new])
                self.begin = np.insert(self.begin, place[new], begin[new])
                self.size = np.insert(self.size, place[new], size[new])
                self.pool = pool
        return pool, begin[which], size[which], text_of

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        total = np.zeros(len(texts), np.int64)
        usual = []
        for i, text in enumerate(texts):
            if text and self._unusual(text):
                total[i] = len(self._whole(text))
            elif text:
                usual.append(i)
        if usual:
            _, _, sizes, text_of = self._pieces([texts[i] for i in usual])
            total[usual] = np.bincount(text_of, sizes, len(usual)).astype(np.int64)
        return total

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        usual = []
        for i, text in enumerate(texts):
            if text and self._unusual(text):
                out[i] = self._whole(text)
            elif text:
                usual.append(i)
        if usual:
            pool, begin, sizes, text_of = self._pieces([texts[i] for i in usual])
            stops = np.cumsum(sizes)
            flat = pool[np.repeat(begin - (stops - sizes), sizes) + np.arange(stops[-1])]
            cuts = np.cumsum(np.bincount(text_of, sizes, len(usual)).astype(np.int64))
            for i, part in zip(usual, np.split(flat, cuts[:-1])):
                out[i] = part
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return Encoder(path)
