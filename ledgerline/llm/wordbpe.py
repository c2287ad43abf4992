"""Exact token ids of a lower-casing word BPE tokenizer, a batch at a time.

Most bytes are handled in numpy: texts of ASCII and Latin-1 letters are cut
into pre-tokens by byte classes, each distinct pre-token is encoded once by
the tokenizer's own BPE model and then looked up by its 64-bit hash.  Texts
with other characters, or with the text of a special token, go through the
whole tokenizer, so that every text gets exactly its ids.
"""

from __future__ import annotations

import numpy as np

from .textkit import LOWER, U, _powers, mix

SPACE, ALPHA, NUMBER, OTHER = 0, 1, 2, 3


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of the second byte after C2 (0-63) and C3 (64-127)."""
    kind = lambda c: SPACE if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else ALPHA if c.isalpha() else NUMBER if c.isnumeric() else OTHER
    return np.array([kind(chr(i)) for i in range(128)] + [OTHER] * 128, np.uint8), np.array([kind(chr(0x80 + i)) for i in range(128)], np.uint8)


ONE, TWO = _byte_classes()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def pretokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lower-cased bytes) of the pre-tokens of rows of ASCII and Latin-1."""
    low = LOWER[data]
    kind = ONE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    if len(lead):
        second = data[lead + 1].astype(np.int64) - 0x80
        own = TWO[second + 64 * (data[lead] == 0xC3)]
        kind[lead] = kind[lead + 1] = own
        up = lead[(data[lead] == 0xC3) & (second < 0x1F) & (second != 0x17)] + 1
        low[up] += 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begin |= edge[:-1]
    begin &= (data & 0xC0) != 0x80
    cut = begin.copy()
    begin &= kind != SPACE
    # A leading apostrophe takes one of these endings with it.
    quote = np.flatnonzero(begin & (data == 0x27))
    if len(quote):
        pad = np.concatenate([low, np.zeros(3, np.uint8)])
        stop = np.concatenate([edge, np.ones(3, bool)])
        one, two = pad[quote + 1], pad[quote + 2]
        room1, room2 = ~stop[quote + 1], ~stop[quote + 1] & ~stop[quote + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & room1
        double = (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))) & room2
        took = np.where(single, 1, np.where(double, 2, 0))
        quote, took = quote[took > 0], took[took > 0]
        begin[quote + 1] = cut[quote + 1] = False
        after = quote + 1 + took
        inside = after[(after < len(data))]
        inside = inside[~edge[inside] & (kind[inside] == ALPHA)]
        begin[inside] = cut[inside] = True
    starts = np.flatnonzero(begin)
    cuts = np.concatenate([np.flatnonzero(cut), [len(data)]])
    ends = cuts[np.searchsorted(cuts, starts, "right")]
    return starts, ends, low


class WordBPE:
    """A tokenizer file with a bounded store of encoded words."""

    def __init__(self, path: str, words: int = 400_000, slots_bits: int = 19):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [w.encode() for w in self.whole.get_vocab() if w not in vocabulary] + [b"<|startoftext|>", b"<|endoftext|>"]
        self.letters = byte_letters()
        self.limit, self.bits = words, slots_bits
        self.reset()

    def reset(self) -> None:
        """Forget all words."""
        self.keys = np.zeros(1 << self.bits, U)
        self.word = np.full(1 << self.bits, -1, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """Encode and store words; each is one pre-token."""
        table = {i: c for i, c in enumerate(self.letters)}
        texts = [w.decode("latin-1").translate(table) for w in raw]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast([" ".join(texts[i : i + 512]) for i in range(0, len(texts), 512)], add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(raw):
            raise ValueError("the tokenizer doesn't close every word")
        n, m = len(raw), len(ids)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.flat[self.used : self.used + m] = ids
        first = np.concatenate([[0], ends[:-1]])
        self.begin[self.count : self.count + n] = self.used + first
        self.length[self.count : self.count + n] = ends - first
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        self.keys[slot] = hashes
        self.word[slot] = np.arange(self.count, self.count + n)
        self.used, self.count = self.used + m, self.count + n

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets into them) of rows of UTF-8 bytes."""
        n = len(at) - 1
        slow = np.zeros(n, bool)
        high = np.flatnonzero(data >= 0xC4)
        slow[np.searchsorted(at, high, "right") - 1] = True
        raw = data.tobytes()
        for mark in self.special:
            k = raw.find(mark)
            while k >= 0:
                slow[np.searchsorted(at, k, "right") - 1] = True
                k = raw.find(mark, k + 1)
        own = {}
        if slow.any():
            rows = np.flatnonzero(slow)
            texts = [raw[at[r] : at[r + 1]].decode("utf-8", "replace") for r in rows]
            own = {int(r): np.asarray(e.ids, np.uint32) for r, e in zip(rows, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
            blank = np.repeat(slow, np.diff(at))
            data = np.where(blank, np.uint8(32), data)
        starts, ends, low = pretokens(data, at)
        up, down = _powers(len(low))
        sums = np.zeros(len(low) + 1, U)
        np.cumsum((low.astype(U) + U(1)) * up[: len(low)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts])
        if self.count > self.limit:
            self.reset()
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        word = self.word[slot]
        miss = np.flatnonzero((word < 0) | (self.keys[slot] != h))
        if len(miss):
            fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[first]
            text = low.tobytes()
            base = self.count
            self.learn(fresh, [text[starts[i] : ends[i]] for i in pick])
            word[miss] = base + back
        sizes = self.length[word]
        out = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begin[word] - out[:-1], sizes) + np.arange(out[-1])] if len(word) else np.zeros(0, np.uint32)
        row_at = out[np.searchsorted(starts, at)]
        if own:
            parts = [own.get(r, ids[row_at[r] : row_at[r + 1]]) for r in range(n)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, row_at


_LOADED: dict[str, WordBPE] = {}


def shared(path: str) -> WordBPE:
    """One tokenizer per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]
