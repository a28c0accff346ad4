"""Token ids of whole texts by a public tokenizer's file, with a memo of pieces in each Python worker."""

from __future__ import annotations

import gc
import json
import os
from operator import attrgetter

import numpy as np
import pyarrow as pa

from outrate.llm.shingles import buffers, groups, mix

#: Pieces of at most WIDE bytes that a worker remembers (about 50 bytes each), and bytes of all others; then it starts over.
MEMO, WIDE, OTHERS = 1 << 20, 24, 16 << 20
SLOTS = 1 << 21
#: Bytes of a long text that are looked up together: never more pieces than the memo has room for.
LONG = MEMO // 2

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

#: Kinds of bytes: letters are ASCII's and the two bytes of U+00C0 to U+023F; ODD ones make their word go through the whole tokenizer.
LETTER, DIGIT, MARK, BLANK, ODD, OUTSIDE = range(6)


def _kinds() -> np.ndarray:
    out = np.full(256, OUTSIDE, np.uint8)
    out[:128] = ODD
    out[33:127] = MARK
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[0x80:0xC0] = out[0xC3:0xC9] = LETTER
    out[ord("'")] = ODD
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is visible, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE splits texts into runs of letters, of digits and of other marks, each with the single space before it, and
    into runs of blanks.  Texts are cut there, all of a batch at once, and each distinct piece is encoded once.

    A word with a byte whose class isn't plain from itself (an apostrophe, most of Unicode, the first letter of a special token) goes
    to the tokenizer as a whole; words are cut where blanks begin after an ASCII character or a Latin letter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        shape = json.loads(self.tokenizer.to_str())
        split, added = shape["pre_tokenizer"] or {}, list(self.tokenizer.get_added_tokens_decoder().values())
        by_runs = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and shape["normalizer"] is None
        self.splits = bool(by_runs) and all(t.content.isascii() and not any(c.isspace() for c in t.content) and not t.lstrip and not t.rstrip for t in added)
        self.kinds = _kinds()
        if self.splits:
            self.kinds[[ord(t.content[0]) for t in added]] = ODD
        self._forget()

    def _forget(self) -> None:
        self.keys, self.n = np.zeros((3, MEMO), np.uint64), 0
        self.begin, self.count = np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int32)
        self.ids, self.used = np.zeros(4 * MEMO, self.type), 0
        self.table = np.full(SLOTS, -1, np.int32)
        self.others: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each key in the memo, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            at = self.table[slot]
            some = at >= 0
            todo, slot, at = todo[some], slot[some], at[some]
            same = (self.keys[0, at] == keys[0, todo]) & (self.keys[1, at] == keys[1, todo]) & (self.keys[2, at] == keys[2, todo])
            out[todo[same]] = at[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (SLOTS - 1)
        return out

    def _learn(self, keys: np.ndarray, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Ids of distinct new pieces, straight from the tokenizer's BPE model."""
        tokenize, number, every, size = self.model.tokenize, attrgetter("id"), [], []
        collects = gc.isenabled()
        gc.disable()  # so many small objects would be looked at again and again; none of them is in a cycle
        for p in pieces:
            s = p.decode("latin-1")
            found = tokenize(s.replace(" ", _SPACE) if s.isascii() and s.isprintable() else s.translate(_LETTERS))
            every += map(number, found)
            size.append(len(found))
        if collects:
            gc.enable()
        count, ids = np.array(size, np.int64), np.array(every, self.type)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + len(pieces))
        self.keys[:, new], self.count[new], self.begin[new] = keys, count, self.used + np.cumsum(count) - count
        self.n, self.used = self.n + len(pieces), self.used + len(ids)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(new):
            free = self.table[slot] < 0
            self.table[slot[free]] = new[free]
            left = self.table[slot] != new
            new, slot = new[left], (slot[left] + 1) & (SLOTS - 1)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.type) for e in batch(texts, add_special_tokens=False)]

    def _items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of some texts begin, and which of them are words for the whole tokenizer."""
        n, kind = len(data), self.kinds[data]
        times = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[times] = kind[times + 1] = OUTSIDE
        tail = np.flatnonzero((data & 0xC0) == 0x80)
        kind[tail[(data[tail - 1] < 0xC3) | (data[tail - 1] > 0xC8)]] = OUTSIDE
        start = np.zeros(n + 1, bool)
        start[offsets] = True
        start = start[:n]
        blank, before = kind == BLANK, np.concatenate([[ODD], kind[:-1]]).astype(np.uint8)
        word = start | (blank & (before != BLANK) & (before != OUTSIDE))
        words = np.flatnonzero(word)
        odd = np.add.reduceat((kind >= ODD).astype(np.int32), words) > 0
        after_blank = ~blank & (before == BLANK) & ~start
        spaced = after_blank & (np.concatenate([[0], data[:-1]]) == 32)
        begin = word | (~blank & ~after_blank & (kind != before)) | (after_blank & ~spaced)
        lead = np.flatnonzero(after_blank) - 1
        begin[lead] = True  # the last blank before a word: its prefix, or a piece of its own
        begin &= ~np.repeat(odd, np.diff(words, append=n)) | word
        at = np.flatnonzero(begin)
        return at, odd[np.searchsorted(words, at, "right") - 1]

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts in a row, and how many each has."""
        n = len(data)
        if not n:
            return np.zeros(0, self.type), np.zeros(len(offsets) - 1, np.int64)
        at, odd = self._items(data, offsets)
        size = np.diff(at, append=n)
        odd |= size > WIDE
        raw = data.tobytes()
        plain = np.flatnonzero(~odd)
        where, long = at[plain], size[plain]
        eight = np.ndarray((n + 17,), "<u8", raw + bytes(24), strides=(1,))
        keys, some = np.zeros((3, len(plain)), np.uint64), slice(None)
        for k in range(3):  # the second and third eight bytes only of those that have them
            keys[k, some] = eight[where[some] + 8 * k] & _MASK[np.minimum(long[some] - 8 * k, 8)]
            some = np.flatnonzero(long > 8 * (k + 1))
        hashes = mix(keys[0] * _A ^ keys[1] * _B ^ keys[2] * _C)
        if self.n + len(plain) > MEMO or self.held > OTHERS:
            self._forget()
        number = self._find(keys, hashes)
        new = np.flatnonzero(number < 0)
        while len(new):  # once, but for different pieces of one hash
            _, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            self._learn(keys[:, first], hashes[first], [raw[a : a + m] for a, m in zip(where[first].tolist(), long[first].tolist(), strict=True)])
            number[new] = self._find(keys[:, new], hashes[new])
            new = new[number[new] < 0]
        begin, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[plain], count[plain] = self.begin[number], self.count[number]
        source, rest = self.ids, np.flatnonzero(odd)
        if len(rest):
            words = [raw[a : a + m] for a, m in zip(at[rest].tolist(), size[rest].tolist(), strict=True)]
            fresh = list({w for w in words if w not in self.others})
            self.others.update(zip(fresh, self._whole([w.decode() for w in fresh]), strict=True))
            self.held += sum(2 * len(w) + 200 for w in fresh)
            found = [self.others[w] for w in words]
            count[rest] = [len(x) for x in found]
            begin[rest] = self.used + np.cumsum(count[rest]) - count[rest]
            source = np.concatenate([self.ids[: self.used], *found])
        end = np.cumsum(count)
        ids = source[np.repeat(begin - end + count, count) + np.arange(end[-1])]
        total = np.concatenate([[0], end])[np.searchsorted(at, offsets)]
        return ids, np.diff(total)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and how many each has."""
        data, offsets = buffers(texts)
        if not self.splits:
            found = self._whole([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, self.type), *found]), np.array([len(x) for x in found], np.int64)
        parts = []
        for a, b in groups(offsets):
            some, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            parts.append(self._some(some, at) if len(some) <= MEMO else self._long(some))
        return np.concatenate([np.zeros(0, self.type), *(ids for ids, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one long text, cut about every LONG bytes where a word begins; a stretch without such a place goes to the tokenizer."""
        kind = self.kinds[data]
        words = np.flatnonzero((kind[1:] == BLANK) & (data[:-1] < 128) & (kind[:-1] != BLANK) & (data[:-1] > 32)) + 1
        cuts = [0]
        for to in range(LONG, len(data), LONG):
            k = int(np.searchsorted(words, to))
            if k < len(words) and words[k] > cuts[-1]:
                cuts.append(int(words[k]))
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
            part = data[a:b]
            found.append(self._some(part, np.array([0, b - a]))[0] if b - a <= MEMO else self._whole([part.tobytes().decode()])[0])
        ids = np.concatenate(found)
        return ids, np.array([len(ids)], np.int64)

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id after each text, which counts too."""
        ids, count = self.encode(texts)
        return np.insert(ids, np.cumsum(count), end_id), count + 1


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
