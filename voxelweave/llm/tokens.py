"""Token ids of many texts, each distinct word encoded once.

The vocabulary's pre-tokenizer never joins what white space parts, so the ids of
a text are those of its words in turn. Words are found and hashed with NumPy; a
worker keeps the ids of up to ``CACHE`` words (64-bit hash and length).
"""

from __future__ import annotations

import sys

import numpy as np

from . import wordhash

CACHE = 400_000
#: Bytes of text that are hashed together.
CHUNK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


class Table:
    """Ids by the hash of what they encode: a large sorted array of hashes and
    a small one, merged now and then, point into one array of ids."""

    MERGE = 50_000

    def __init__(self, first: list[int]):
        self.flat = np.array(first, np.uint32)
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted hashes: where their ids start (-1: not known), how many."""
        start, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for keys, s, n in self.parts:
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            if len(keys):
                hit = keys[at] == h
                start[hit], count[hit] = s[at[hit]], n[at[hit]]
        return start, count

    def add(self, h: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """h: sorted, new; flat: their ids in turn."""
        start = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, flat])
        big, small = self.parts
        at = np.searchsorted(small[0], h)
        small = tuple(np.insert(x, at, y) for x, y in zip(small, (h, start, count)))
        if len(small[0]) > self.MERGE:
            at = np.searchsorted(big[0], small[0])
            big = tuple(np.insert(x, at, y) for x, y in zip(big, small))
            small = tuple(x[:0] for x in small)
        self.parts = [big, small]


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return flat[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


#: Bytes of words that are split here: ASCII but for the apostrophe, "<" and
#: control characters, and Latin letters of two bytes (U+00C0 to U+017F).
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[0x27] = _ODD[0x3C] = _ODD[0x7F] = _ODD[0xC2] = _ODD[0xC6:] = True
#: 1: letter, 2: digit, 3: other, 0: space.
_KIND = np.full(256, 3, np.int8)
_KIND[32] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x61:0x7B] = _KIND[0x80:] = 1


class Vocabulary:
    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # id 0 ends a document
        self.words, self.parts = Table([0]), Table([])

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([word], add_special_tokens=False)[0].ids, np.uint32)

    def many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, which end with a word end each."""
        all_ids, counts = [], []
        for k in range(0, len(parts), 2000):
            some = parts[k : k + 2000]
            ids = self.one(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                each = [self.one(p) for p in some]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            all_ids.append(ids)
            counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(all_ids), np.concatenate(counts)

    def split(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words: runs of letters, single digits and runs of
        other signs are pre-tokens."""
        text = b" ".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist())]).decode().lower().encode()
        buf = np.frombuffer(text, np.uint8)
        ends = np.cumsum(b - a) + np.arange(len(a))
        kind = _KIND[buf]
        before = np.concatenate([[0], kind[:-1]])
        start = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 2)))
        after = np.concatenate([kind[1:], [0]])
        end = np.flatnonzero((kind > 0) & ((kind != after) | (kind == 2))) + 1
        h, first, which = np.unique(wordhash.hashes(buf, start, end), return_index=True, return_inverse=True)
        at, n = self.parts.find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            self.parts.add(h[miss], *self.many([text[x:y].decode() for x, y in zip(start[first[miss]].tolist(), end[first[miss]].tolist())]))
            at, n = self.parts.find(h)
        at, n = at[which], n[which]
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, ends)]
        return _gather(self.parts.flat, at, n), np.diff(upto, prepend=0)

    def ids(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in buf (each ends with white space at
        ``ends``), and how many of them each text has."""
        a, b = wordhash.spans(buf, _BLANK)
        h, first, which = np.unique(wordhash.hashes(buf, a, b), return_index=True, return_inverse=True)
        if len(self.words) + len(h) > CACHE:
            self.words = Table([0])
        if len(self.parts) > CACHE:
            self.parts = Table([])
        at, n = self.words.find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            raw = buf.tobytes()
            odd = _ODD[buf]
            high = np.flatnonzero(buf[:-1] >= 0xC3)
            two = buf[high].astype(np.int64) << 8 | buf[high + 1]
            odd[high[np.isin(two, (0xC397, 0xC3B7, 0xC4B0, 0xC589))]] = True
            odds = np.concatenate([[0], np.cumsum(odd)])
            x, y = a[first[miss]], b[first[miss]]
            plain = odds[y] == odds[x]
            if plain.any():
                self.words.add(h[miss[plain]], *self.split(raw, x[plain], y[plain]))
            if not plain.all():
                each = [self.one(raw[i:j].decode("utf-8", "replace")) for i, j in zip(x[~plain].tolist(), y[~plain].tolist())]
                self.words.add(h[miss[~plain]], np.concatenate(each), np.array([len(e) for e in each], np.int64))
            at, n = self.words.find(h)
        at, n = at[which], n[which]
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(a, ends)]
        return _gather(self.words.flat, at, n), np.diff(upto, prepend=0)


def vocabulary(file: str) -> Vocabulary:
    """One for each Python worker, whatever tasks it runs."""
    kept = sys.__dict__.setdefault("_voxelweave_vocabularies", {})
    if file not in kept:
        kept[file] = Vocabulary(file)
    return kept[file]


def segments(texts: list[str | None]):
    """(row, bytes, whether the text ends here): long texts in parts of about
    CHUNK bytes that end at white space, so that memory stays bounded."""
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        at = 0
        while len(data) - at > CHUNK:
            cut = max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\n"))
            if cut < at:  # a word longer than that
                cut = min((x for c in (b" ", b"\n") if (x := data.find(c, at + CHUNK)) >= 0), default=len(data) - 1)
            yield row, data[at : cut + 1], False
            at = cut + 1
        yield row, data[at:], True


def chunks(texts: list[str | None]):
    """Lists of segments of about CHUNK bytes together."""
    held, size = [], 0
    for s in segments(texts):
        if held and size + len(s[1]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s[1])
    if held:
        yield held
