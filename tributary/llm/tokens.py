"""Byte-level BPE over Arrow batches with the `tokenizers` library.

A whole batch is split into pre-tokens by array operations on code points and each *distinct* pre-token is given to
the library's BPE model once per worker; ids are then gathered for all its occurrences. A tokenizer file whose
pipeline isn't plain byte-level BPE is encoded text by text through the library instead.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np

#: Code points with the Unicode property White_Space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that the byte-level split pattern takes together with an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Distinct pre-tokens that a worker remembers; beyond this it starts afresh, which costs time only.
CACHE_ENTRIES = 3_000_000
CHUNK_CHARS = 1_500_000


def _classes() -> np.ndarray:
    import regex

    cls = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            cls[m.start() : m.end()] = kind
    cls[SPACES] = SPACE
    return cls


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed one by one by blake2b.
LONG_SPAN = 512
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of an array of bytes, eight bytes a step, all spans at once.

    Each step goes through a finaliser that is no polynomial, so no family of texts is known to collide; spans of up to
    eight bytes and of one length never do.
    """
    n = ends - starts
    h = _mix(n.astype(np.uint64) + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    long = n > LONG_SPAN
    at, k = np.flatnonzero(~long & (n > 0)), 0
    while len(at):
        h[at] = _mix(h[at] ^ (eight[starts[at] + k] & _TAILS[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8)).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def split_points(chars: np.ndarray, doc_starts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Starts of the byte-level pre-tokens of texts laid end to end; doc_starts holds the first place of each non-empty text."""
    n = len(chars)
    kind = cls[chars]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    k = kind[begin]
    # the last space before other text goes to that text; another last white-space character stands alone
    inner = (k == SPACE) & ~first[end]
    last = end[inner] - 1
    start[last] = True
    start[end[inner][chars[last] == 32]] = False
    # 's 't 're 've 'm 'll 'd after anything but a space
    quote = begin[(k == OTHER) & (end - begin == 1) & (chars[begin] == 39) & ~first[end]]
    quote = quote[(quote == 0) | first[quote] | (chars[np.maximum(quote - 1, 0)] != 32)]
    for suffix in SUFFIXES:
        stop = quote + 1 + len(suffix)
        fits = quote[stop <= n]
        ok = np.ones(len(fits), bool)
        for i, c in enumerate(suffix):
            at = fits + 1 + i
            ok &= (chars[at] == ord(c)) & ((i == 0) | ~first[at])
        for q in fits[ok]:
            start[q + 1] = False
            if q + 1 + len(suffix) < n and kind[q + 1 + len(suffix)] == LETTER:
                start[q + 1 + len(suffix)] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """encode(texts) -> (ids uint32 of all texts, offsets of each text's ids)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and model.get("type", "BPE") == "BPE"
            and not model.get("dropout")
        )
        self.size = self.tokenizer.get_vocab_size()
        if not self.plain:
            return
        self.model = self.tokenizer.model
        # each byte has a printable stand-in: itself, or the next free code point from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.stand_in = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.cls = _classes()
        self._clear()

    def _clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.at = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.text_at = np.zeros(1 << 16, np.int64)
        self.text = np.zeros(1 << 18, np.uint32)
        self.entries = 0

    def _add(self, keys: np.ndarray | None, words: list[str]) -> None:
        """Remembers words; without keys they can't be found again."""
        if self.entries + len(words) >= len(self.at):
            more = np.zeros(max(len(self.at), len(words) + 1), np.int64)
            self.at, self.text_at = np.concatenate([self.at, more]), np.concatenate([self.text_at, more])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = int(self.text_at[self.entries])
        while used + len(chars) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint32)])
        self.text[used : used + len(chars)] = chars
        self.text_at[self.entries + 1 : self.entries + 1 + len(words)] = used + np.cumsum([len(w) for w in words])
        tokenize, table, flat, top = self.model.tokenize, self.stand_in, [], int(self.at[self.entries])
        ends = []
        for w in words:
            flat += [t.id for t in tokenize(w.encode("utf-8", "replace").decode("latin-1").translate(table))]
            ends.append(top + len(flat))
        while top + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[top : top + len(flat)] = flat
        self.at[self.entries + 1 : self.entries + 1 + len(words)] = ends
        level = (keys, np.arange(self.entries, self.entries + len(words)))
        self.entries += len(words)
        if keys is None:
            return
        while self.levels and len(self.levels[-1][0]) <= 3 * len(level[0]):
            old = self.levels.pop()
            k = np.concatenate([old[0], level[0]])
            order = np.argsort(k, kind="stable")
            level = (k[order], np.concatenate([old[1], level[1]])[order])
        self.levels.append(level)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for k, v in self.levels:
            where = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[where] == keys
            out[hit] = v[where[hit]]
        return out

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = split_points(chars, bounds[:-1][np.diff(bounds) > 0], self.cls)
        ends = np.append(starts[1:], len(chars))
        keys, first, inverse = np.unique(span_hashes(chars.view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        if self.entries > CACHE_ENTRIES:
            self._clear()
        entry = self._find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            base = self.entries
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._add(keys[new], [joined[a:b] for a, b in zip(s, e, strict=True)])
            entry[new] = np.arange(base, base + len(new))
        entry = entry[inverse]
        # each place is compared with the text that its ids stand for
        held = self.text_at[entry]
        wrong = self.text_at[entry + 1] - held != ends - starts
        where = np.minimum(np.arange(len(chars)) + np.repeat(held - starts, ends - starts), len(self.text) - 1)
        wrong[np.searchsorted(starts, np.flatnonzero(self.text[where] != chars), side="right") - 1] = True
        if wrong.any():
            base, other = self.entries, np.flatnonzero(wrong)
            self._add(None, [joined[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            entry[other] = np.arange(base, base + len(other))
        size = self.at[entry + 1] - self.at[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        ids, ends, at = [], [np.zeros(1, np.int64)], 0
        for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
            got, bounds = self._chunk(texts[a:b])
            ids.append(got)
            ends.append(bounds[1:] + at)
            at += len(got)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(ends)


def chunks(sizes: list[int], most: int):
    """Ranges of consecutive items whose sizes sum to at most `most`, or of one larger item."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, kept between tasks."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
