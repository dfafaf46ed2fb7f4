"""Language-model scores from a weighted backoff automaton.

The model is a smoothed n-gram model of the training documents: with N tokens, V distinct tokens, counts c, and h' for a
context h without its first word,

    P(v)     = (c(v) + 0.1) / (N + 0.1 (V + 1))
    P(v | h) = (c(h, v) + MU P(v | h')) / (c(h) + MU)   for contexts h of up to n - 1 words seen in training, else P(v | h')

A document's begin counts as a word of contexts. As an automaton: each context is a state with an arc for every word that
followed it, and a failure arc of weight MU / (c(h) + MU) to the state of h', down to the root, whose arcs hold P(v). One
traversal from left to right carries the state and adds log10 weights; each document ends with an end token. All documents of a
block are traversed in lockstep, long ones in segments: the n - 1 words before a segment give back the state it begins in.

The automaton of a corpus doesn't fit a worker, and isn't sent to one. Documents are dealt to blocks of about
`BLOCK_BYTES` of text by their number in the scan, so that repeated rows and null ids spread out; each block sends the sorted
hashes of the words and n-grams it has, with its training counts, cut into key ranges of about `RANGE_BYTES` of text; each range
sums the counts over all blocks and answers each block in the order it asked. So a block gets just the part of the automaton that
its texts can reach. N and V are sums over the same ranges, in the same plan. Words' keys are 64-bit hashes of their bytes; n-grams'
keys are the first bits of 64-bit hashes of hashes, as many as the corpus's size in bytes has and `SPARE_BITS` more, so that at any
size fewer than one n-gram in 2**SPARE_BITS shares its key. Counts cover all training documents; what is exchanged grows with the input: a row a block and range, until
these hold a key each, which is what counting n-grams by a plain shuffle costs.

Null text counts as empty: one token, the end. Rows are scored one by one, repeated rows alike (each counts as a training
document). Null ids are told apart by crc32 of the empty text. With no training token at all, P(v) = 1 and scores are 0. A very
long text makes its block larger: memory is in proportion to it. Extra columns are ignored, whatever their names. Empty tables
give no rows. The rows must come in the same order when a task is repeated, as those of files do.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard, tokens

BLOCK_BYTES, RANGE_BYTES = 5_000_000, 10_000_000
#: Bits of an n-gram's key beyond those of the corpus's size in bytes.
SPARE_BITS = 22
#: Partitions of an exchange at most; beyond it each holds several blocks or ranges.
PARTITIONS = 20_000
#: Words that are traversed in a row.
SEGMENT = 256
#: Words of the longest n-grams of the query.
ORDER = 3
ADD, MU = 0.1, 20.0
#: Stand-ins for the hashes of a document's end and begin.
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
WORDS, PAIRS, BEGINS = 0, 1, 2  # n-grams of n > 2 are of kind n
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Tokens:
    """Hashes of all tokens of texts, end tokens included, and the text of each."""

    def __init__(self):
        self.lower = bytes([*range(65), *range(97, 123), *range(91, 256)])
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, docs = [], []
        for a, b in tokens.chunks([len(t) for t in texts], tokens.CHUNK_CHARS):
            raw = [t.encode("utf-8", "replace").translate(self.lower) for t in texts[a:b]]
            data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
            stops = np.cumsum([len(r) + 1 for r in raw])
            edge = np.diff(np.concatenate([[True], self.space[data]]).astype(np.int8))
            begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            h = tokens.span_hashes(data, begin, end)
            doc = np.searchsorted(stops, begin, side="right")
            at = np.searchsorted(doc, np.arange(b - a), side="right")
            out.append(np.insert(h, at, END))
            docs.append(np.insert(doc, at, np.arange(b - a)) + a)
        return (np.concatenate(out), np.concatenate(docs)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def pair_keys(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (previous token, token) at each place, and the previous tokens; a document's first token follows BEGIN."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = BEGIN
    return tokens._mix(before * np.uint64(0x9E3779B97F4A7C15) + h), before


def longer_keys(below: np.ndarray, h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams (n > 2) that end at each place, from those of one word less, and whether the document has n words there (its begin is one)."""
    keys = np.zeros_like(h)
    keys[1:] = tokens._mix(below[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    place = np.arange(len(h)) - np.searchsorted(doc, doc)
    return keys, place >= n - 2


def _small(counts: np.ndarray) -> bytes:
    """Counts, compressed, in the least width that holds them; the width is the first byte."""
    top = int(counts.max()) if len(counts) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + _zstd()[0].compress(counts.astype(f"<u{width}").tobytes())


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all, compressed: the upper planes are almost all zeros."""
    gap = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    return _zstd()[0].compress(gap.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=5)


def _grams(h: np.ndarray, doc: np.ndarray, order: int, bits: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, places, sorted keys, first place of each, number of each place's key) of a block's words and n-grams."""
    keys = h
    for n in range(1, order + 1):
        at = np.arange(len(h))
        if n == 2:
            keys = pair_keys(h, doc)[0]
        elif n > 2:
            keys, whole = longer_keys(keys, h, doc, n)
            at = np.flatnonzero(whole)
        own = keys[at] if n == 1 else keys[at] >> np.uint64(64 - bits)
        unique, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        yield {1: WORDS, 2: PAIRS}.get(n, n), at, unique, at[first], inverse


def _asked(h: np.ndarray, doc: np.ndarray, held: np.ndarray, order: int, bits: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, sorted keys, training counts) of a block's tokens."""
    weight = (~held[doc]).astype(np.int64)
    for kind, at, unique, _, inverse in _grams(h, doc, order, bits):
        yield kind, unique, np.bincount(inverse, weight[at], len(unique)).astype(np.int64)


def _pack(ids: list[int | None], held: list[bool], texts: list[str]) -> bytes:
    """Rows, compressed together."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    null = np.array([d is None for d in ids], np.uint8)
    parts = [len(raw).to_bytes(4, "little"), np.array([d or 0 for d in ids], "<i8").tobytes(), null.tobytes(), np.array(held, np.uint8).tobytes(), np.array([len(r) for r in raw], "<u4").tobytes(), *raw]
    return _zstd()[2].compress(b"".join(parts))


def _unpack(packs: list[bytes]) -> tuple[list[int | None], np.ndarray, list[str]]:
    """doc_id, held_out and text of all rows of some packs."""
    ids: list[int | None] = []
    held, texts = [np.zeros(0, bool)], []
    for pack in packs:
        data = _zstd()[1].decompress(pack)
        n = int.from_bytes(data[:4], "little")
        null = np.frombuffer(data, np.uint8, n, 4 + 8 * n)
        ids += [None if x else d for x, d in zip(null, np.frombuffer(data, "<i8", n, 4).tolist(), strict=True)]
        held.append(np.frombuffer(data, np.uint8, n, 4 + 9 * n) > 0)
        sizes = np.frombuffer(data, "<u4", n, 4 + 10 * n).astype(np.int64)
        ends = np.cumsum(sizes) + 4 + 14 * n
        texts += [data[a:b].decode("utf-8", "replace") for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return ids, np.concatenate(held), texts


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """block, rows: the rows dealt to blocks, those of a batch and block compressed together before they are shuffled."""
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            sorted_ = batch.take(pa.array(order))
            packs = [_pack(*(sorted_.column(k).slice(a, b - a).to_pylist() for k in (1, 2, 3))) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cuts[:-1]]), pa.array(packs, pa.binary())], schema=schema)

    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), "doc_id", "held_out", "text")
    return dealt.mapInArrow(run, "block long, rows binary")


def requests(blocked: DataFrame, ranges: int, order: int, bits: int) -> DataFrame:
    """block, kind, range, keys, counts: what each block asks of each key range."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    step = {width: -(-(1 << width) // ranges) for width in (64, bits)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = Tokens()
        for t in jaccard._groups(batches, 1):
            for rows in jaccard._runs(t, 1):
                block = rows.column(0)[0].as_py()
                _, held, texts = _unpack(rows.column(1).to_pylist())
                asked = _asked(*tokenise(texts), held, order, bits)
                out = []
                for kind, keys, counts in asked:
                    part = (keys // np.uint64(step[64 if kind == WORDS else bits])).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
                    out += [(block, kind, int(part[a]), _planes(keys[a:b]), _small(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
                # the begin's count, asked of range 0
                out.append((block, BEGINS, 0, _planes(np.array([BEGIN])), _small(np.array([int((~held).sum())]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return blocked.mapInArrow(run, "block long, kind int, range long, keys binary, counts binary")


def by_range(asked: DataFrame, ranges: int) -> DataFrame:
    """What all blocks ask, each range's rows together: kind, range, block, keys, counts."""
    keys = ["kind", "range"]
    parts = min(4 * ranges, PARTITIONS)  # several kinds a range
    return asked.select("kind", "range", "block", "keys", "counts").repartition(parts, *keys).sortWithinPartitions(*keys, "block")


def answers(asked: DataFrame) -> DataFrame:
    """block, kind, range, counts: the corpus counts of the keys asked for, in their order."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in jaccard._groups(batches, 2):
            for rows in jaccard._runs(t, 2):
                keys = [_keys(k.as_py()) for k in rows.column(3)]
                counts = np.concatenate([_large(c.as_py()) for c in rows.column(4)])
                unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(inverse, counts, len(unique)).astype(np.int64)[inverse]
                cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
                n = len(keys)
                yield pa.RecordBatch.from_arrays([rows.column(2).combine_chunks() if isinstance(rows.column(2), pa.ChunkedArray) else rows.column(2), pa.array([rows.column(0)[0].as_py()] * n, pa.int32()), pa.array([rows.column(1)[0].as_py()] * n, pa.int64()), pa.array([_small(total[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], schema=schema)

    return asked.mapInArrow(run, "block long, kind int, range long, counts binary")


class Automaton:
    """States: one for each context word, BEGIN, the root, then one for each longer context. Words are numbers below `words`.

    `longer` has for each n from 3 to the order the n-grams' prefixes and suffixes, as numbers of n-grams of one word less, and counts.
    """

    def __init__(self, count: np.ndarray, begins: int, pair_state: np.ndarray, pair_word: np.ndarray, pair_count: np.ndarray, total: int, distinct: int, longer: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]] = ()):
        words = len(count)
        self.words, self.begin, self.root, self.memory = words, words, words + 1, len(longer) + 1
        scale = total + ADD * (distinct + 1)
        p = (count + ADD) / scale if total else np.ones(words)
        self.base = np.log10(p)
        keys, weights, targets = [], [], []
        # counts and failure targets of the states
        context, back = [np.append(count, [begins, 0]).astype(float)], [np.full(words + 2, self.root)]
        below, states, state, word, number, grams = p[pair_word], pair_word, pair_state, pair_word, pair_count, list(longer)
        for level in range(len(grams) + 1):
            held = np.concatenate(context)
            seen_as = held[state]
            live = seen_as > 0
            chance = np.where(live, (number + MU * below) / (seen_as + MU), below)
            if level < len(grams):  # each n-gram is a context of those of one word more
                own = len(held) + np.arange(len(number))
                context.append(number.astype(float))
                back.append(states)
            else:
                own = states
            seen = np.flatnonzero((number > 0) & live)
            keys.append(state[seen] * words + word[seen])
            weights.append(np.log10(chance[seen]))
            targets.append(own[seen])
            if level < len(grams):
                prefix, suffix, number = grams[level]
                state, states, word, below = own[prefix], own[suffix], word[suffix], chance[suffix]
        held = np.concatenate(context)
        self.fail, self.back = np.where(held > 0, np.log10(MU / (held + MU)), 0.0), np.concatenate(back)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.arcs, self.weight, self.target = key[order], np.concatenate(weights)[order], np.concatenate(targets)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and the weights of the arcs taken: failure arcs until one holds the word, or the root."""
        gain, after, state = np.zeros(len(state)), np.empty(len(state), np.int64), state.copy()
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], word[todo]
            at = np.searchsorted(self.arcs, s * self.words + w)
            hit = np.zeros(len(todo), bool)
            inside = at < len(self.arcs)
            hit[inside] = self.arcs[at[inside]] == (s * self.words + w)[inside]
            gain[todo[hit]] += self.weight[at[hit]]
            after[todo[hit]] = self.target[at[hit]]
            last = s == self.root  # it knows every word
            gain[todo[last]] += self.base[w[last]]
            after[todo[last]] = w[last]
            left = ~hit & ~last
            todo, s = todo[left], s[left]
            gain[todo] += self.fail[s]
            state[todo] = self.back[s]
        return after, gain

    def score(self, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each text, of words word[bounds[k]:bounds[k + 1]]."""
        cuts = -(-np.diff(bounds) // SEGMENT)
        doc = np.repeat(np.arange(len(cuts)), cuts)
        begin = bounds[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        warm = np.minimum(self.memory, begin - bounds[doc])
        steps = warm + np.minimum(SEGMENT, bounds[doc + 1] - begin)
        order = np.argsort(-steps, kind="stable")
        doc, first, warm, steps = doc[order], (begin - warm)[order], warm[order], steps[order]
        state = np.where(first == bounds[doc], self.begin, self.root)
        total = np.zeros(len(doc))
        for t in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps, -t, side="left"))
            state[:live], gain = self.step(state[:live], word[first[:live] + t])
            total[:live] += np.where(warm[:live] <= t, gain, 0.0)
        return np.bincount(doc, total, len(cuts))


def _score_block(ids: list[int | None], held: np.ndarray, texts: list[str], told: pa.Table, tokenise: Tokens, order: int, bits: int = 64) -> list:
    """The columns of RESULT for a block's rows."""
    total, distinct = told.column("n")[0].as_py(), told.column("v")[0].as_py()
    h, doc = tokenise(texts)
    got: dict[int, list] = {}
    for kind, _, counts in sorted(zip(told.column("kind").to_pylist(), told.column("range").to_pylist(), told.column("counts").to_pylist(), strict=True), key=lambda x: x[:2]):
        got.setdefault(kind, []).append(_large(counts))
    counts, longer = {}, []
    before = pair_keys(h, doc)[1]
    for kind, at, unique, first, inverse in _grams(h, doc, order, bits):
        counts[kind] = np.concatenate(got.get(kind, [np.zeros(0, np.int64)]))
        if len(counts[kind]) != len(unique):
            raise ValueError("a block's answers don't fit what it asked")
        if kind == WORDS:
            words, word = len(unique), inverse
        elif kind == PAIRS:
            pair_word = word[first]
            state = np.where(before[first] == BEGIN, words, word[first - 1])
        else:
            longer.append((numbers[first - 1], numbers[first], counts[kind]))
        numbers = np.full(len(h), -1)  # of the n-gram that ends at each place
        numbers[at] = inverse
    count = counts[WORDS]
    automaton = Automaton(count, int(got[BEGINS][0][0]), state, pair_word, counts[PAIRS], total, distinct, longer)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    known = np.add.reduceat((count[word] > 0).astype(np.int64), bounds[:-1])
    base = np.add.reduceat(automaton.base[word], bounds[:-1])
    return [ids, held, np.diff(bounds), known, np.full(len(texts), total), base, automaton.score(word, bounds)]


def totals(asked: DataFrame) -> DataFrame:
    """One row (n, v): training tokens, and distinct ones, from what all blocks ask."""
    schema = pa.schema([("n", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in jaccard._groups(batches, 2):
            for rows in jaccard._runs(t, 2):
                if rows.column(0)[0].as_py() == WORDS:
                    keys, counts = np.concatenate([_keys(k.as_py()) for k in rows.column(3)]), np.concatenate([_large(c.as_py()) for c in rows.column(4)])
                    yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([len(np.unique(keys[counts > 0]))])], schema=schema)

    return asked.mapInArrow(run, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = ORDER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs: doc_id, text (not null), held_out -> columns RESULT; learns n-grams of up to `order` words from the rows that are not held out."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, n_ranges = (max(1, -(-size // x)) for x in (block_bytes, range_bytes))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    blocked = packed(docs, n_blocks).repartition(min(n_blocks, PARTITIONS), "block")
    asked = by_range(requests(blocked.sortWithinPartitions("block"), n_ranges, order, bits), n_ranges)
    told = answers(asked).crossJoin(F.broadcast(totals(asked)))  # one row
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        columns = _score_block(*_unpack(rows.column("rows").to_pylist()), answer, Tokens(), order, bits)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, RESULT)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 10 = 0 are held out."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (common.crc32_of_id() % 10 == 0).alias("held_out")))
