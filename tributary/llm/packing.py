"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Texts longer than a sequence are cut into full pieces (the first may be shorter). Documents are dealt by a hash of their number in
the scan, so that repeated rows and null ids spread out, to groups of about `GROUP_DOCS`; each group is packed alone, so memory is
bounded and groups run in parallel, at a cost of less than one sequence a group. The rows must come in the same order when a task is
repeated, as those of files do; which sequence a piece comes into depends on that order. Within a group: best fit by decreasing length, then local search over the
underfull bins. Only lengths matter, so the search looks at equal lengths once. Moves and exchanges of one or two pieces
for one or two are taken only if they raise the sum of squared fills; bins that become empty vanish.

A null text is an empty document (its end id alone, one piece). Repeated rows are packed as often as they occur; a very long
text makes many full pieces, which are sequences of their own; extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Documents of a packing group, on average.
GROUP_DOCS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length, by best fit in order of decreasing length."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    # bit r of `room` says whether a bin with r places left exists
    room, bins = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        above = room >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                room &= ~(1 << r)
        else:
            r, b = size, bins
            bins += 1
        out[i] = b
        if r > n:
            free[r - n].append(b)
            room |= 1 << (r - n)
    return out


class _Partners:
    """Bins by the room they have left, and for each room the sums (0: nothing) that one of its bins can give back in an exchange."""

    def __init__(self, size: int):
        self.size = size
        self.bins: dict[int, dict[int, dict[int, tuple[int, ...]]]] = {}
        self.sums: dict[int, Counter] = {}
        self.slot: dict[int, int] = {}
        self.rooms = np.zeros(16, np.int64)
        self.above = np.zeros((16, size + 1), np.int64)  # for each room and number the least sum that is not below it

    def put(self, room: int, b: int, ways: dict[int, tuple[int, ...]]) -> None:
        if room not in self.slot:
            k = self.slot[room] = len(self.slot)
            if k == len(self.rooms):
                self.rooms, self.above = np.concatenate([self.rooms, self.rooms]), np.concatenate([self.above, self.above])
            self.rooms[k], self.bins[room], self.sums[room] = room, {}, Counter([0])
        self.bins[room][b] = ways
        self.sums[room].update(ways.keys())
        self._index(room)

    def drop(self, room: int, b: int) -> None:
        ways = self.bins[room].pop(b)
        if self.bins[room]:
            self.sums[room].subtract(ways.keys())
            self._index(room)
            return
        k, last = self.slot.pop(room), len(self.slot)
        del self.bins[room], self.sums[room]
        if k < last:
            self.rooms[k], self.above[k] = self.rooms[last], self.above[last]
            self.slot[int(self.rooms[k])] = k

    def _index(self, room: int) -> None:
        row = np.full(self.size + 1, self.size + 1)
        have = [x for x, n in self.sums[room].items() if n > 0]
        row[have] = have
        self.above[self.slot[room]] = np.minimum.accumulate(row[::-1])[::-1]

    def best(self, room: int, gives: list[int]) -> int | None:
        """The partner that a bin with so much room and these sums raises the squared fills most with."""
        k = len(self.slot)
        if not k:
            return None
        x, rooms = np.array(gives)[:, None], self.rooms[:k]
        gain = x - self.above[np.arange(k), np.maximum(x - rooms, 0)]
        worth = np.where((gain > 0) & (rooms <= room), gain * (room - rooms + gain), 0)
        at = int(worth.argmax())
        if not worth.flat[at]:
            return None
        i, j = divmod(at, k)
        taken = gives[i] - int(gain[i, j])
        return min(a for a, ways in self.bins[int(rooms[j])].items() if not taken or taken in ways)


def local_search(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Better bins for the same lengths; see the module's docstring.

    All underfull bins, the emptiest first, give to fuller bins that have room: of all moves and exchanges of one or two
    for one or two with all of these, the one that gains most is made, until the bin has none. With fills a >= b, raising
    a by d and lowering b by d raises the squared fill by 2d(a - b + d) > 0. It ends when the bins are as few as the
    lengths' sum allows, or a whole round over all bins finds no exchange.
    """
    least = -(-int(lengths.sum()) // size)
    fill = np.bincount(bins, lengths).astype(np.int64).tolist()
    count = len(fill)
    if count <= least:
        return bins
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bins.tolist()):
        if fill[b] < size:
            members.setdefault(b, []).append(i)
    out, n, better = bins.copy(), lengths.tolist(), True
    partners = _Partners(size)
    for b, own in members.items():
        partners.put(size - fill[b], b, _ways(n, own))
    while better and count > least:
        better = False
        for b in sorted(members, key=lambda x: (fill[x], x)):
            if b not in members:
                continue
            partners.drop(size - fill[b], b)
            while members[b]:
                ways = _ways(n, members[b])
                a = partners.best(size - fill[b], list(ways))
                if a is None:
                    partners.put(size - fill[b], b, ways)
                    break
                better = True
                gain, give, take = _exchange(n, members[b], members[a], size - fill[a])
                partners.drop(size - fill[a], a)
                for i in give:
                    members[b].remove(i)
                    members[a].append(i)
                    out[i] = a
                for i in take:
                    members[a].remove(i)
                    members[b].append(i)
                    out[i] = b
                fill[a] += gain
                fill[b] -= gain
                if fill[a] < size:
                    partners.put(size - fill[a], a, _ways(n, members[a]))
                else:
                    del members[a]
            if not members[b]:
                count -= 1
                del members[b]
                if count <= least:
                    break
    return out


def _ways(n: list[int], items: list[int]) -> dict[int, tuple[int, ...]]:
    """All sums of one or two of the items' lengths, and items for each."""
    same: dict[int, list[int]] = {}
    for i in items:
        same.setdefault(n[i], []).append(i)
    out: dict[int, tuple[int, ...]] = {x: (own[0],) for x, own in same.items()}
    lengths = list(same)
    for p, x in enumerate(lengths):
        if len(same[x]) > 1:
            out.setdefault(2 * x, (same[x][0], same[x][1]))
        for y in lengths[p + 1 :]:
            out.setdefault(x + y, (same[x][0], same[y][0]))
    return out


def _exchange(n: list[int], mine: list[int], his: list[int], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The most that a partner with so much room can gain from one exchange: gain, what he gets, what he gives."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    theirs = {0: ()} | _ways(n, his)
    sizes = sorted(theirs)
    for x, give in _ways(n, mine).items():
        k = bisect.bisect_left(sizes, x - room)
        if k < len(sizes) and best[0] < x - sizes[k] <= room:
            best = (x - sizes[k], give, theirs[sizes[k]])
    return best


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; bins are numbered from 0 without gaps."""
    bins = local_search(lengths, best_fit(lengths, size), size)
    bins = np.unique(bins, return_inverse=True)[1]
    order = np.lexsort((np.arange(len(bins)), bins))
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(bins[order], np.arange(bins.max() + 1 if len(bins) else 0))
    offset = np.empty(len(bins), np.int64)
    offset[order] = total - total[first][bins[order]]
    return bins, offset


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, groups: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces (columns PIECES), tokenised where the rows lie."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("grp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            names, texts, grp = (batch.column(i).to_pylist() for i in range(3))
            for a, b in tokens.chunks([len(t) for t in texts], tokens.CHUNK_CHARS):
                got, bounds = encode(texts[a:b])
                ids = np.insert(got, bounds[1:], end_id).astype("<u4")
                ends = bounds[1:] + np.arange(1, b - a + 1)
                raw = memoryview(ids.tobytes())
                rows = []
                for d, g, s, e in zip(names[a:b], grp[a:b], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    n = e - s
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    rows += [(d, k, x, y - x, zlib.crc32(raw[4 * (s + x) : 4 * (s + y)]), g) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return rows.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, group_docs: int = GROUP_DOCS, **cols) -> DataFrame:
    """One row a piece with its sequence and its place there."""
    groups = max(1, -(-docs.count() // group_docs))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offset = pack(rows["length"].to_numpy(np.int64), size)
        return rows.drop(columns="grp").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offset)

    return pieces(docs, tokenizer, size, end_id, groups, **cols).groupBy("grp").applyInPandas(one, RESULT)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids of byte_bpe_50k.json, end id 2."""
    return pack_documents(common.table(spark, sf_dir, "documents"), tokens.vocabulary())
