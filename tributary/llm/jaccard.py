"""Similarity join on five-word shingles with a MinHash LSH forest and exact verification.

Texts are lower-cased and split at white space; the set of hashes of all runs of five words stands for a text (a shorter
text is one shingle; no words, no shingles, no links). Texts with the same words form a *class*, and only classes are
compared.

Each class has a signature of `TREES` x `DEPTH` one-byte min-hashes; a tree's sorted signatures are the leaves of a prefix
trie. Matching begins with the longest prefix by which a pair at the threshold meets in some tree with probability `FLOOR`. It then
descends: prefixes get shorter by a byte as long as the recall is below the target. The recall is estimated from the pairs found so
far: a pair whose signatures agree in a share s of all places is met at depth d with probability p = 1 - (1 - s^d)^TREES, so it stands
for (1 - p) / p pairs that are missed. At each further depth only nodes at which the trie branches are looked at, since the pairs
below a child have met before. Rows with the same prefix lie together; prefixes with the same members in several trees are kept once,
in the first. Members of a prefix are compared in blocks of at most `BLOCK` x `BLOCK`, so no task holds a whole hot prefix; a pair is
looked at once, at its longest prefix and in the first tree that joins it there, and goes on if its signatures agree in as many places
as all but three in 100,000 of pairs at the threshold do.

The pairs that go on travel as packed lists, not as rows, and form clusters. Each cluster's shingle sets are laid out in
blocks of `VERIFY` classes, and each pair is verified by the exact Jaccard similarity where its two blocks meet. Verification returns, per class and block, the number of documents linked and the edges
of a spanning forest: no row per pair.

Result per document: class_id (the smallest doc_id of its class), n_links (other documents with a similarity of at least
the threshold, copies included), component_id (smallest doc_id reachable by links), kept (doc_id = component_id). Null or
empty text, or a null doc_id: a class of its own. Repeated rows count as copies. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, tokens

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, FLOOR, RECALL = 32, 8, 0.99, 0.9999
#: Classes a side of a block of candidates; classes and shingles a side of a block of verification, on average.
BLOCK, VERIFY, SHINGLES = 512, 512, 4_000_000
#: Deviations that a pair's signatures may fall short of the threshold by.
SIGMAS = 4.0
SEED = 20240501


def meets(similarity, depth: int, trees: int = TREES):
    """The probability that a pair shares a prefix of so many bytes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def first_depth(threshold: float = THRESHOLD, floor: float = FLOOR) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with probability `floor`."""
    depth = DEPTH
    while depth > 1 and meets(threshold, depth) < floor:
        depth -= 1
    return depth


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = TREES * DEPTH
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


class Shingler:
    """Sorted distinct shingle hashes of texts, and two 64-bit keys of their word sequences."""

    def __init__(self):
        self.space = _is_space()

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shingles of all texts, each text's bounds in them, two keys each; texts without words have no shingles)."""
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw])
        edge = np.diff(np.concatenate([[True], self.space[data]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h = tokens.span_hashes(data, begin, end)
        doc = np.searchsorted(stops, begin, side="right")
        n = np.bincount(doc, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(n)])
        # keys: sums over a text's words and their places; the second one's words are hashed anew
        keys, other = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        if len(h):
            place = tokens._mix((np.arange(len(h)) - first[doc]).astype(np.uint64))
            some = np.flatnonzero(n)
            for out, words in ((keys, h), (other, tokens.span_hashes(data, begin, end, SEED))):
                out[some] = tokens._mix(np.add.reduceat(tokens._mix(words + place), first[:-1][some]))
        # runs of five words; shorter texts have one run
        rows = []
        for k in range(1, WORDS):
            short = np.flatnonzero(n == k)
            if len(short):
                s = np.zeros(len(short), np.uint64)
                for j in range(k):
                    s = tokens._mix(s + h[first[short] + j])
                rows.append((short, s))
        if len(h) >= WORDS:
            ok = np.flatnonzero(doc[: len(h) - WORDS + 1] == doc[WORDS - 1 :])
            s = np.zeros(len(ok), np.uint64)
            for j in range(WORDS):
                s = tokens._mix(s + h[ok + j])
            rows.append((doc[ok], s))
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), keys, other
        d, s = np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
        d, s = d[new], s[new]
        return s, np.searchsorted(d, np.arange(len(texts) + 1)), keys, other


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte for each hash function and text (0 where a text has no shingles)."""
    a, b = _functions()
    out = np.zeros((len(bounds) - 1, len(a)), np.uint8)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for j in range(len(a)):
            low = np.minimum.reduceat((shingles * a[j] + b[j]) >> np.uint64(8), bounds[some])
            out[some, j] = tokens._mix(low).astype(np.uint8)
    return out


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        for a, b in tokens.chunks([len(t) for t in texts], tokens.CHUNK_CHARS):
            yield batch.slice(a, b - a), texts[a:b]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, c and c2 (its class; null without shingles or id), n (shingles), sig, h (of the text); written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part, texts in _each(batches):
            s, bounds, keys, other = shingler.many(texts)
            sig = signatures(s, bounds)
            none = ~np.asarray(part.column(0).is_valid()) | (np.diff(bounds) == 0)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(k.astype(np.int64), mask=none) for k in (keys, other)), pa.array(np.diff(bounds).astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary()), part.column(2)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.saved(rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, c long, c2 long, n int, sig binary, h long"), "sketch")


def prefixes(classes: DataFrame, depth: int) -> DataFrame:
    """tree, prefix, c, after (the byte after the prefix) for each class."""
    schema = pa.schema([("tree", pa.int32()), ("prefix", pa.int64()), ("c", pa.int64()), ("after", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, TREES, DEPTH).copy()
                after = sig[:, :, depth].astype(np.int32) if depth < DEPTH else np.zeros((n, TREES), np.int32)
                sig[:, :, depth:] = 0
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(sig.view("<i8").reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(after.reshape(-1))], schema=schema)

    return classes.select("c", "sig").mapInArrow(run, "tree int, prefix long, c long, after int")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal values in the first `keys` columns, of rows that come sorted by them; many groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        last = np.ones(batch.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.argmax(last))  # where the last group begins
        same = held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys))
        if cut == 0 and (same or not held):
            held.append(batch)
            continue
        first = cut
        yield pa.Table.from_batches([*held, batch.slice(0, first)])
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def _pairs(keys: tuple[np.ndarray, ...], own: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows with equal keys (.., i, j), the earlier row first: inside of a block, or across two blocks."""
    change = np.ones(len(own), bool)
    change[1:] = False
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(change)
    size = np.diff(np.append(begin, len(own)))
    after = np.repeat(begin + size, size) - np.arange(len(own)) - 1
    total = np.cumsum(after)
    for lo in range(0, int(total[-1]), most):
        p = np.arange(lo, min(lo + most, int(total[-1])))
        left = np.searchsorted(total, p, side="right")
        right = left + 1 + p - (total[left] - after[left])
        ok = (keys[-2][left] == keys[-1][left]) | (own[left] != own[right])
        yield left[ok], right[ok]


def blocks(rows: DataFrame, payload: DataFrame, block: int = BLOCK, branching: bool = False) -> DataFrame:
    """Of rows (tree, prefix, c): the members of each prefix that two or more share, in pairs of blocks: tree, prefix, i, j, own, c, payload.

    If branching, only prefixes whose members differ in `after`.

    Prefixes with the same members are kept once, in the first tree. A prefix of n members makes n * ceil(n / block) rows.
    """
    spread = [F.min("after").alias("low"), F.max("after").alias("high")] if branching else []
    sets = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), *spread).where("n > 1 and low <> high" if branching else "n > 1")
    kept = sets.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("at")).select("at.*", "n")
    members = rows.select("tree", "prefix", "c").join(kept, ["tree", "prefix"]).join(payload, "c").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    extra = [c for c in payload.columns if c != "c"]
    return members.select("tree", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", *extra)


def candidates(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Pairs of classes whose signatures agree enough, each once, packed: rows (c, d, pairs), written to the shared folder.

    Where `pairs` is null, c and d are in one cluster of pairs. Otherwise it holds pairs (a, b) of one cluster, that of c, as longs.
    """
    depth, found = first_depth(threshold), None
    while True:
        level = common.saved(matched(classes, depth, found is None, threshold), "pairs")
        found = level if found is None else found.unionByName(level)
        seen, missed = found.agg(*(F.coalesce(F.sum(F.col("odds")[k]), F.lit(0.0)) for k in (0, depth))).first()
        if depth == 1 or seen >= recall * (seen + missed):
            return found.where("c is not null").drop("odds")
        depth -= 1


def matched(classes: DataFrame, depth: int, first: bool, threshold: float) -> DataFrame:
    """Pairs that meet at prefixes of so many bytes and, unless this is the first depth, at no longer one: rows (c, d, pairs, odds).

    Rows without c hold sums over pairs in `odds`: their number, then for each depth (1 - p) / p.
    """
    width = TREES * DEPTH
    least = int(width * (threshold - SIGMAS * (threshold * (1 - threshold) / width) ** 0.5))
    members = blocks(prefixes(classes, depth), classes.select("c", "sig"), branching=not first)
    schema = pa.schema([("c", pa.int64()), ("d", pa.int64()), ("pairs", pa.binary()), ("odds", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 4):
            tree, prefix, i, j, own, c = (t.column(k).to_numpy() for k in range(6))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, width)
            lefts, rights, odds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(DEPTH + 1)
            for left, right in _pairs((tree, prefix, i, j), own):
                same = sig[left] == sig[right]
                agree = same.sum(axis=1)
                ok = agree >= least
                left, right, agree, same = left[ok], right[ok], agree[ok], same[ok].reshape(-1, TREES, DEPTH)
                ok = same[:, :, :depth].all(axis=2).argmax(axis=1) == tree[left]
                if not first:
                    ok &= ~same[:, :, : depth + 1].all(axis=2).any(axis=1)
                share = agree[ok & (agree >= width * threshold)] / width
                odds[0] += len(share)
                for d in range(1, DEPTH + 1):
                    p = meets(share, d)
                    odds[d] += ((1 - p) / p).sum()
                lefts.append(left[ok])
                rights.append(right[ok])
            left, right = np.concatenate(lefts), np.concatenate(rights)
            if not len(left):
                continue
            up = _united(left, right)
            root = np.array([_top(up, x) for x in left.tolist()])
            order = np.argsort(root, kind="stable")
            left, right, root = left[order], right[order], root[order]
            packed = np.column_stack([c[left], c[right]]).astype("<i8")
            cuts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
            nodes = list(up)
            tops = [_top(up, x) for x in nodes]
            out_c = [*c[nodes].tolist(), *c[root[cuts[:-1]]].tolist(), None]
            out_d = [*c[tops].tolist(), *[None] * len(cuts)]
            lists = [*[None] * len(nodes), *(packed[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)), None]
            sums = [*[None] * (len(out_c) - 1), odds.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((out_c, out_d, lists, sums), schema, strict=True)], schema=schema)

    keys = ["tree", "prefix", "i", "j"]
    return members.repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(run, "c long, d long, pairs binary, odds array<double>")


def _top(up: dict[int, int], v: int) -> int:
    while up.get(v, v) != v:
        up[v] = up.get(up[v], up[v])
        v = up[v]
    return v


def _united(left: np.ndarray, right: np.ndarray) -> dict[int, int]:
    """Each node's parent in a forest that joins all pairs."""
    up: dict[int, int] = {}
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        u, v = _top(up, x), _top(up, y)
        up.setdefault(u, u)
        up.setdefault(v, min(u, v))
        up[max(u, v)] = min(u, v)
    return up


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links among packed pairs: rows (c, links, root): documents linked to c, and a smaller linked class or c; several rows a class."""
    clusters = graph.components(pairs.where("pairs is null").select(F.col("c").alias("a"), F.col("d").alias("b")))
    clusters = common.saved(clusters.select(F.col("node").alias("c"), "root").join(classes.select("c", "c2", "rep", "copies", "n"), "c"), "clusters")
    size = clusters.groupBy("root").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / VERIFY, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    placed = common.saved(common.join_hot(clusters, size, ["root"], "members", clusters.count()).drop("n", "members"), "placed")
    schema = pa.schema([("c", pa.int64()), ("root", pa.int64()), ("blocks", pa.int32()), ("copies", pa.int64()), ("shingles", pa.binary())])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part, texts in _each(batches):
            s, bounds, _, other = shingler.many(texts)
            mine = other.astype(np.int64) == part.column(part.schema.get_field_index("c2")).to_numpy()  # an id may occur with several texts
            at = np.flatnonzero(mine)
            out = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array([s[bounds[k] : bounds[k + 1]].tobytes() for k in at], pa.binary())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # always a merge join: the plan, and so its growth, doesn't hinge on whether a table happens to fit a broadcast
    sets = texts.join(placed.hint("merge"), texts["doc_id"] == placed["rep"]).select("c", "root", "blocks", "copies", "c2", "text").mapInArrow(shingles, "c long, root long, blocks int, copies long, shingles binary")
    sets = sets.withColumn("own", F.pmod("c", F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(0).alias("kind"), "c", "copies", F.col("shingles").alias("data"))
    routed = pa.schema([("root", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("c", pa.int64()), ("data", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for root, n, c, raw in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if n == 1:
                    rows.append((root, 0, 0, c, raw))
                    continue
                p = np.frombuffer(raw, "<i8").reshape(-1, 2)
                own = np.sort(p % n, axis=1)
                for i, j in np.unique(own, axis=0).tolist():
                    rows.append((root, i, j, c, p[(own[:, 0] == i) & (own[:, 1] == j)].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), routed, strict=True)], schema=routed)

    asked = pairs.where("pairs is not null").join(placed.select("c", "root", "blocks"), "c").select("root", "blocks", "c", "pairs").mapInArrow(route, "root long, i int, j int, c long, data binary")
    asked = asked.select("root", "i", "j", F.lit(1).alias("kind"), "c", F.lit(0).cast("long").alias("copies"), "data")
    result = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            for rows in _runs(t, 3):
                kind, c = rows.column(3).to_numpy(), rows.column(4).to_numpy()
                lists = [np.frombuffer(rows.column(6)[k].as_py(), "<i8").reshape(-1, 2) for k in np.flatnonzero(kind == 1).tolist()]
                if not lists:
                    continue
                sets_at = np.flatnonzero(kind == 0)
                names, copies = c[sets_at], rows.column(5).to_numpy()[sets_at]
                sizes = np.array([len(rows.column(6)[k].as_py()) // 8 for k in sets_at.tolist()])
                held = np.frombuffer(b"".join(rows.column(6)[k].as_py() for k in sets_at.tolist()), np.uint64)
                order = np.argsort(names)
                x, y = (order[np.searchsorted(names, side, sorter=order)] for side in np.concatenate(lists).T)
                both = _common(held, sizes, x, y)
                ok = both >= threshold * (sizes[x] + sizes[y] - both)
                x, y = x[ok], y[ok]
                count = np.bincount(x, copies[y], len(names)) + np.bincount(y, copies[x], len(names))
                up = _united(names[x], names[y])
                links = dict(zip(names[count > 0].tolist(), count[count > 0].astype(np.int64).tolist(), strict=True))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64()), pa.array([_top(up, v) for v in links], pa.int64())], schema=result)

    keys = ["root", "i", "j"]
    return sets.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "c").mapInArrow(run, "c long, links long, root long")


def _common(held: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """How many elements the sets x[k] and y[k] share; sets lie end to end, sorted, without repeats."""
    first = np.cumsum(sizes) - sizes
    # elements as numbers, so that (set, element) is one sorted key
    values, number = np.unique(held, return_inverse=True)
    key = np.repeat(np.arange(len(sizes)), sizes) * (len(values) + 1) + number
    small, large = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
    out = np.zeros(len(x), np.int64)
    for a, b in tokens.chunks(sizes[small].tolist(), most):
        n = sizes[small[a:b]]
        pair = np.repeat(np.arange(a, b), n)
        at = np.arange(len(pair)) + np.repeat(first[small[a:b]] - (np.cumsum(n) - n), n)
        want = large[pair] * (len(values) + 1) + number[at]
        found = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
        out[a:b] = np.bincount(pair[found] - a, minlength=b - a)
    return out


def _runs(t: pa.Table, keys: int) -> Iterator[pa.Table]:
    cols = [t.column(k).to_numpy() for k in range(keys)]
    change = np.ones(len(t), bool)
    change[1:] = False
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    begin = [*np.flatnonzero(change).tolist(), len(t)]
    t = t.combine_chunks()
    for a, b in zip(begin, begin[1:], strict=False):
        yield t.slice(a, b - a)


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept for every row of docs; see the module's docstring."""
    return grouped(docs, threshold, recall).drop("h", "group")


def grouped(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The columns of join, h (xxhash64 of the text, null as empty) and group: the component's key, which tells components apart whose smallest id is the same (null without shingles or id)."""
    rows, classes = common.classes(sketch(docs), [F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n")])
    pairs = candidates(classes, threshold, recall)
    found = common.saved(verify(docs, classes, pairs, threshold), "links")
    roots = graph.components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    roots = common.saved(roots.join(classes.select(F.col("c").alias("node"), "rep"), "node"), "roots")
    low = roots.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("members"))
    roots = common.join_hot(roots, low, ["root"], "members", roots.count()).select(F.col("node").alias("c"), "component", "root")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    facts = classes.select("c", "rep", "copies").join(links, "c", "left").join(roots, "c", "left")
    out = common.join_hot(rows.select("doc_id", "h", "c"), facts, ["c"], "copies", rows.count())
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "h", F.coalesce("root", "c").alias("group"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and components of all documents at a similarity of 0.8 on five-word shingles."""
    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
