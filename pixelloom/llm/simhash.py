"""SimHash near-duplicates: fingerprints, pigeonring candidate search, and linked components.

Fingerprints: each bit is set if it is set in over half of a text's shingle hashes.

Search: the 64 bits are cut into a ring of five segments. If two fingerprints differ in at most
d = 4 bits, some chain of consecutive segments keeps every prefix within its proportional share of
the budget: after j segments at most j * d / 5 differences. So the first segment of the chain is
equal and the first two differ in at most one bit, the first three in two, the first four in three.
Every distinct fingerprint is dealt once for each of the five starts by its equal segment; within
such a bucket the second segment and its one-bit neighbours are looked up in sorted order, longer
prefixes prune the candidates, and only what is left gets the full Hamming check.

Copies fall together before the search (one row for each distinct fingerprint), and a bucket gives
back a spanning forest of its links rather than all pairs. Buckets with over `bucket_rows`
fingerprints are dealt into tiles of two shares, one that asks and one that is looked up, so a task holds two shares of
`bucket_rows` at most. Components come from rounds of large-star and small-star over the links, cut by written tables.

Wider distances have more segments (one more than differing bits), so some chain still starts with an equal segment and
the first two differ in at most one bit. `one_of_each` searches eight fingerprints of a text's shingle set so, at seven
bits, confirms what is found by the sets' exact similarity, and takes up the pairs that no fingerprint reaches by bands.

Defined cases: null text counts as empty; a text without words has fingerprint zero, which links
like any other. Rows with a null id link others as any row does, but take no part in the smallest id; a group of only such
rows has a null component. Repeated rows give repeated result rows; equal fingerprints are one in the search. Very long
texts are read whole. An empty table gives no rows. Other columns play no part. Ids must be whole numbers or null; a text
id is cast to long, which Spark refuses if it is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

SEED = 42
DISTANCE = 4
#: Segments of the ring of 64 bits; wider distances have more.
SEGMENTS = 5
PAIR_BLOCK = 1 << 19
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(first, ends[size - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes; bits are counted through a histogram of hash bytes."""
    n = len(counts)
    h = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(n), counts)
    total = np.array(counts)
    bits = np.zeros((n, 64), np.uint8)
    for b in range(8):
        seen = np.bincount(row * 256 + h[:, b], minlength=n * 256).reshape(n, 256)
        bits[:, 8 * b : 8 * b + 8] = (seen @ BITS_OF) * 2 > total[:, None]
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints_of(texts: list[bytes], size: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    i = 0
    while i < len(texts):
        hashes, counts, j = [], [], i
        while j < len(texts) and j - i < 256 and len(hashes) < 1 << 18:
            got = shingle_hashes(texts[j], size)
            hashes += got
            counts.append(len(got))
            j += 1
        out[i:j] = majority(np.array(hashes, np.uint64), counts)
        i = j
    return out


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts, size).view(np.int64))], names=["doc_id", "fp"])

    return C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(mark, "doc_id long, fp long")


def cuts_of(distance: int) -> list[int]:
    """Segment ends around the ring: more segments than differing bits, so that some chain starts with an equal one, of 13 bits at most."""
    n = max(SEGMENTS, distance + 1)
    return [-(-64 * i // n) for i in range(n + 1)]


def _segment(fp: np.ndarray, i: int, distance: int = DISTANCE) -> np.ndarray:
    cuts = cuts_of(distance)
    i %= len(cuts) - 1
    a, b = cuts[i], cuts[i + 1]
    return (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def _mask(start: int, n: int, distance: int = DISTANCE) -> np.uint64:
    """The bits of n consecutive segments of the ring."""
    cuts = cuts_of(distance)
    m = 0
    for i in range(start, start + n):
        a, b = cuts[i % (len(cuts) - 1)], cuts[i % (len(cuts) - 1) + 1]
        m |= ((1 << (b - a)) - 1) << a
    return np.uint64(m)


def ring_links(start: int, fp: np.ndarray, group: np.ndarray, asks: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) with fp[a] < fp[b] that share a group (an equal first segment) and pass the chain and the full check.

    At most PAIR_BLOCK candidates are held at once. Only rows with `asks` look others up.
    """
    others = (np.bincount(group, ~asks) > 0)[group] if len(group) else asks  # rows whose group holds some that don't ask
    segments = len(cuts_of(distance)) - 1
    second = _segment(fp, start + 1, distance)
    width = int(_mask(start + 1, 1, distance)).bit_count()
    place = group.astype(np.uint64) << np.uint64(13) | second
    order = np.argsort(place, kind="stable")
    place, fps, asking = place[order], fp[order], np.nonzero(asks[order])[0]
    flips = [0] + [1 << b for b in range(width)] if 2 * distance >= segments else [0]
    prefixes = [(_mask(start, n, distance), n * distance // segments) for n in range(3, segments)]
    for flip in flips:
        target = place[asking] ^ np.uint64(flip)
        lo, hi = np.searchsorted(place, target, "left"), np.searchsorted(place, target, "right")
        n = hi - lo
        who = np.nonzero(n)[0]
        if not len(who):
            continue
        ends = np.cumsum(n[who])
        i = 0
        while i < len(who):
            # Ask for as many rows as fit; one row with more candidates than that takes them in turns.
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + PAIR_BLOCK, "right")))
            rows = who[i:j]
            for off in range(0, int(n[rows].max()), PAIR_BLOCK) if j == i + 1 else (0,):
                span = np.minimum(n[rows] - off, PAIR_BLOCK) if j == i + 1 else n[rows]
                a = np.repeat(asking[rows], span)
                step = np.arange(len(a)) - np.repeat(np.cumsum(span) - span, span)
                b = np.repeat(lo[rows] + off, span) + step
                keep = fps[a] < fps[b]
                a, b = a[keep], b[keep]
                x = fps[a] ^ fps[b]
                for mask, budget in prefixes:
                    near = np.bitwise_count(x & mask) <= budget
                    a, b, x = a[near], b[near], x[near]
                near = np.bitwise_count(x) <= distance
                near &= ~(asks & others)[order[b]]  # pairs within the asking share have a tile of their own
                if near.any():
                    yield order[a[near]], order[b[near]]
            i = j


class Forest:
    """Connected components over row numbers; each root is its component's smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(root, high, low)
            while True:  # shorten
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _forest(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets; a bucket's rows arrive together, sorted by bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(bucket: np.ndarray, block: np.ndarray, fp: np.ndarray, node: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = np.arange(len(fp))
        start = bucket >> 13
        group = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))])
        for s in np.unique(start):
            own = np.nonzero(start == s)[0]
            own = own[np.argsort(node[own], kind="stable")]  # roots are smallest nodes, so that buckets give the same links
            forest = Forest(len(own))
            for a, b in ring_links(int(s) % (len(cuts_of(distance)) - 1), fp[own], group[own], asks[own], distance):
                forest.join(a, b)
            root[own] = own[forest.root]
        child = np.nonzero(root != np.arange(len(fp)))[0]
        if len(child):
            a, b = node[root[child]], node[child]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    size, enough = 0, 1 << 18
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(cols[0]):
            continue
        held.append(cols)
        size += len(cols[0])
        if size < enough:
            continue
        bucket, block, fp, node, asks = (np.concatenate(c) for c in zip(*held))
        same = (bucket == bucket[-1]) & (block == block[-1])
        cut = int(np.argmax(same))  # the last bucket may go on
        if cut:
            yield from links(bucket[:cut], block[:cut], fp[:cut].view(np.uint64), node[:cut], asks[:cut])
        held = [(bucket[cut:], block[cut:], fp[cut:], node[cut:], asks[cut:])]
        size = len(bucket) - cut
        enough = max(1 << 18, 2 * size)
    if held:
        bucket, block, fp, node, asks = (np.concatenate(c) for c in zip(*held))
        yield from links(bucket, block, fp.view(np.uint64), node, asks)


def near_links(nodes: DataFrame, distance: int = DISTANCE, bucket_rows: int = 1 << 20) -> DataFrame:
    """Links (a, b), a < b, that connect what lies within `distance` bits. nodes: node and its distinct fp.

    With a column k, nodes have several fingerprints, each searched among those of the same k, where it is distinct.
    """
    cuts = cuts_of(distance)
    n = len(cuts) - 1
    k = F.col("k") if "k" in nodes.columns else F.lit(0)
    parts = F.array(*[F.struct((k * n + i).alias("i"), F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)).alias("s")) for i in range(n)])
    dealt = nodes.select("node", "fp", F.explode(parts).alias("p")).select("node", "fp", (F.col("p.i") * F.lit(1 << 13) + F.col("p.s")).alias("bucket"))
    # At most 8,192 buckets of each segment exist, so the list of large ones has a bound at any size.
    large = F.broadcast(dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).alias("blocks")))
    dealt = dealt.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("turn", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    # Tile (i, j) asks with share i among the rows of share j: a row asks in the tiles of its row, and is looked up in those of its column.
    shares = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asking = F.transform(shares, lambda j: F.struct((F.col("turn") * F.col("blocks") + j).alias("block"), F.lit(True).alias("asks")))
    asked = F.transform(F.filter(shares, lambda i: i != F.col("turn")), lambda i: F.struct((i * F.col("blocks") + F.col("turn")).alias("block"), F.lit(False).alias("asks")))
    dealt = dealt.select("bucket", "fp", "node", F.inline(F.concat(asking, asked))).select("bucket", "block", "fp", "node", "asks")
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(lambda batches: _forest(batches, distance), "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node it is connected to) for every node in a link; rounds of large-star and small-star until both are settled.

    A node of many links is a hot key of the joins. What they join are written tables, so that both sides are plain
    shuffles, whose large partitions adaptive execution splits.
    """
    edges = C.stored(links.distinct(), name)
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself).
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = C.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), f"{name}-low")
        stars = C.stored(both.where("v > u").join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct(), f"{name}-stars")
        # Small star: a node and its smaller neighbours all go to the smallest of them.
        least = C.stored(stars.groupBy("b").agg(F.min("a").alias("low")), f"{name}-least")
        small = stars.join(least, "b").select("low", "a", "b")
        new = small.select(F.col("low").alias("a"), "b").union(small.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()
        new = C.stored(new, name)
        for done in (edges, low, stars, least):
            C.discard(done)
        # Done when every larger end has one link, and no larger end is a smaller end elsewhere.
        deep = new.select(F.col("b").alias("x")).join(new.select(F.col("a").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        if not deep and not new.groupBy("b").count().where("count > 1").limit(1).count():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most `distance` bits) for every row."""
    marks = C.stored(fingerprints(docs, size, id_col, text_col), "fingerprints")
    # One node for each distinct fingerprint, named by itself, so that rows without an id link others too.
    nodes = C.stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Fingerprints of the looser search and bits in which they may differ. Texts of similarity s are found with chance 0.87 at 0.8, 0.98 at 0.85, 0.9998 at 0.9.
PRINTS, WIDE = 8, 7
STIR = np.random.default_rng(8).integers(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bands of what the fingerprints leave and hashes in a band. Texts of similarity s share a band with chance 1 - (1 - s^4)^32: all but 5 in 10^8 at 0.8.
BANDS, ROWS = 32, 4
SPREAD = np.random.default_rng(9).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """PRINTS fingerprints of each shingle set: that of the hashes themselves and of their hashes stirred."""
    out = np.zeros((len(sets), PRINTS), np.uint64)
    i = 0
    while i < len(sets):
        counts = [len(sets[i])]
        while i + len(counts) < len(sets) and len(counts) < 256 and sum(counts) < 1 << 18:
            counts.append(len(sets[i + len(counts)]))
        j = i + len(counts)
        hashes = np.concatenate(sets[i:j])
        for k, by in enumerate(STIR):
            h = hashes
            if k:
                h = h * by
                h = (h ^ h >> np.uint64(32)) * STIR[0]
                h ^= h >> np.uint64(29)
            out[i:j, k] = majority(h, counts)
        i = j
    return out


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its smallest spread hashes mixed. Texts without words share all their keys."""
    low = np.full(len(SPREAD), 0, np.uint64)
    for k, by in enumerate(SPREAD if len(hashes) else ()):
        low[k] = (hashes * by).min()
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (the text's hash), fingerprints and band keys for every row."""

    def lists(values: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // n + 1, dtype=np.int32) * n), pa.array(values))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            sets = [shingle_set(t, size) for t in texts]
            prints = prints_of(sets).view(np.int64).ravel()
            keys = np.concatenate([np.zeros(0, np.int64), *(bands_of(x) for x in sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(prints, PRINTS), lists(keys, BANDS)], names=["doc_id", "node", "prints", "bands"])

    return _with_node(docs, id_col, text_col).mapInArrow(mark, "doc_id long, node long, prints array<long>, bands array<long>")


def _with_node(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")


def similar_forest(texts: list[bytes], asks: list[bool], prints: np.ndarray, size: int, similarity: float) -> list[int]:
    """Roots of a cluster's texts over pairs that hold one that asks and whose shingle sets overlap by `similarity` at least.

    Pairs with a fingerprint within WIDE bits come first, then those of the rest that share a band. A pair is compared
    once, and not at all when other pairs have joined it.
    """
    sets = [shingle_set(t, size) for t in texts]
    keys = np.array([bands_of(s) for s in sets])
    forest = Forest(len(texts))
    place = np.cumsum(asks) - 1
    apart = np.zeros((sum(asks), len(texts)), bool)

    def alike(a: int, b: int) -> bool:
        if not asks[a]:
            a, b = b, a
        elif asks[b] and a > b:
            a, b = b, a
        if not asks[a] or apart[place[a], b]:
            return False
        x, y = len(sets[a]), len(sets[b])
        common = 0
        if min(x, y) >= similarity * max(x, y) - 1e-9:
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        apart[place[a], b] = common < similarity * (x + y - common) - 1e-9
        return not apart[place[a], b]

    asking = np.array(asks)
    for a in range(len(texts) - 1):
        near = (np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= WIDE).any(axis=1)
        for b in (np.nonzero(near & (forest.root[a + 1 :] != forest.root[a]) & (asking[a + 1 :] | asking[a]))[0] + a + 1).tolist():
            if forest.root[a] != forest.root[b] and alike(a, b):
                forest.join(np.array([a]), np.array([b]))
    for band in keys.T:
        order = np.argsort(band, kind="stable")
        for group in np.split(order, np.nonzero(np.diff(band[order]))[0] + 1):
            roots = forest.root[group]
            if (roots == roots[0]).all():
                continue
            parts: list[list[int]] = []  # no two of them alike
            for r in np.unique(roots):
                part, rest = group[roots == r].tolist(), []
                for other in parts:
                    pair = next(((a, b) for a in part for b in other if alike(a, b)), None)
                    if pair is None:
                        rest.append(other)
                    else:
                        forest.join(np.array([pair[0]]), np.array([pair[1]]))
                        part = other + part
                parts = [*rest, part]
    return forest.root.tolist()


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of whole clusters; a cluster's rows arrive together, sorted by cluster and block."""

    def links(held: dict[int, tuple[bytes, bool, list[int]]]) -> Iterator[pa.RecordBatch]:
        nodes = list(held)
        texts, asks, prints = (list(x) for x in zip(*held.values()))
        roots = similar_forest(texts, asks, np.array(prints, np.int64).view(np.uint64), size, similarity)
        pairs = [sorted((nodes[r], nodes[i])) for i, r in enumerate(roots) if r != i]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    held: dict[int, tuple[bytes, bool, list[int]]] = {}
    now = None
    for batch in batches:
        texts = batch.column(3).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        for cluster, block, node, text, asks, prints in zip(*(batch.column(i).to_pylist() for i in range(3)), texts, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if now != (cluster, block):
                if held:
                    yield from links(held)
                now, held = (cluster, block), {}
            held[node] = (text or b"", asks, prints)
    if held:
        yield from links(held)


def similar_links(docs: DataFrame, nodes: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cluster_rows: int = 1024) -> DataFrame:
    """Links (a, b), a < b, that connect the texts whose shingle sets overlap by `similarity`. nodes: node, least (its smallest doc_id), prints and bands.

    Candidates have a fingerprint within WIDE bits, found by pigeonring chains, or share a band. A cluster of over `cluster_rows` texts is dealt into shares of about so many, and a task compares one share with another:
    two shares of texts at most are in one task, however large the cluster is.
    """
    found = C.stored(nodes.select("node", F.posexplode("prints").alias("k", "fp")).groupBy("k", "fp").agg(F.min("node").alias("node")), "prints")
    # Equal fingerprints are one in the search; the texts that have one are joined like those of a band.
    equal = F.transform("prints", lambda fp, k: F.xxhash64(fp, k))
    dealt = nodes.select("node", F.explode(F.concat("bands", equal)).alias("bucket"))
    low = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "low")
    # All that shares a bucket comes into one cluster, so that each text travels to its cluster once.
    banded = dealt.join(low, "bucket").where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    loose = components(near_links(found, WIDE).union(banded), "loose")
    members = loose.union(loose.select(F.col("root").alias("node"), "root").distinct())
    # Tile (i, j), i <= j, asks with share i among the texts of share j.
    blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / cluster_rows).alias("blocks"))
    members = members.join(nodes.select("node", "least", "prints"), "node").join(blocks, "root").select(F.col("node").alias("_node"), "root", "blocks", "least", "prints")
    texts = _with_node(docs, id_col, text_col)
    texts = texts.join(members.hint("merge"), (texts["node"] == members["_node"]) & texts["doc_id"].eqNullSafe(members["least"]))
    texts = texts.withColumn("turn", F.pmod("node", "blocks"))
    shares = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asking = F.transform(F.filter(shares, lambda j: j >= F.col("turn")), lambda j: F.struct((F.col("turn") * F.col("blocks") + j).alias("block"), F.lit(True).alias("asks")))
    asked = F.transform(F.filter(shares, lambda i: i < F.col("turn")), lambda i: F.struct((i * F.col("blocks") + F.col("turn")).alias("block"), F.lit(False).alias("asks")))
    texts = texts.select("root", "node", "text", "prints", F.inline(F.concat(asking, asked))).select("root", "block", "node", "text", "asks", "prints")
    texts = texts.repartition("root", "block").sortWithinPartitions("root", "block")
    return texts.mapInArrow(lambda batches: _confirmed(batches, size, similarity), "a long, b long")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of smallest id; all columns.

    Groups are the components over pairs of texts whose sets of `size`-word shingles have a Jaccard similarity of
    `similarity` at least. Rows of one text (one 64-bit hash) are one node. Ids may repeat on different texts: every group
    with an id keeps exactly one row that has an id. Rows with a null id stay, and link others.
    """
    marks = C.stored(sketches(docs, size, id_col, text_col), "sketches")
    nodes = C.stored(marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("prints").alias("prints"), F.first("bands").alias("bands")), "texts")
    roots = components(similar_links(docs, nodes, size, similarity, id_col, text_col))
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = C.stored(named, "groups")
    first = named.where("least is not null").groupBy("root").agg(F.min(F.struct("least", "node")).alias("first"))
    named = named.join(first, "root").select("node", "first")
    # Only ids and hashes travel here; the texts of rows that stay are joined once, against the rows that go.
    stays = (F.col("doc_id") == F.col("first.least")) & (F.col("node") == F.col("first.node"))
    found = C.stored(marks.where("doc_id is not null").select("doc_id", "node").join(named, "node").select("doc_id", "node", stays.alias("stays")), "rows")
    gone = found.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_text")).distinct()
    text = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    # The list grows with the corpus, so it is never broadcast.
    kept = docs.join(gone.hint("merge"), (docs[id_col].cast("long") == gone["_gone"]) & (text == gone["_text"]), "left_anti")
    repeated = found.where("stays").groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("_repeated"), F.col("node").alias("_text"))
    if not repeated.limit(1).count():
        return kept
    text = F.xxhash64(F.coalesce(kept[text_col].cast("string"), F.lit("")))
    match = (kept[id_col].cast("long") == repeated["_repeated"]) & (text == repeated["_text"])
    return kept.join(repeated, match, "left_anti").unionByName(kept.join(repeated, match, "left_semi").dropDuplicates([id_col, text_col]))
