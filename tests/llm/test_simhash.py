import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.llm import simhash
from pixelloom.llm.queries import op6_simhash


def brute_fp(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é\t\n\x1c\xa0Ω", max_size=60), min_size=1, max_size=6))
def test_fingerprints(texts):
    assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == [brute_fp(t) for t in texts]


def flips(base, n, most, rng):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return out


def test_pigeonring_loses_no_link():
    """Every pair within the distance is found from some start, whatever its bits are."""
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        fps += flips(rng.getrandbits(64), 6, 4, rng)
    fp = np.array(sorted(set(fps)), np.uint64)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4}
    got = set()
    for start in range(simhash.SEGMENTS):
        group = np.unique(simhash._segment(fp, start), return_inverse=True)[1]
        for a, b in simhash.ring_links(start, fp, group, np.ones(len(fp), bool)):
            got |= set(zip(a.tolist(), b.tolist()))
    assert got == want and len(want) > 300


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_pair_blocks(monkeypatch, block):
    monkeypatch.setattr(simhash, "PAIR_BLOCK", block)
    rng = random.Random(6)
    fp = np.array(sorted(set(flips(12345, 60, 3, rng))), np.uint64)
    got = set()
    for start in range(simhash.SEGMENTS):
        group = np.unique(simhash._segment(fp, start), return_inverse=True)[1]
        for a, b in simhash.ring_links(start, fp, group, np.ones(len(fp), bool)):
            got |= set(zip(a.tolist(), b.tolist()))
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4}


@pytest.mark.parametrize("bucket_rows", [3, 1 << 20])
def test_links_connect_the_same_components(spark, bucket_rows):
    rng = random.Random(7)
    fps = sorted({x for _ in range(25) for x in flips(rng.getrandbits(64), 8, 5, rng)} | set(flips(99, 200, 4, rng)))
    rng.shuffle(fps)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    links = simhash.near_links(nodes, bucket_rows=bucket_rows)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_roots(fps)
    if bucket_rows > 3:
        assert links.count() <= simhash.SEGMENTS * len(fps)  # a forest, not all pairs


def test_long_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(4)
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_no_links(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(text, k, rng):
    words = text.split()
    words[rng.randrange(len(words))] = f"edit{k}"
    return " ".join(words)


def test_query_against_brute_force(spark, docs, awkward, prose, tmp_path):
    rng = random.Random(1)
    base = prose(400)
    rows = [r for r in awkward if r[0] is not None] + [(100 + k, edited(base, k, rng)) for k in range(40)] + [(200 + k, base.upper()) for k in range(5)] + [(300 + k, prose(30, k)) for k in range(20)]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, str(tmp_path)).collect()}
    rows.sort()
    fps = [brute_fp(t) for _, t in rows]
    want = {i: (f"{fp:016x}", rows[root][0]) for (i, _), fp, root in zip(rows, fps, brute_roots(fps))}
    assert got == want and got[1][1] == got[2][1] == got[3][1] == got[4][1] == 1


def test_null_ids_and_one_of_each(docs, awkward):
    rows = [*awkward, (None, "no id here."), (7, "a" * 20000)]
    found = simhash.near_duplicates(docs(rows, extra=True)).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] is None for r in found) == 2
    frame = docs(rows, extra=True)
    kept = simhash.one_of_each(frame)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame.columns and ids.count(None) == 2 and ids.count(7) == 1
    assert sorted(i for i in ids if i is not None) == [1, 5, 6, 7, 8, 9, 11, 12]


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0


def jaccard(x, y, size=5):
    a, b = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def replaced(text, n, name, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"{name}{i}"
    return " ".join(words)


@pytest.mark.parametrize("cluster_rows", [3, 4096])
def test_near_copies_of_four_fifths_go(docs, cluster_rows, monkeypatch):
    """Every pair of five-word similarity 0.8 or more is one group, nothing below it is."""
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (*simhash.similar_links.__defaults__[:-1], cluster_rows))
    rng = random.Random(3)
    rows = []
    for k in range(50):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400)))
        rows += [(4 * k, base)] + [(4 * k + j, replaced(base, max(1, len(base.split()) * j // 70), f"e{j}_", rng)) for j in (1, 2, 3)]
    rows.append((9999, " ".join(f"only{i}" for i in range(80))))
    root = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if abs(a - b) < 4 and jaccard(rows[a][1], rows[b][1]) >= 0.8]
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows, extra=True)).collect())
    assert kept == [rows[i][0] for i in range(len(rows)) if root[i] == i]
    wide = [(a, b) for a, b in near if (brute_fp(rows[a][1]) ^ brute_fp(rows[b][1])).bit_count() > simhash.DISTANCE]
    assert len(near) > 40 and len(wide) > 20  # what four bits alone leave in


def test_every_group_keeps_one_row(docs, prose):
    x, y = prose(60, 1), prose(60, 2)
    kept = simhash.one_of_each(docs([(5, x), (9, x), (5, y), (3, y)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, x), (3, y)])


def test_null_ids_link_others(docs):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[: 200 - k]) for k in (0, 30, 60)]  # first and last are alike only through the second
    kept = simhash.one_of_each(docs([(1, texts[0]), (None, texts[1]), (2, texts[2])])).collect()
    assert jaccard(texts[0], texts[2]) < 0.8 and sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


def test_rows_without_an_id_link_others(spark, docs, monkeypatch):
    rows = [(1, 0x0), (None, 0xF), (9, 0xFF), (None, 0xFF), (20, 0x7FFF000000000000), (None, -1)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame)
    got = simhash.near_duplicates(docs([])).collect()
    assert sorted((r["fp"], r["component_id"]) for r in got) == sorted([(0x0, 1), (0xF, 1), (0xFF, 1), (0xFF, 1), (0x7FFF000000000000, 20), (-1, None)])


def test_tiles_of_large_buckets_find_every_link(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp long")

    def groups(bucket_rows):
        parent = {f: f for f in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in simhash.near_links(nodes, bucket_rows=bucket_rows).collect():
            a, b = root(r["a"]), root(r["b"])
            parent[max(a, b)] = min(a, b)
        return {f: root(f) for f in signed}

    whole = groups(1 << 20)
    assert groups(3) == whole and groups(10) == whole and 12 <= len(set(whole.values())) < len(fps)


def test_wider_pigeonring_loses_no_link():
    rng = random.Random(8)
    fp = np.array(sorted({x for _ in range(60) for x in flips(rng.getrandbits(64), 6, 7, rng)}), np.uint64)
    for distance in (2, 6, 7, 8, 11):
        got = set()
        for start in range(len(simhash.cuts_of(distance)) - 1):
            group = np.unique(simhash._segment(fp, start, distance), return_inverse=True)[1]
            for a, b in simhash.ring_links(start, fp, group, np.ones(len(fp), bool), distance):
                got |= set(zip(a.tolist(), b.tolist()))
        assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= distance}


@pytest.mark.parametrize("bucket_rows", [20, 1 << 20])
def test_wider_links_connect_the_same_components(spark, bucket_rows):
    """Several fingerprints of a node, each searched among its own kind."""
    rng = random.Random(9)
    prints = [sorted({x for _ in range(12) for x in flips(rng.getrandbits(64), 6, 6, rng)}) for _ in range(2)]
    rows = [(100 * k + i, k, x - (1 << 64) if x >> 63 else x) for k in (0, 1) for i, x in enumerate(prints[k])]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, k int, fp long"), 7, bucket_rows)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    for k in (0, 1):
        assert [roots.get(100 * k + i, 100 * k + i) - 100 * k for i in range(len(prints[k]))] == brute_roots(prints[k], 7)


def test_fingerprints_of_shingle_sets():
    texts = ["a b c d e f a b c d e f", "x", "", " ".join(f"w{i}" for i in range(300))]
    prints = simhash.prints_of([simhash.shingle_set(t.encode(), 5) for t in texts])
    assert prints.shape == (4, simhash.PRINTS) and prints[1, 0] == brute_fp("x", 5) and prints[3, 0] == brute_fp(texts[3], 5) and not prints[2].any()
    assert len(set(prints[3].tolist())) == simhash.PRINTS


def test_near_copies_are_found_by_fingerprints(docs):
    """The stage's candidates come from the SimHash search, also where no band is shared."""
    rng = random.Random(10)
    rows = []
    for k in range(30):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
        rows += [(2 * k, base), (2 * k + 1, replaced(base, 3, "e", rng))]
    marks = simhash.sketches(docs(rows), 5, "doc_id", "text").withColumn("bands", F.array("doc_id"))
    ids = {r["node"]: r["doc_id"] for r in marks.collect()}
    links = simhash.similar_links(docs(rows), marks.withColumnRenamed("doc_id", "least")).collect()
    assert sorted(sorted((ids[r["a"]], ids[r["b"]])) for r in links) == [[2 * k, 2 * k + 1] for k in range(30)]
    assert all(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.9 for k in range(30))
