import numpy as np
import xxhash
from pyspark.sql import functions as F

from kindred.llm import simhash
from kindred.llm.components import components

from .helpers import BASE, TEXTS, awkward, empty, same_columns


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_labels(fps, radius=2):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprints():
    for t in TEXTS[:11] + TEXTS[12:]:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_long_text_in_blocks():
    text = " ".join(f"w{i}" for i in range(40_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def _planted(rng, n, groups):
    fps = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for g in range(groups):
        at = fps[g]
        for _ in range(30):
            at ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.append(at)
    dense = fps[-1]
    fps += [dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    return sorted(set(fps))


def test_tree_and_shards_find_all_links():
    rng = np.random.default_rng(4)
    fps = np.array(_planted(rng, 900, 6), np.uint64)
    want = {}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    pairs = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}
    for depth in (0, 1, 4):
        tree = simhash.UpperTree(fps[::3], depth, 2)
        at, shard, home = tree.deal(fps)
        assert sorted(at[home]) == list(range(len(fps)))
        together = {s: set(at[shard == s]) for s in range(tree.shards)}
        homes = {int(i): int(s) for i, s in zip(at[home], shard[home])}
        for a, b in pairs:
            assert b in together[homes[a]] or a in together[homes[b]]
        edges = []
        for s in together:
            mine = at[shard == s]
            label = simhash.ShardSearch(fps[mine], home[shard == s], 2).label
            edges += [(mine[i], mine[label[i]]) for i in range(len(mine)) if label[i] != i]
        want[depth] = _merge(len(fps), edges)
    assert want[0] == want[1] == want[4] == _merge(len(fps), pairs)


def _merge(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(j) for j in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 61)), [100, *range(200, 260)], [300, 301]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    texts = TEXTS[:11] + TEXTS[12:]
    docs = awkward(spark, texts)
    rows = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    plain = [*texts, texts[-1]]
    fps = [brute_fingerprint(t) for t in plain]
    label = brute_labels(fps)
    for r in rows:
        i = r.doc_id if r.doc_id is not None else len(plain) - 1
        assert r.fp % 2**64 == fps[i] and r.component_id == label[i]
    hexes = simhash.near_duplicates(docs.select("doc_id", "text")).select(simhash.hex_digits(F.col("fp"))).collect()
    assert all(len(h[0]) == 16 for h in hexes)


def test_keep_one(spark):
    docs = awkward(spark)
    out = simhash.keep_one(docs)
    assert same_columns(out, docs)
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp.values()))
    assert simhash.keep_one(empty(spark)).count() == 0


def test_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None, None]
    assert simhash.keep_one(docs).count() == 1


def test_keep_one_goes_by_row(spark):
    """Rows that share an id, or have none, are judged by their texts."""
    a, b, c = ("alpha " + BASE, "".join(f"beta{i} " for i in range(50)), "".join(f"gamma{i} " for i in range(50)))
    rows = [(3, a), (7, a), (7, b), (None, b), (None, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(3, a), (7, b), (0, c)])
