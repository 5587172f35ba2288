from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from opalspan.llm import cover_tree, shingle_sets, simhash, suffix_dedup

DOCS = "doc_id long, text string, source string, label string"


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def messy(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 120))) for _ in range(n // 2)]
    while len(texts) < n:
        w = r.choice(texts).split()
        if w:
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += ["", None, "one", "One", texts[0], "x " * 20000]
    return [(k, t, "s", "clash") for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_simhash(spark, hot):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(12)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [tuple(x) for x in simhash.link_fingerprints(df, hot).collect()]
    exact = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert components(signed, links) == components(signed, exact)


def test_simhash_documents(spark):
    rows = messy(1)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fp = {k: simhash.fingerprint(t) for k, t, *_ in rows}
    assert {k: v[0] & (2**64 - 1) for k, v in got.items()} == fp
    want = components(fp, [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 3])
    assert {k: v[1] for k, v in got.items()} == want
    kept = simhash.one_of_each(spark.createDataFrame(rows + rows[:1], DOCS)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hot,hot_bytes", [(shingle_sets.HOT, shingle_sets.HOT_BYTES), (3, 10**9), (10**6, 2000)])
def test_shingle_sets(spark, hot, hot_bytes):
    rows = messy(4, 160)
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    base = r.choices(words, k=150)
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((1000 + k, " ".join(w).upper() if k % 2 else "\n ".join(w), "s", "c"))
    df = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x["component_id"] for x in shingle_sets.near_duplicates(df, hot, hot_bytes).collect()}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: grams(t) for d, t, *_ in rows}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    want = components(sets, [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])])
    assert got == want
    # changed words that move more than 3 bits of the fingerprint, which the stage must not keep
    fp = {d: simhash.fingerprint(t) for d, t, *_ in rows}
    far = [d for d in want if want[d] != d and not any((fp[d] ^ fp[k]).bit_count() <= 3 for k in fp if k < d)]
    kept = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert far and kept == set(want.values())
    assert shingle_sets.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_shingle_sets_by_fingerprint(spark):
    """SimHash on the ring proposes first: its groups are those of fingerprints within 3 bits, and bands are left only
    for what the sets have not confirmed by then."""
    r = random.Random(31)
    rows = []
    for k in range(12):
        w = [f"w{r.randrange(4000)}" for _ in range(400)]
        for c in range(6):  # one to five words changed, at the end
            rows.append((len(rows), " ".join(w[: 400 - c] + [f"v{r.randrange(9)}" for _ in range(c)]), "s", ""))
    rows += [(100 + k, f"a b c d {'e' if k % 2 else 'f'}", "s", "") for k in range(4)] + [(200, None, "s", ""), (201, "", "s", "")]
    df = spark.createDataFrame(rows, DOCS)
    marks = shingle_sets.marked(df)
    fp = {x["node"]: x["fp"] % 2**64 for x in marks.collect()}
    of = {x["doc_id"]: x["node"] for x in marks.collect()}
    ids = sorted(n for n in fp if n != of[200])
    for d, t, *_ in rows:
        h = [int(x) for x in shingle_sets.shingle_set(t)]
        assert fp[of[d]] == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    want = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 3])
    near = shingle_sets.by_fingerprint(marks.where("size(keys) > 0").select("node", "fp").distinct())
    got = {}
    for x in near.collect():
        got.setdefault(x["key"], set()).add(x["node"])
    groups = {}
    for n, low in want.items():
        groups.setdefault(low, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1) and len(got) >= 10
    sets = spark.createDataFrame([(of[d], shingle_sets.shingle_set(t).tobytes()) for d, t, *_ in rows], "node long, items binary").dropDuplicates(["node"])
    links = [tuple(x) for x in shingle_sets.confirmed(near, sets).collect()]
    assert len(links) >= 40 and all(len(got_sets) == 1 for got_sets in [{k for k, g in got.items() if {a, b} <= g} for a, b in links])
    held = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7), (3, 8), (3, 9)], "key long, node long")
    linked = spark.createDataFrame([(6, 5), (9, 5), (8, 5)], "node long, component long")
    assert {tuple(x) for x in shingle_sets.open_keys(held, linked).collect()} == {(2, 5), (2, 7)}
    sets = {d: set(shingle_sets.shingle_set(t).tolist()) for d, t, *_ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert {x["doc_id"]: x["component_id"] for x in shingle_sets.near_duplicates(df).collect()} == components(list(sets), near)


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raws):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    out = []
    for i, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if len(seen[b[p : p + length]]) > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out.append((len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_refine():
    r = np.random.default_rng(4)
    for length, letters in ((8, 2), (40, 2), (41, 1), (100, 3)):
        texts = [r.integers(97, 97 + letters, int(n)).astype(np.uint8).tobytes() for n in r.integers(0, 300, 12)]
        texts += [texts[1] * 2, texts[2][3:]]
        data = b"".join(texts)
        room = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
        bucket = suffix_dedup.refine(np.frombuffer(data, np.uint8), room, length)
        strings = [data[p : p + length] if room[p] >= length else None for p in range(len(data))]
        assert all((bucket[p] >= 0) == (s is not None and strings.count(s) > 1) for p, s in enumerate(strings) if p % 5 == 0)
        named = {}
        assert all(named.setdefault(b, s) == s for b, s in zip(bucket.tolist(), strings) if b >= 0) and len(set(named.values())) == len(named)


@pytest.mark.parametrize("hot,chunk", [(suffix_dedup.HOT, suffix_dedup.CHUNK), (10**6, 100), (3, 100)])
def test_suffix(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = random.Random(5)
    passage = "".join(r.choices("abcdé ", k=90))
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 200))) + r.choice([passage, passage[:45], passage[10:80], ""]) + "".join(r.choices("ab", k=r.randint(0, 30))) for _ in range(40)]
    texts += [None, "", "ab" * 60, "x" * 41, "y" * 40, texts[3], "z" * 3000]
    df = spark.createDataFrame([(k if k % 9 else None, t, "s", "c") for k, t in enumerate(texts)], DOCS)
    spans = suffix_dedup.repeated_spans(df, 40, hot)
    assert spans.columns == ["doc_id", "tkey", "s", "e"]
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (40, hot, None))
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(df, 40).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute_removal(texts, 40))
    # the longer length inside the runs of the shorter one
    two = sorted(tuple(x) for x in suffix_dedup.remove_repeats(df, 40, 16).select("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes").collect())
    assert two == sorted((*a, b[1]) for a, b in zip(brute_removal(texts, 40), brute_removal(texts, 16)))
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS), 40).count() == 0


def test_fingerprints_of_one_segment_pair(spark):
    """Fingerprints that share two segments crowd a key that has none of its own: they are sent by a neighbour."""
    r = random.Random(8)
    low = sorted({r.getrandbits(32) for _ in range(3000)})
    fps = [(x << 32) | (0b11 << 16) | 5 for x in low[:2990]] + [(x << 32) | (0b111 << 16) | 5 for x in low[2980:]] + [(low[0] << 32) | (0b10 << 16) | 5]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [tuple(x) for x in simhash.link_fingerprints(df, 200).collect()]
    u = np.array(fps, dtype=np.uint64)
    exact = [(signed[i], signed[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= 3).tolist()]
    assert len(exact) > 10 and components(signed, links) == components(signed, exact)
    runs = simhash.dealt_keys(df, 200).groupBy("key", "sub").count().agg({"count": "max"}).first()[0]
    assert runs <= 3 * 200


def test_cover_tree_prunes():
    """Vectors in tight groups: pairs of nodes that are far apart are never opened, and no link is lost."""
    r = np.random.default_rng(5)
    x = cover_tree.unit(np.repeat(r.standard_normal((64, 64)), 60, axis=0) + 0.05 * r.standard_normal((3840, 64)))
    tree = cover_tree.build(x)
    compared, found, check = 0, set(), cover_tree._check

    def counted(a, b, *rest):
        nonlocal compared
        compared += len(a) * len(b)
        return check(a, b, *rest)

    cover_tree._check = counted
    try:
        for i, j in cover_tree.dual(tree, tree, x, x, x, x, 0.95):
            found |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    finally:
        cover_tree._check = check
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    assert found == want and len(want) > 50_000 and compared < 0.25 * len(x) ** 2


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((30, 8))
    x = np.concatenate([base, base[:12] + 0.15 * r.standard_normal((12, 8)), base[:1] * 2, base[:1], -base[:1]])
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [1.0, None] * 4, 1), (104, [1.0], 1), (105, [2.0], 1), (None, [1.0] * 8, 1), (106, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(df, block=8).collect()}
    e = np.array([v for _, v, _ in rows[: len(x)]], dtype=np.float64)
    u = e / np.sqrt((e * e).sum(axis=1))[:, None]
    hit = (u @ u.T) >= 0.95
    want = components(range(len(x)), zip(*np.nonzero(hit)))
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (hit[k].sum() - 1, want[k], want[k] == k)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (100, 101, 102, 103, 106))
    assert got[105]["component_id"] == 104 and got[None]["n_links"] == 0 and not got[None]["kept"]
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_extreme_size(spark):
    """Components whose squares leave the range of doubles, in a batch of many blocks, against brute force on rows that are
    scaled back."""
    r = np.random.default_rng(21)
    base = np.abs(r.standard_normal((300, 16))) + np.repeat(3 * np.eye(16), 19, axis=0)[:300]
    base[40:60] = base[20:40] * (1 + 1e-9 * r.standard_normal((20, 16)))
    power = r.choice([0, 0, -200, 150, 200, -300], 300)
    rows = [(k, (base[k] * 10.0 ** int(power[k])).tolist()) for k in range(300)]
    unit = base / np.sqrt((base * base).sum(axis=1))[:, None]
    cos = unit @ unit.T
    assert not (np.abs(cos - 0.95) < 1e-12).any()
    linked = (cos >= 0.95) & ~np.eye(300, dtype=bool)
    assert 40 < linked.sum() < 300 * 200
    low = np.arange(300)
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], 300).min(axis=1))
        if (new == low).all():
            break
        low = new
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4, 50, 1000):
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in cover_tree.near_duplicates(df, block=block).collect()}
        assert got == {k: (int(linked[k].sum()), int(low[k])) for k in range(300)}


def test_visits_are_sliced(monkeypatch):
    """However many blocks a batch's vectors visit, a slice holds a bounded part of them, and none is lost."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    x = r.standard_normal((50, 4))
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array([1] * 50, pa.int64()), pa.array(x.tolist()), pa.array([4] * 50, pa.int32()), pa.array([k % 2 for k in range(50)], pa.int32()), pa.array([2.0] * 50)], names=["rep", "weight", "embedding", "width", "home", "far"])
    visit = cover_tree._visit({4: cover_tree.unit(r.standard_normal((2, 4)))}, {(4, 0): (2.0, 70), (4, 1): (2.0, 30)}, 0.95, 10)
    whole = [tuple(y[c] for c in ("a", "i", "b", "j", "side", "rep")) for b in visit([batch]) for y in b.to_pylist()]
    monkeypatch.setattr(cover_tree, "SLICE", 64)
    parts = list(visit([batch]))
    assert max(b.num_rows for b in parts) <= 64 and len(parts) > 5
    assert [tuple(y[c] for c in ("a", "i", "b", "j", "side", "rep")) for b in parts for y in b.to_pylist()] == whole
    assert len(whole) == 50 * (7 + 3) and all(y[:2] <= y[2:4] for y in whole)
