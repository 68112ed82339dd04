"""Packing, centroid clusters and the Merkle manifest against plain versions."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aftershock.llm import clusters, merkle, packing, queries
from aftershock.llm.ranks import ranked
from aftershock.llm.vocabulary import tokenizer_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("byte_bpe_50k.json")


# --- numbering


def test_ranks_follow_the_order_within_each_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", ""]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    found = ranked(df, "g", ["k", "i"]).collect()
    for group in {r.g for r in found}:
        mine = sorted((r for r in found if r.g == group), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(len(mine)))
        keys = [(r.k is not None, r.k or 0, r.i) for r in mine]
        assert keys == sorted(keys)


def test_equal_rows_are_numbered_over_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.lit(1).alias("k")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked(df, "g", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.agg(F.count_distinct("rank"), F.max("rank")).first() == (20_000, 19_999)
    assert len(found.inputFiles()) > 1


# --- packing


def filled(steps):
    """Sequences of a plan as lists of (offset, length, number of the piece)."""
    out = {}
    for s in steps:
        for i in range(s.count):
            out.setdefault(s.sequence + i // s.each, []).append((s.offset + i % s.each * s.length, s.length, s.first + i))
    return out


def one_by_one(counts, capacity):
    """The same method piece by piece; the number of sequences."""
    pieces = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    large, small = [p for p in pieces if 3 * p > capacity], [p for p in pieces if 3 * p <= capacity]
    gaps = []
    while large:
        gap = capacity - large.pop(0)
        beside = next((p for p in large if p <= gap), None)
        if beside is not None:
            large.remove(beside)
            gap -= beside
        gaps.append(gap)
    for piece in small:
        fits = [g for g in gaps if g >= piece]
        gap = min(fits, default=capacity)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - piece)
    return len(gaps)


def fewest(pieces, capacity):
    """Fewest sequences, by trying all places."""
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {*rooms}:
            if room >= pieces[i]:
                again = list(rooms)
                again.remove(room)
                go(i + 1, [*again, room - pieces[i]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 12)), st.sampled_from([60, 61, 90, 100]))
def test_plan_places_every_piece_once(counts, capacity):
    sequences = filled(packing.plan(counts, capacity))
    assert sorted(sequences) == list(range(len(sequences)))
    placed = sorted((length, number) for pieces in sequences.values() for _, length, number in pieces)
    assert placed == [(n, i) for n in sorted(counts) for i in range(counts[n])]
    for pieces in sequences.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length, _ in pieces) <= 2
    assert len(sequences) == one_by_one(counts, capacity)


def test_plan_comes_near_the_fewest_sequences():
    rng, more = random.Random(4), 0
    for _ in range(60):
        pieces = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {n: pieces.count(n) for n in pieces}
        got, least = len(filled(packing.plan(counts, 30))), fewest(pieces, 30)
        assert got <= least + 1
        more += got - least
    assert more <= 6
    large = {n: rng.randint(0, 4) for n in range(11, 31)}  # above a third only: the matching is the best there is
    few = [n for n in large for _ in range(min(large[n], 1))][:9]
    assert len(filled(packing.plan({n: 1 for n in few}, 30))) == fewest(sorted(few, reverse=True), 30)


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 10**10) for n in range(1, 2049)}
    steps = packing.plan(counts)
    assert len(steps) < 20_000
    sequences = max(s.sequence + -(-s.count // s.each) for s in steps)
    assert sequences >= sum(n * c for n, c in counts.items()) / 2048
    assert all(sum(s.count for s in steps if s.length == n) == counts[n] for n in (1, 700, 1024, 2048))
    with pytest.raises(ValueError):
        packing.plan({2049: 1})
    assert packing.plan({}) == []


def check_packing(rows, documents, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    want = []
    for doc, text in documents:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(itertools.pairwise(cuts)):
            want.append((doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = {}
    sequences = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) == one_by_one(counts, capacity)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other"), (None, "no id"), (4, "word " * 5000), (5, "<|endoftext|> x"), (6, "漢字" * 300)]


def test_packing_of_odd_documents(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    df = df.withColumn("length", F.lit(1)).withColumn("task", F.lit("t")).withColumn("sequence_id", F.lit(2)).repartition(4)
    for capacity in (16, 2048):
        check_packing(packing.digests(packing.pack(df, BPE, capacity)).collect(), ODD, capacity)
    assert packing.digests(packing.pack(df.limit(0), BPE)).collect() == []


def test_packed_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for row in packing.pack(df, BPE, 64).collect():
        ends = list(itertools.accumulate(p.length for p in row.pieces))
        assert [p.offset for p in row.pieces] == [0, *ends[:-1]] and ends[-1] <= 64
        assert all(len(p.ids) == 2 * p.length for p in row.pieces)


def test_packing_query(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_packing(spark, SF).collect()
    check_packing(rows, [tuple(d) for d in documents], 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= math.ceil(total / 2048) * 1.02 + 1


# --- clusters


def plain_clusters(vectors, count, rounds):
    """Kept (id, scaled vector) rows -> id, cluster, distance."""
    start = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in vectors]
        for n in {*found}:
            mine = [v for (_, v), f in zip(vectors, found) if f == n]
            centroids[n] = [sum(xs) // len(mine) for xs in zip(*mine)]
    return [(i, n, d) for i, v in vectors for d, n in [nearest(v)]], centroids


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_clusters_equal_a_plain_version(spark, kind):
    rng = random.Random(kind)
    n = {"spread": 300, "ties": 200, "few": 3}[kind]
    values = (lambda: [rng.gauss(rng.choice([-3, 0, 4]), 1) for _ in range(4)]) if kind == "spread" else (lambda: [rng.choice([0.0, 0.25]) for _ in range(4)])
    rows = [(i % 150, values()) for i in range(n)] + [(None, values())]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("-inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    df = df.withColumn("cluster", F.lit("x")).withColumn("v", F.lit(0)).repartition(3)
    got = clusters.clustered(df, count=7, rounds=3, components=4).collect()
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want, centroids = plain_clusters(kept, 7, 3)
    key = lambda r: repr(tuple(r))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert clusters.clustered(df.limit(0)).collect() == []


def test_search_is_exact_and_spares_distances():
    rng = np.random.default_rng(2)
    for scale, components, shift in ((3, 2, 0), (1000, 64, 800), (1 << 20, 64, 0), (1, 1, 0)):
        middle = rng.integers(-shift - 1, shift + 2, (50, 1))
        centroids = rng.integers(-scale, scale + 1, (50, components)) + middle
        vectors = centroids[rng.integers(0, 50, 2000)] + rng.integers(-1, 2, (2000, components)) * (scale // 8)
        search = clusters.Search(centroids)
        number, distance = search.nearest(vectors)
        all_ = np.square(vectors[:, None, :] - centroids[None]).sum(axis=2)
        assert (distance == all_.min(axis=1)).all() and (number == all_.argmin(axis=1)).all()
        if shift:
            assert search.computed < 0.3 * all_.size
    large = np.array([[1 << 27, -(1 << 27)] * 32, [-(1 << 27), 1 << 27] * 32])
    assert clusters.Search(large[:1]).nearest(large[1:])[1][0] == 64 * (1 << 28) ** 2


def test_components_too_large_for_a_distance_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2"):
        clusters.clustered(df).collect()


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes):
    """Root, and for each leaf its siblings and a function from leaf to root."""
    at, proofs, paths = list(range(len(nodes))), [""] * len(nodes), [[] for _ in nodes]
    level = list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i - i % 8 : i - i % 8 + 8]
            left, right = "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            proofs[leaf] += left + right
            paths[leaf].append((left, right))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs, paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = {}
    for doc, source, lang, n, text in rows:
        head = field(doc) + field(source) + field(lang) + field(n)
        leaf = h(head, field(text))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        changed = h(head, field(None if text is None else text.translate(lower))) if tampered else leaf
        langs.setdefault(lang, []).append((doc is not None, doc or 0, leaf, changed, doc))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: r[:3])
        trees[lang] = plain_tree([r[2] for r in langs[lang]])
    root, top_proofs, top_paths = plain_tree([trees[k][0] for k in order]) if order else (None, [], [])
    out = []
    for lang, above, path in zip(order, top_proofs, top_paths):
        subroot, proofs, paths = trees[lang]
        for (_, _, leaf, changed, doc), proof, own in zip(langs[lang], proofs, paths):
            folded = changed
            for left, right in own + path:
                folded = h(left, folded, right)
            out.append((doc, leaf, subroot, root, h(proof + above), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check_manifest(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("grp", F.lit("g")).withColumn("rank", F.lit(0))
    got = [tuple(r) for r in merkle.tampered_manifest(df.repartition(partitions)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_odd_documents(spark):
    odd = [
        (1, None, None, None, None), (None, "s", None, 3, "ABC"), (None, "s", None, 3, "ABC"), (2, "é", "", 0, ""),
        (3, "s", "zz", 1, "Ä B"), (3, "s", "zz", 1, "other"), (-4, "s", "é", 5, "X" * 100_000), (12, "", "Z", None, "ÉA"),
    ]
    check_manifest(spark, odd)
    check_manifest(spark, odd[:1])
    check_manifest(spark, [(i, "s", chr(97 + i % 20), i, f"Text {i}") for i in range(100)])


def test_manifest_over_several_superblocks(spark):
    rows = [(i * 7 % 9001, "s", "en" if i < 8500 else "de", i, f"Text {i}") for i in range(9000)]
    check_manifest(spark, rows, 7)


def test_manifest_levels_above_the_superblocks(monkeypatch):
    """The reduction and the proofs of the module, superblock by superblock, with small superblocks."""
    for levels, count in ((1, 700), (2, 4097), (2, 64), (1, 9), (1, 8), (1, 1)):
        monkeypatch.setattr(merkle, "LEVELS", levels)
        check_superblocks([h(str(i)) for i in range(count)])


def check_superblocks(nodes):
    want = plain_tree(nodes)
    tables = [nodes]
    while len(tables[-1]) > 1:
        below = tables[-1]
        size = merkle.FANOUT**merkle.LEVELS
        tables.append([merkle._local(below[i : i + size], i // size)[-1][0] for i in range(0, len(below), size)])
    outs = [[]]
    for below in reversed(tables[:-1]):
        size = merkle.FANOUT**merkle.LEVELS
        outs = [
            merkle.siblings(merkle._local(below[i - i % size : i - i % size + size], i // size), i % size) + outs[i // size]
            for i in range(len(below))
        ]
    assert tables[-1][0] == want[0]
    assert ["".join(o) for o in outs] == want[1]
    assert all(merkle.fold(n, o) == want[0] for n, o in zip(nodes, outs))


def test_proofs_are_kept_on_request(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"Text {i}") for i in range(50)]
    leaves = merkle.document_leaves(spark.createDataFrame(rows, SCHEMA))
    for r in merkle.manifest(leaves, keep_proofs=True).collect():
        assert merkle.fold(r.leaf, r.proof) == r.root and r.verified
        assert h(*r.proof) == r.proof_sha256


def test_manifest_of_no_documents(spark):
    assert merkle.tampered_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
