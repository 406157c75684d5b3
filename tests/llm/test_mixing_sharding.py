import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, sharding


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "word " * (1 + k % 9), f"s{0 if k % 2 else k % 5}") for k in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def used(rows):
    have, took = Counter(), Counter()
    for r in rows:
        have[r.source] += r.n_tokens
        took[r.source] += r.n_tokens * r.copies
    return have, took


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_repetition_limit(docs, block):
    rows = mixing.mixture(docs, max_repeats=2.0, block_tokens=block).collect()
    have, took = used(rows)
    reps = {s: took[s] / have[s] for s in have}
    assert min(r.copies for r in rows) == 1 and 1.9 < max(reps.values()) < 2.02
    weights = {r.source: r.weight for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-9
    total = sum(took.values())
    assert all(abs(took[s] / total - weights[s]) < 0.01 for s in have)
    if block == 100:
        copies = defaultdict(set)
        for r in rows:
            copies[r.source].add(r.copies)
        assert any(len(c) == 2 for c in copies.values())


def test_target_entropy_and_budget(docs):
    rows = mixing.mixture(docs, budget=5000, target_entropy=0.9).collect()
    have, took = used(rows)
    weights = {r.source: r.weight for r in rows}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert abs(entropy - 0.9) < 0.01
    assert all(abs(took[s] - weights[s] * 5000) <= 10 for s in have)


def test_mix_repeats_rows(docs):
    plan = {r.doc_id: r.copies for r in mixing.mixture(docs, max_repeats=2.0).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs, max_repeats=2.0).collect())
    assert got == Counter(plan) and mixing.mix(docs, max_repeats=2.0).columns == docs.columns


def test_order_of_the_passes(docs):
    """Blocks by rank, and a partial pass that is a beginning of a whole one."""
    rows = mixing.mixture(docs, max_repeats=2.0, block_tokens=100).collect()
    plan = {r.doc_id: r for r in rows}
    copies = mixing.mix(docs, max_repeats=2.0, block_tokens=100, ordered=True).collect()
    assert sorted((r.doc_id, r["pass"], r.block_rank, r.place) for r in copies) == sorted((r.doc_id, k, r.block_rank, r.place) for r in rows for k in range(1, r.copies + 1))
    parts = 0
    for source in {r.source for r in rows}:
        passes = defaultdict(list)
        for r in sorted((r for r in copies if r.source == source), key=lambda r: (r["pass"], r.block_rank, r.place)):
            passes[r["pass"]].append(r.doc_id)
        for ids in passes.values():
            assert ids == passes[1][: len(ids)]
            parts += len(ids) < len(passes[1])
        assert len({plan[i].block_rank for i in passes[1]}) > 1
    assert parts


def test_mixing_odd_rows(odd, odd_rows, empty):
    rows = mixing.mixture(odd, max_repeats=3.0).collect()
    assert len(rows) == len(odd_rows) and all(r.copies >= 1 for r in rows)
    assert mixing.mix(odd, max_repeats=3.0).columns == odd.columns
    assert mixing.mixture(empty, max_repeats=2.0).collect() == [] and mixing.mix(empty, max_repeats=2.0).collect() == []


def whole(rows, n, shards=24):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


@pytest.mark.parametrize("bucket", [16 << 20, 2000])
def test_sharding(docs, bucket):
    rows = sharding.assignment(docs, bucket_bytes=bucket).collect()
    whole(rows, 2000)
    again = sharding.assignment(docs.repartition(7), bucket_bytes=bucket).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in rows)


def test_many_equal_rows(spark):
    rows = spark.createDataFrame([(7, "same text")] * 3000 + [(k, f"text {k}") for k in range(3000)], "doc_id long, text string")
    whole(sharding.assignment(rows, bucket_bytes=4000).collect(), 6000)
    whole(sharding.shard(rows, bucket_bytes=4000).collect(), 6000)


def test_sharding_odd_rows(odd, odd_rows, empty, tmp_path, spark):
    whole(sharding.assignment(odd).collect(), len(odd_rows))
    rows = sharding.shard(odd)
    assert rows.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert sorted((r.text or "", str(r.doc_id)) for r in rows.collect()) == sorted((r[1] or "", str(r[0])) for r in odd_rows)
    assert sharding.assignment(empty).collect() == [] and sharding.shard(empty).collect() == []
    sharding.write(odd, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows)


def plain_copies(rows, h, numbers, block, limit):
    """How often each row is used, by loops; h: each row's hash, numbers: each source's pair for its permutation."""
    have = Counter()
    for _, text, source in rows:
        have[source] += len((text or "").split())
    have = {s: n for s, n in have.items() if n}
    total, steps = sum(have.values()), 1 << 20
    most = lambda a: max((n / total) ** (a - 1) for n in have.values()) / min((n / total) ** (a - 1) for n in have.values())
    lo, hi = 0, steps
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if most(mid / steps) <= limit + 1e-9 else (mid + 1, hi)
    alpha = lo / steps
    least = min((n / total) ** (alpha - 1) for n in have.values())
    out = {}
    for source in {s for _, _, s in rows}:
        mine = [(h[k], k, len((t or "").split())) for k, t, s in rows if s == source]
        if source not in have:
            out |= {k: 1 for _, k, _ in mine}
            continue
        n = have[source]
        passes, rest = divmod(round((n / total) ** (alpha - 1) / least * n), n)
        blocks, (a, c), prime = max(1, -(-n // block)), numbers[source], 2**31 - 1
        walk = sorted(((a * (x % blocks) + c) % prime, x, k, t) for x, k, t in mine)
        used = set()
        for _, _, k, t in walk:
            if rest <= 0:
                break
            used.add(k)
            rest -= t
        out |= {k: passes + (k in used) for _, k, _ in mine}
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_copies_against_loops(spark, block):
    rnd = random.Random(block)
    rows = [(k, " ".join("w" * (1 + j % 3) for j in range(1 + k * k % 17)), rnd.choice(["big", "big", "big", "mid", "mid", "small", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    light = docs.select("doc_id", "source", mixing.row_hash("doc_id", "text", mixing.SEED).alias("h")).collect()
    pairs = docs.select("source", *[F.xxhash64(F.lit(mixing.SEED), F.lit(x), "source").alias(x) for x in "ac"]).distinct().collect()
    numbers = {r.source: (r.a % (mixing._PRIME - 1) + 1, r.c % mixing._PRIME) for r in pairs}
    got = {r.doc_id: r.copies for r in mixing.mixture(docs, max_repeats=3.0, block_tokens=block).collect()}
    assert got == plain_copies(rows, {r.doc_id: r.h for r in light}, numbers, block, 3.0) and len(set(got.values())) == 3


def permutation(n, seed):
    """Fisher and Yates' shuffle of 0 to n - 1, from inside out, drawn from a Mersenne twister seeded with two words."""
    twister = random.Random(seed << 32)

    def below(k):
        if k & -k == k:
            return k * twister.getrandbits(31) >> 31
        while True:
            bits = twister.getrandbits(31)
            if bits - bits % k + k - 1 < 1 << 31:
                return bits % k

    out = []
    for k in range(n):
        j = below(k + 1)
        out.append(out[j] if j < k else k)
        out[j] = k
    return out


def plain_shards(rows, keys, bucket_bytes, of_bucket, order, shards=24):
    """Two passes by loops: lots into buckets, then each bucket shuffled; (row, shard, slot) of every row."""
    lots = Counter(keys)
    most = max(1, bucket_bytes // 4 // 64)
    dealt = defaultdict(list)
    for (a, b), n in lots.items():
        for lot in range(-(-n // most)):
            dealt[of_bucket[a, b, lot]].append((order[a, b, lot], a, b, lot, min(most, n - lot * most)))
    row = dict(zip(keys, rows, strict=True))
    out = []
    for bucket in sorted(dealt):
        records = [row[a, b] for _, a, b, _, n in sorted(dealt[bucket]) for _ in range(n)]
        out += [records[k] for k in permutation(len(records), sharding.SEED)] if len(dealt) == 1 else records
    first = [-(-s * len(rows) // shards) for s in range(shards + 1)]
    return [(r, s, k - first[s]) for s in range(shards) for k, r in enumerate(out[first[s] : first[s + 1]], first[s])]


@pytest.mark.parametrize("bucket", [16 << 20, 3000])
def test_shards_against_loops(spark, bucket):
    """With one bucket row by row; with several, the rows of each bucket by place, since each task draws its own order."""
    rows = [(k, f"text {k}") for k in range(300)] + [(1000, "same")] * 100 + [(None, None)] * 60 + [(None, ""), (5, "text 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs, docs.repartition(7, "text")):
        got = sharding.assignment(d, bucket_bytes=bucket).collect()
        table = sharding._records(d, [F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")], False, "doc_id", "text", sharding.SEED).collect()
        keys = [(r.a, r.b) for r in table]
        plain = [(r.record.id, len(r.record.text) + 8, zlib.crc32(r.record.text.encode())) for r in table]
        n = max(1, -(-64 * len(rows) // bucket))
        lots = spark.createDataFrame([(a, b, lot) for a, b in set(keys) for lot in range(20)], "a long, b long, lot long")
        lots = lots.select("a", "b", "lot", F.pmod(F.xxhash64(F.lit(sharding.SEED + 2), "a", "b", "lot"), F.lit(n)).alias("bucket"), F.xxhash64(F.lit(sharding.SEED + 3), "a", "b", "lot").alias("order")).collect()
        expected = plain_shards(plain, keys, bucket, {(r.a, r.b, r.lot): r.bucket for r in lots}, {(r.a, r.b, r.lot): r.order for r in lots})
        mine = [((r.doc_id, r.size, r.text_crc32), r.shard, r.slot) for r in got]
        by_place = lambda rs: [x[0] for x in sorted(rs, key=lambda x: x[1:])]
        if n == 1:
            assert sorted(mine, key=str) == sorted(expected, key=str)
        else:
            sizes, at = Counter(), 0
            for (a, b), count in Counter(keys).items():
                most = bucket // 4 // 64
                for lot in range(-(-count // most)):
                    sizes[next(r.bucket for r in lots if (r.a, r.b, r.lot) == (a, b, lot))] += min(most, count - lot * most)
            assert max(sizes.values()) * 64 < 3 * bucket
            for bkt in sorted(sizes):
                assert Counter(by_place(mine)[at : at + sizes[bkt]]) == Counter(by_place(expected)[at : at + sizes[bkt]])
                at += sizes[bkt]
        whole(got, len(rows))


def test_equal_rows_are_dealt_alike(spark):
    """Many equal rows, split in any way: the same rows at the same places."""
    rows = spark.createDataFrame([(7, "same text", None, "a")] * 3000 + [(k, f"text {k}", "x", None) for k in range(1000)], "doc_id long, text string, lang string, source string")
    for f in (sharding.assignment, sharding.shard):
        one, other = (sorted(map(tuple, f(d, bucket_bytes=4000).collect()), key=str) for d in (rows, rows.repartition(9)))
        assert one == other and len(one) == 4000
