import random
from collections import defaultdict

import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.llm.components import components


def brute_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        c = c.lower() if c.isascii() else c
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    """(id, fingerprint, smallest id reachable) of (id, text) rows."""
    prints = [(k, brute_fingerprint(t)) for k, t in rows]
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = defaultdict(list)
    for (k, _), g in zip(prints, group, strict=True):
        if k is not None:
            least[g].append(k)
    return sorted(((k, f"{f:016x}", min(least[g], default=None)) for (k, f), g in zip(prints, group, strict=True)), key=str)


def near(rnd, n):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([2, 5, 80, 300]))]
        for copy in range(rnd.choice([1, 1, 4])):
            t = list(text)
            for _ in range(copy):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows) * 3 % 1000 + base, " ".join(t)))
    return rows


@pytest.mark.parametrize("cell", [2048, 2])
def test_against_brute_force(spark, odd_rows, cell):
    rows = [(r[0], r[1]) for r in odd_rows] + near(random.Random(cell), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, cell=cell).collect()), key=str)
    assert got == brute(rows)


def test_many_copies_and_finer_keys(spark, monkeypatch):
    """Every way round a hot key: copies by broadcast, keys cut finer and then into chunks, too many keys to broadcast."""
    rnd = random.Random(6)
    text = [f"w{rnd.randrange(300)}" for _ in range(400)]
    rows = [(k, " ".join(text)) for k in range(50)]
    for k in range(50, 150):
        t = list(text)
        t[rnd.randrange(400)] = f"w{rnd.randrange(300)}"
        rows.append((k, " ".join(t)))
    rows += near(rnd, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    ids = {k for k, _, c in expected if k == c}
    for copies, share, cell in ((5, 100_000, 3), (5, 2, 3), (1000, 0, 20)):
        monkeypatch.setattr(simhash, "COPIES", copies)
        monkeypatch.setattr(simhash, "HOT_SHARE", max(share, 1))
        assert sorted((tuple(r) for r in simhash.near_duplicates(docs, cell=cell).collect()), key=str) == expected
    assert {r.doc_id for r in simhash.deduplicate(docs, cell=20).collect()} == ids


def test_deduplicate(spark, odd, odd_rows):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    expected = {k for k, _, c in brute([(r[0], r[1]) for r in odd_rows]) if k == c and k is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected) and ids.count(None) == 3


def test_one_row_of_each_group(spark):
    """Repeated ids over several groups, and null ids."""
    rnd = random.Random(8)
    texts = {k: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rnd.randrange(99)) for _ in range(50)) for k in "pqrst"}
    rows = [(5, "p"), (5, "q"), (5, "q"), (9, "q"), (2, "r"), (5, "r"), (None, "p"), (None, "s"), (None, "s"), (7, "t"), (None, "t")]
    docs = spark.createDataFrame([(k, texts[t], t) for k, t in rows], "doc_id long, text string, a string")
    got = simhash.deduplicate(docs, null_ids_stay=False)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.a) for r in got.collect()), key=str) == [(2, "r"), (5, "p"), (5, "q"), (7, "t"), (None, "s")]
    named = [(r.doc_id, r.a) for r in simhash.deduplicate(docs).collect()]
    assert sorted((k for k in named if k[0] is not None)) == [(2, "r"), (5, "p"), (5, "q"), (7, "t")] and len(named) == 8


def test_pivots_are_apart():
    apart = {(int(a) ^ int(b)).bit_count() for k, a in enumerate(simhash.PIVOTS) for b in simhash.PIVOTS[:k]}
    assert apart == {32} and simhash.PIVOTS[0] == 0


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.deduplicate(empty).collect() == []


def test_text_in_pieces(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text) == whole


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: r for n, r in root.items() if n not in loops}
