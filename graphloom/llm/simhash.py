"""Near-duplicates by SimHash fingerprints, searched with pivot distance tables.

A fingerprint has a bit set where more than half of the XXH64 hashes of the text's shingles have it set. Two
fingerprints link at `distance` or fewer differing bits. The search:

1. Equal fingerprints are merged, so a group of copies is one node however large it is.
2. The 64 bits are cut into `distance + 2` blocks; linked fingerprints agree on at least two of them, so each pair of
   blocks is an exact equi-join key (10 keys for a distance of 3). No pairs are made at this point.
3. A key held by more than CELL fingerprints is cut finer by the bits it leaves open, in distance + 1 parts of which
   linked fingerprints share one. What is still larger is dealt into chunks, and every pair of chunks becomes a cell of
   its own, so no task holds an unbounded group.
4. In a cell, each fingerprint's Hamming distances to PIVOTS reference fingerprints form its pivot table. By the
   triangle inequality linked fingerprints differ by at most `distance` in every coordinate. Rows are sorted by the
   first coordinate, a window slides over it, the other coordinates discard pairs by their largest difference, and
   survivors are compared bit by bit.
5. A cell returns a spanning forest of its links, never all pairs, and `components.labels` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, materialize, text_of
from graphloom.llm.components import labels

SEED = 42
SHINGLE = 3
DISTANCE = 3
CELL = 2048
#: A text with more copies than this is handled apart from others, so that no task gets all of its rows.
COPIES = 1000
#: So many keys are broadcast at most. There are always fewer that hold more than this part of all rows each.
HOT_SHARE = 100_000
#: Into so many parts the rows of a component are dealt where they meet its smallest id.
PARTS = 64
#: Reference fingerprints: Walsh patterns, any two of which differ in exactly half of the bits. On 47,223 distinct
#: fingerprints the keys leave 10,106 pairs, of which 4,398 are links; 8 patterns leave 6,174, 16 leave 5,109, 32 leave
#: 4,630 and 64 leave 4,482 to the comparison of all bits.
N_PIVOTS = 32
PIVOTS = np.array([sum(((row & bit).bit_count() & 1) << bit for bit in range(64)) for row in range(N_PIVOTS)], np.uint64)
_LANES = np.uint64(0x0101010101010101)
_PIECE = 1 << 22


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw, cut at ASCII spaces into pieces of some MB; one word longer than that stays whole."""
    at = 0
    while len(raw) - at > _PIECE:
        end = raw.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def _counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    out = np.zeros((8, 8), np.int64)
    at = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
        out[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; 0 for a text without words."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(raw.lower()):
        words = carry + piece.split()
        if (m := len(words) - shingle + 1) > 0:
            rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            counts += _counts(np.fromiter(map(digest, rows, repeat(SEED)), np.uint64, m))
            n += m
            words = words[m:]
        carry = words
    if not n:
        if not carry:
            return 0
        counts, n = _counts(np.array([digest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp long) of every row; a null or empty text has fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(raw, shingle) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the distance + 2 blocks."""
    n = distance + 2
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def keyed(fps: DataFrame, distance: int) -> DataFrame:
    """(key, fp): for each fingerprint its keys, one for each pair of blocks."""
    keys = []
    for k, ((a, n), (b, m)) in enumerate(combinations(_blocks(distance), 2)):
        low = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1))
        high = F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << m) - 1))
        keys.append(F.lit(k << (n + m)) + F.shiftleft(high, n) + low)
    return fps.select(F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("band"), key.alias("key")) for k, key in enumerate(keys)])).alias("k"), "fp").select("k.band", "k.key", "fp")


def _rest(distance: int) -> Column:
    """For a row (band, key, fp) its finer keys: the bits that the band leaves, in distance + 1 parts, one a key.

    Linked fingerprints of one key differ in at most `distance` of these bits, so they agree on one of the parts.
    """
    blocks, out = _blocks(distance), None
    for k, pair in enumerate(combinations(range(len(blocks)), 2)):
        bits = [x for n, (a, m) in enumerate(blocks) if n not in pair for x in range(a, a + m)]
        cuts = [len(bits) * i // (distance + 1) for i in range(distance + 2)]
        parts = [bits[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(1 << x for x in part) for part in parts]
        fine = F.array(*[F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for n, m in enumerate(masks)])
        out = F.when(F.col("band") == k, fine) if out is None else out.when(F.col("band") == k, fine)
    return out


def _marked(rows: DataFrame, keys: list[str], many: int, total: int) -> DataFrame:
    """rows, `total` in all, with n: the number of rows of their key where it is above `many`, else null.

    Up to HOT_SHARE such keys are broadcast. Of more, those that hold more than that part of all rows are, which are
    fewer again whatever the data; the others are joined by shuffle, and none of them is large enough to hold up a task.
    """
    hot = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many), "hot")
    if hot.count() <= HOT_SHARE:
        return rows.join(F.broadcast(hot), keys, "left")
    great = F.col("n") > max(many, total // HOT_SHARE)
    wide = rows.join(F.broadcast(hot.where(great)), keys, "left")
    return wide.where("n IS NOT NULL").unionByName(wide.where("n IS NULL").drop("n").join(hot.where(~great), keys, "left"))


def cells(fps: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """(band, key, part, bits, i, j, d0, fp), dealt so that one task holds whole cells, sorted by cell and first pivot distance."""
    rows = _marked(keyed(fps, distance), ["band", "key"], cell, fps.count() * (distance + 2) * (distance + 1) // 2)
    plain = rows.where("n IS NULL").select("band", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("bits"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    # A key of too many fingerprints is cut finer, and only what is still too large is dealt into pairs of chunks.
    fine = rows.where("n IS NOT NULL").select("band", "key", F.explode(_rest(distance)).alias("f"), "fp").select("band", "key", "f.part", "f.bits", "fp")
    fine, keys = materialize(fine, "fine"), ["band", "key", "part", "bits"]
    fine = _marked(fine, keys, cell, fine.count())
    chunks = F.coalesce(F.ceil(F.col("n") / cell).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = fine.select(*keys, F.explode(pairs).alias("c"), "fp").select(*keys, "c.i", "c.j", "fp")
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[0].astype(np.int64))))).cast("int")
    out = plain.unionByName(dealt).select(*keys, "i", "j", first.alias("d0"), "fp")
    return out.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "d0")


def forest(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row the smallest row of its group that links reach; rows are sorted by group and first pivot distance."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    first = np.ascontiguousarray(table[:, 0])
    n = len(fp)
    root, live, s = np.arange(n), np.arange(n), 1
    while len(live := live[live + s < n]):
        other = live + s
        live = live[(group[live] == group[other]) & (first[other] - first[live] <= distance)]
        a = live[root[live] != root[live + s]]
        for p in range(1, len(PIVOTS)):
            if not len(a):
                break
            a = a[np.abs(table[a + s, p] - table[a, p]) <= distance]
        a = a[np.bitwise_count(fp[a] ^ fp[a + s]) <= distance]
        b = a + s
        while len(a):
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(up := root[root], root):
                root = up
            more = root[a] != root[b]
            a, b = a[more], b[more]
        s += 1
    return root


def links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): for distinct fingerprints, links that connect the same fingerprints as all links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0

        def edges(rows: pa.Table) -> pa.RecordBatch:
            fp = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            root = forest(ids(rows), fp, distance)
            at = np.flatnonzero(root != np.arange(len(root)))
            signed = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[at]), pa.array(signed[root[at]])], ["a", "b"])

        def ids(rows: pa.Table) -> np.ndarray:
            cols = [rows.column(c).to_numpy() for c in ("band", "key", "part", "bits", "i", "j")]
            new = np.zeros(len(cols[0]), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            return np.cumsum(new)

        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held >= 100_000:
                rows = pa.Table.from_batches(kept)
                group = ids(rows)
                cut = int(np.searchsorted(group, group[-1]))  # the last cell may go on
                if cut:
                    yield edges(rows.slice(0, cut))
                    rows = rows.slice(cut)
                kept, held = rows.combine_chunks().to_batches(), rows.num_rows
        if held:
            yield edges(pa.Table.from_batches(kept))

    return cells(fps, distance, cell).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, the row's own included. Null and empty texts have fingerprint 0
    and link like any other; rows with a null id get their component's smallest id that is not null, or null if there is
    none. Repeated rows stay repeated. Other columns are ignored. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = labels(links(nodes.select("fp"), distance, cell)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp").select("fp", "root", "least")
    # A component may hold any share of the fingerprints, so its rows are dealt by root and a part of the fingerprint.
    part = F.pmod(F.xxhash64("fp"), F.lit(PARTS)).alias("part")
    whole = linked.groupBy("root").agg(F.min("least").alias("whole"))
    whole = whole.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"), "whole")
    named = linked.select("fp", "root", part).join(whole, ["root", "part"]).select("fp", "whole")
    of = materialize(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("whole", "least").alias("component_id")), "of")
    # A fingerprint of very many copies would be one task of the join. There are fewer than HOT_SHARE of them.
    great = F.col("n") > max(COPIES, prints.count() // HOT_SHARE)
    hot, rest = of.where(great).drop("n"), of.where(~great).drop("n")
    wide = prints.join(F.broadcast(hot.withColumn("great", F.lit(True))), "fp", "left")
    done = wide.where("great").drop("great").unionByName(wide.where("great IS NULL").drop("great", "component_id").join(rest, "fp"))
    return done.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL, null_ids_stay: bool = True) -> DataFrame:
    """docs with one row of each group kept: the one whose id is the group's smallest; all columns are returned.

    Rows are told apart by id and text, so an id that stands in several groups keeps a row in each. Of several texts
    with the smallest id the one with the smallest hash is kept, of rows that share both, any one. Rows with a null id
    all stay, unless null_ids_stay is false: they then come last in their group, and a group of them keeps one.
    """
    name, text = F.col(f"`{id_col}`"), text_of(f"`{text_col}`")
    hashes = [F.xxhash64(F.lit(seed), name.isNull(), name, text).alias(k) for seed, k in ((SEED, "a"), (SEED + 1, "b"))]
    keys = docs.select(F.struct(name.isNull().alias("unnamed"), name.alias("id"), *hashes).alias("key"), text.alias("text"))
    prints = materialize(fingerprints(keys, "key", "text", shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = labels(links(nodes.select("fp"), distance, cell)).withColumnRenamed("node", "fp")
    first = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    kept = materialize(first.select("least.a", "least.b"), "kept")
    rows = docs.where(name.isNotNull()) if null_ids_stay else docs
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *hashes)
    # Of a key that very many rows share one row of each task is enough; so no task gets all of them.
    times, total = prints.groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("n")), prints.count()
    great = F.broadcast(times.where(F.col("n") > max(COPIES, total // HOT_SHARE)).select("a", "b"))
    rows = rows.join(great, ["a", "b"], "left_anti").unionByName(rows.join(great, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("row").alias("row")))
    named = rows.join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("row.*")
    return named.union(docs.where(name.isNull())) if null_ids_stay else named
