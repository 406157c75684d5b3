"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of WINDOW words; a shorter item is one window. Windows of one length m form a
matcher. Its blocks are pairs of words: the shift table says how far the search can move on when it sees a block at the
window's end, and blocks that no window has skip m - 1 words at once. A block that ends windows has a bucket of them,
keyed by a hash of the words, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import annotate, materialize, text_of

WINDOW = 13
#: Benchmark text that one search broadcasts; a larger benchmark is searched in several such blocks, a pass for each.
#: The tables take some 80 bytes for each byte of text, so a Python worker needs about a third of a GB at most.
BLOCK_BYTES = 4 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Match = tuple[int, int]


def words_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return raw.translate(_WORDS).split()


class Matcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                b = window[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.most), m - end)
            self.buckets[window[-self.block :]][window] = items

    def find(self, words: list[bytes]) -> tuple[list[Match], set[str]]:
        """(first word, end) of all occurrences, and the items they belong to."""
        found, items = [], set()
        m, n, shift, most = self.m, len(words), self.shift, self.most
        blocks = list(zip(words, words[1:], strict=False)) if self.block == 2 else [(w,) for w in words]
        back = self.block
        end = m
        while end <= n:
            b = blocks[end - back]
            step = shift.get(b, most)
            if step:
                end += step
                continue
            hit = self.buckets[b].get(tuple(words[end - m : end]))
            if hit is not None:
                found.append((end - m, end))
                items |= hit
            end += 1
        return found, items


def matchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Matcher]:
    by: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, raw in items:
        words = words_of(raw)
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            by[m][tuple(words[at : at + m])].add(item)
    return [Matcher(m, windows) for m, windows in sorted(by.items())]


def merged(found: list[Match]) -> list[int]:
    """The occurrences as disjoint runs of words: first, end, first, end, ..."""
    out: list[int] = []
    for a, b in sorted(found):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def covered(found: list[Match]) -> int:
    """How many words lie in any of the occurrences."""
    runs = merged(found)
    return sum(runs[1::2]) - sum(runs[::2])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """How many blocks of about `most` bytes the items make, and a function that fetches one of them to the driver."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most) or 1
    if n > 1:
        rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartitionByRange("block"), "benchmark")
    return n, lambda k: [(r.item, r.text.encode()) for r in (rows.where(F.col("block") == k) if n > 1 else rows).collect()]


def _summed(found: list[Match], items: set[str]) -> tuple[int, int, str]:
    return covered(found), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _searched(docs: DataFrame, keep: list[str], text_col: str, block: list[tuple[str, bytes]], window: int, listed: bool) -> DataFrame:
    """keep and what one block of items shows of each row: n_words, n_hit, n_items, items_sha256, or, if listed, n_words, found, items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # `most` bytes of text, whatever the benchmark's size

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        group = matchers(shared.value, window)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            n_words, found, items = [], [], []
            for raw in texts:
                words, f, i = words_of(raw), [], set()
                for matcher in group:
                    more, names = matcher.find(words)
                    f += more
                    i |= names
                n_words.append(len(words))
                found.append(f)
                items.append(i)
            out = [pa.array(n_words, pa.int64())]
            if listed:
                return [*out, pa.array([merged(f) for f in found], pa.list_(pa.int64())), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            sums = [_summed(f, i) for f, i in zip(found, items, strict=True)]
            return [*out, *(pa.array([s[k] for s in sums], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]

        return compute

    return annotate(docs, text_col, keep, "n_words long, found array<long>, items array<string>" if listed else "n_words long, n_hit long, n_items long, items_sha256 string", make)


def _search(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """keep and n_words, n_hit, n_items, items_sha256 of every row, under names of their own: c0, c1, ... and w, h, i, s."""
    n, block = _blocks(benchmark, item_col, item_text_col, block_bytes)
    names = [f"c{k}" for k in range(len(keep))]
    if n == 1:
        return _searched(docs, keep, text_col, block(0), window, False).toDF(*names, "w", "h", "i", "s")
    # Each further block is a pass of its own over the texts. Hits, which are few, are kept by two hashes of the text.
    hashes = [F.xxhash64(F.lit(seed), text_of(f"`{text_col}`")) for seed in (10, 11)]
    texts = docs.select(*[h.alias(k) for h, k in zip(hashes, "ab", strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    passes = []
    for k in range(n):
        hits = _searched(texts, ["a", "b"], "text", block(k), window, True).where("size(found) > 0").drop("n_words").dropDuplicates(["a", "b"])
        passes.append(materialize(hits, f"hits{k}"))
    hits = reduce(lambda a, b: a.union(b), passes).groupBy("a", "b").agg(F.flatten(F.collect_list("found")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select("a", "b", _union_length("found").alias("h"), F.size("items").cast("long").alias("i"), F.sha2(F.array_join("items", ","), 256).alias("s"))
    hits = materialize(hits, "hits")
    count = annotate(docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], *[h.alias(f"k{x}") for h, x in zip(hashes, "ab", strict=True)], F.col(f"`{text_col}`").cast("string").alias("t0")), "t0", [*names, "ka", "kb"], "w long", lambda: lambda ts: [pa.array([len(words_of(t)) for t in ts], pa.int64())])
    rows = count.join(hits, (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b")), "left")
    return rows.select(*names, "w", F.coalesce("h", F.lit(0).cast("long")).alias("h"), F.coalesce("i", F.lit(0).cast("long")).alias("i"), F.coalesce("s", F.sha2(F.lit(""), 256)).alias("s"))


def _union_length(ranges: str) -> Column:
    """The length of the union of ranges that stand as first, end, first, end, ... in an array."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.expr(f"size({ranges}) div 2 - 1").cast("int")), lambda k: F.struct(F.get(F.col(ranges), 2 * k).alias("a"), F.get(F.col(ranges), 2 * k + 1).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], p["b"]).alias("upto"))
    return F.aggregate(pairs, zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a text is contaminated if a word is hit and at least a twentieth
    of its words are. Null and empty texts have no words and are clean, as is every text if the benchmark is empty or
    null. Items with the same id count once; a null item id counts as the empty id. Null ids of documents and repeated
    rows stay as they are; other columns are ignored. The documents are scanned once and nothing is shuffled; a
    benchmark of more than block_bytes takes a scan for each block, and one join of all rows, without their texts, to
    those with hits.
    """
    found = _search(docs, benchmark, [id_col], text_col, item_col, item_text_col, window, block_bytes)
    bad = (F.col("h") > 0) & (20 * F.col("h") >= F.col("w"))
    return found.withColumn("bad", bad).toDF(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, min_share: float = 0.0) -> DataFrame:
    """docs, with their columns, without the rows that hold a window of the benchmark.

    min_share: what share of a row's words must be hit for it to go; by default any hit is enough, however long the
    text. A benchmark of several blocks moves the rows once, to join them to the hits. Null and empty texts stay, as do all rows if the benchmark is empty. Rows are judged one by one, so null ids,
    ties and repeated rows need no rule of their own.
    """
    found = _search(docs, benchmark, docs.columns, text_col, item_col, item_text_col, window, block_bytes)
    clean = (F.col("h") == 0) | (F.col("h") < F.lit(min_share) * F.col("w"))
    return found.where(clean).drop("w", "h", "i", "s").toDF(*docs.columns)


ORACLE = """
WITH bench AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM bench WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM docs, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)
), hits AS (
  SELECT r, k, p.m, item FROM places p JOIN wins USING (m, win)
), words AS (
  SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(generate_series(0, m - 1)) AS j FROM (SELECT DISTINCT r, k, m FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
