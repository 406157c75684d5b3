"""Mixing sources by temperature, realised as budgeted block permutations.

The weight of a source is its token share to the power alpha, normalised: alpha 1 keeps the natural mix, alpha 0 is
uniform. alpha is bisected, five halvings a job, to meet a target entropy or a limit on repetitions. A source's quota of tokens is then a
number of full passes over it and a part of one more. A source's rows are dealt by a seeded hash into blocks of about
BLOCK_TOKENS; a pass visits the blocks in a pseudo-random order (an affine permutation of the block numbers), and the
partial pass stops where the quota is met: whole blocks first, then rows of one block in the order of their hashes.
Whether a row is in follows from its hash and a few numbers of its source, so texts are neither shuffled nor joined to
anything but one row for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_of

SEED = 4
BLOCK_TOKENS = 1 << 20
#: The repetition limit that the registered query and the pipeline use.
MAX_REPEATS = 2.0
#: Each round of the bisection evaluates so many exponents in one job: all that five halvings can lead to.
_GRID = 32
_ROUNDS = 4
#: A prime above any number of blocks, for permutations.
_PRIME = 2_147_483_647
#: Ranks, which lie between 0 and the prime, are first summed in cells of so many.
_CELL = 1 << 19


def tokens(text_col: str) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text_of(text_col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def row_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col))


def shares(light: DataFrame) -> DataFrame:
    """(source, n): tokens of each source; sources without tokens are left out."""
    return light.groupBy("source").agg(F.sum("tokens").alias("n")).where("n > 0")


def _evaluate(share: DataFrame, alphas: list[float], budget: int | None) -> list[tuple[float, float]]:
    """(entropy, most repetitions) of the mix at each exponent, in one pass over the shares.

    Without a budget, repetitions are those of the smallest budget that uses every source once.
    """
    out = []
    for a in alphas:
        w = F.pow("p", F.lit(a))
        rep = F.pow("p", F.lit(a - 1))
        out += [F.sum(w), F.sum(w * F.log("p")), F.max(rep), F.min(rep)]
    r = share.agg(F.sum("n").alias("total"), *[c.alias(f"v{k}") for k, c in enumerate(out)]).first()
    got = []
    for k, a in enumerate(alphas):
        s, sl, most, least = (r[f"v{4 * k + j}"] for j in range(4))
        entropy = math.log(s) - a * sl / s
        got.append((entropy, most / least if budget is None else most / s * budget / r["total"]))
    return got


def exponent(share: DataFrame, budget: int | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent that meets the target, between 0 and 1.

    target_entropy is a share of the entropy of the uniform mix: the largest exponent with at least that entropy.
    max_repeats: the smallest exponent at which no source is used more often. 1 if none meets it.
    """
    lo, hi = 0.0, 1.0
    uniform = None
    for _ in range(_ROUNDS):
        grid = [lo + (hi - lo) * k / _GRID for k in range(_GRID + 1)]
        got = _evaluate(share, grid, budget)
        uniform = got[0][0] if uniform is None else uniform
        if target_entropy is not None:
            fits = [k for k, (h, _) in enumerate(got) if h >= target_entropy * uniform - 1e-12]
            k = max(fits, default=0)
            lo, hi = grid[k], grid[min(k + 1, _GRID)]
        else:
            fits = [k for k, (_, r) in enumerate(got) if r <= max_repeats + 1e-9]
            k = min(fits, default=_GRID)
            lo, hi = grid[max(k - 1, 0)], grid[k]
        if lo == hi:
            break
    return lo if target_entropy is not None else hi


def plan(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The rows without texts (id, source, tokens, h), and one row for each source saying which of its rows are used.

    budget is in tokens; None means the smallest budget that uses every source once.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens(text_col).alias("tokens"), row_hash(id_col, text_col, seed).alias("h"))
    light = materialize(light, "light")
    share = shares(light)
    total = share.agg(F.sum("n")).first()[0] or 0
    share = materialize(share.withColumn("p", F.col("n") / F.lit(max(1, total))), "shares")
    alpha = exponent(share, budget, target_entropy, max_repeats) if total else 1.0
    norm, least = share.agg(F.sum(F.pow("p", F.lit(alpha))), F.min(F.pow("p", F.lit(alpha - 1)))).first()
    weight = F.pow("p", F.lit(alpha)) / F.lit(norm or 1.0)
    rep = F.pow("p", F.lit(alpha - 1)) / F.lit(least or 1.0) if budget is None else weight * F.lit(budget) / F.col("n")
    quota = F.round(rep * F.col("n")).cast("long")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block_tokens)), F.lit(1)).cast("long")
    quotas = share.select(
        "source",
        weight.alias("weight"),
        quota.alias("quota"),
        blocks.alias("blocks"),
        "n",
    ).select(
        "source",
        "weight",
        (F.col("quota") - F.col("quota") % F.col("n")).alias("whole"),
        (F.col("quota") % F.col("n")).alias("rest"),
        "blocks",
        "n",
        (F.pmod(F.xxhash64(F.lit(seed), F.lit("a"), "source"), F.lit(_PRIME - 1)) + 1).alias("a"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("c"), "source"), F.lit(_PRIME)).alias("c"),
    ).withColumn("passes", (F.col("whole") / F.col("n")).cast("long")).drop("whole")
    quotas = materialize(quotas, "quotas")
    dealt = _join(light, quotas, ["blocks", "a", "c", "rest"]).withColumn("rank", _rank())
    # The block in which the quota is met: first the cell of ranks, then the block within, so no task orders all blocks.
    cell = F.floor(F.col("rank") / _CELL).alias("cell")
    sums = dealt.where("rest > 0").groupBy("source", cell, "rank").agg(F.sum("tokens").alias("t"), F.first("rest").alias("need"))
    sums = materialize(sums, "sums")
    cells = _met(sums.groupBy("source", "cell").agg(F.sum("t").alias("t"), F.first("need").alias("need")), "cell")
    inside = _join(sums.drop("need"), cells.withColumnRenamed("cell", "met"), ["met", "need"]).where("cell = met")
    cut = materialize(_met(inside, "rank").withColumnRenamed("rank", "cut"), "cuts")
    # Rows without tokens cannot meet a quota, so a block has no more rows here than tokens.
    edge = _join(dealt.select("source", "rank", "h", "tokens").where("tokens > 0"), cut, ["cut", "need"]).where("rank = cut")
    edge = edge.groupBy("source", "h").agg(F.sum("tokens").alias("t"), F.first("need").alias("need"))
    within = edge.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)))
    last = within.where("coalesce(before, 0) < need").groupBy("source").agg(F.max("h").alias("last"))
    return light, materialize(_join(_join(quotas, cut, ["cut"], "left"), last, ["last"], "left").drop("rest", "n"), "plan")


def _met(parts: DataFrame, place: str) -> DataFrame:
    """(source, place, need): where the running sum of t reaches need, and what is then still needed of that part."""
    running = parts.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy(place)))
    met = running.where("upto >= need and upto - t < need")
    return met.select("source", place, (F.col("need") - F.col("upto") + F.col("t")).alias("need"))


def _join(rows: DataFrame, by: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """rows and the columns cols of by; null sources match each other."""
    other = by.select(F.col("source").alias("_source"), *cols)
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _rank() -> Column:
    """A row's place in its source's permutation of blocks. The product stays below 2^62."""
    block = F.pmod(F.col("h"), F.col("blocks"))
    return F.pmod(F.col("a") * block + F.col("c"), F.lit(_PRIME))


def copies() -> Column:
    """How often a row is used, from h and its source's plan; rows of sources without tokens are used once."""
    rank = _rank()
    part = (rank < F.col("cut")) | ((rank == F.col("cut")) & (F.col("h") <= F.col("last")))
    return F.when(F.col("passes").isNull(), 1).otherwise(F.col("passes") + F.when(part, 1).otherwise(0)).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """One row for each row of docs: id_col, source, n_tokens, weight of the source, copies (how often the row is used),
    block_rank and place.

    Copy k belongs to pass k over the source, from 1 on. Every pass takes the source's blocks by block_rank and the rows
    of a block by place; 0 and the hash for a source without tokens.

    Null and empty texts have no tokens; a source without any keeps each row once, at weight 0. Null sources are one
    source. Equal rows (id and text) share a hash and are used alike, so that ties can exceed a quota by their size.
    An empty table gives an empty result.
    """
    light, by = plan(docs, id_col=id_col, source_col=source_col, **options)
    rows = _join(light, by, ["weight", "blocks", "a", "c", "passes", "cut", "last"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), copies().alias("copies"), *order())


def order() -> list[Column]:
    """Where a row stands in each pass: its block's rank, and its place in the block."""
    return [F.coalesce(_rank(), F.lit(0).cast("long")).alias("block_rank"), F.col("h").alias("place")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, ordered: bool = False, **options) -> DataFrame:
    """docs with each row as often as the mixture uses it; the columns stay.

    ordered adds pass, block_rank and place, by which a source's copies come in the order of the method. Null texts and
    sources, empty texts and repeated rows are used as mixture() says; an empty table gives an empty result.
    """
    _, by = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), row_hash(id_col, text_col, seed).alias("h"))
    used = _join(rows, by, ["weight", "blocks", "a", "c", "passes", "cut", "last"], "left").select("row", copies().alias("copies"), *order())
    used = used.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("pass"), "block_rank", "place")
    return used.select("row.*", *(["pass", "block_rank", "place"] if ordered else []))
