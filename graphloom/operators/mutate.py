"""Inserts, deletes and updates, as functions from tables to new tables.

The functions are whole-table plans: what changes comes as a frame of keys and values, so a million changes cost one
join. `sources.store` keeps their outcome as segments.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import Prop, Schema, Version
from graphloom.errors import GraphError
from graphloom.operators.scan import part_of
from graphloom.types import PropertyType, coerce

ORDER = "_ord"


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with their place in the request, if they have none."""
    return rows if ORDER in rows.columns else rows.withColumn(ORDER, F.monotonically_increasing_id())


def one_of(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One row for each key: the last or the first in the request. A partial aggregate, so a hot key is cut down before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, ORDER)]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest) if rest else F.lit(1), ORDER)
    got = rows.groupBy(*keys).agg(pick.alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the delta's rows in place of those of the same keys; of several, the last counts."""
    new = one_of(numbered(delta), keys, True)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the delta's rows whose keys it lacks; of several, the first counts."""
    new = one_of(numbered(delta), keys, False)
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti"))


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """base without the keys in gone; keys it lacks are ignored."""
    return base.join(gone.select(*keys), keys, "left_anti")


def _default(p: Prop) -> Column:
    if p.default is not None:
        return F.expr(p.default).cast(p.parsed.stored)
    return F.lit(None).cast(p.parsed.stored)


def resolved(rows: DataFrame, keys: list[str], version: Version, names: list[str] | None = None) -> DataFrame:
    """The rows as the schema stores them, with _error: a code for rows that cannot be stored.

    names: the properties that the request gives, by name; None takes all columns of rows by position, in the order of
    the schema. What is not given takes its default, or null if it may be; else FIELD_UNSET.
    """
    given = [c for c in rows.columns if c not in (*keys, ORDER)]
    if names is None:
        if len(given) > len(version.props):
            raise GraphError("INVALID_PARM", "more values than properties")
        names = [p.name for p in version.props[: len(given)]]
    source = dict(zip(names, given, strict=True))
    for n in names:
        if version.prop(n) is None:
            raise GraphError("PROP_NOT_FOUND", n)
    cols, errors = [], []
    for p in version.props:
        if p.name in source:
            value, error = coerce(F.col(f"`{source[p.name]}`"), rows.schema[source[p.name]].dataType, p.parsed)
            cols.append(value.alias(p.name))
            errors.append(error)
            if not p.nullable:
                errors.append(F.when(F.col(f"`{source[p.name]}`").isNull(), F.lit("NOT_NULLABLE")))
        elif p.default is None and not p.nullable:
            cols.append(_default(p).alias(p.name))
            errors.append(F.lit("FIELD_UNSET"))
        else:
            cols.append(_default(p).alias(p.name))
    error = F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string")
    extra = [ORDER] if ORDER in rows.columns else []
    return rows.select(*keys, *extra, *cols, error.alias("_error"))


def vid_errors(rows: DataFrame, keys: list[str], vid: PropertyType) -> DataFrame:
    """rows with _error INVALID_VID where a vertex id is null or longer than the space allows."""
    ends = [k for k in keys if k != "_rank"]
    bad = [F.col(k).isNull() | ((F.octet_length(k) > vid.length) if vid.name == "FIXED_STRING" else F.lit(False)) for k in ends]
    return rows.withColumn("_error", F.when(reduce(lambda a, b: a | b, bad), F.lit("INVALID_VID")).otherwise(F.col("_error")))


def accepted(rows: DataFrame, keys: list[str], partitions: int) -> tuple[DataFrame, DataFrame]:
    """The rows of partitions in which no row fails, and (part, error) of those in which one does.

    A failing row fails its whole partition; the other partitions go on. What failed is at most a row a partition and is
    sent to where the rows lie: joined by shuffle, they would be no more tasks than partitions.
    """
    rows = rows.withColumn("_part", part_of(F.col(keys[0]), partitions))
    failed = rows.where("_error IS NOT NULL").groupBy("_part").agg(F.min("_error").alias("error"))
    good = rows.join(F.broadcast(failed.select("_part")), "_part", "left_anti").drop("_part", "_error")
    return good, failed.withColumnRenamed("_part", "part")


@dataclass(frozen=True)
class Update:
    """SET items in order, each seeing those before it; condition: on the old row; returns: properties to report."""

    sets: tuple[tuple[str, str | Column], ...]
    condition: str | Column | None = None
    insertable: bool = False
    returns: tuple[str, ...] = ()


def _insertable(u: Update, version: Version) -> None:
    """Whether an insert can fill every property; raises as the first missing one is found."""
    given = {n for n, _ in u.sets}
    for p in version.props:
        if p.name not in given and p.default is None and not p.nullable:
            raise GraphError("INVALID_FIELD_VALUE", f"{p.name} has no value, default or null")


def update(base: DataFrame, targets: DataFrame, keys: list[str], u: Update, schema: Schema | Version, now_live: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The new table, and one row for each target key: keys, _inserted, _status and the properties of u.returns.

    _status is SUCCEEDED, FILTER_OUT (the condition was not true: nothing is written and the old values are returned) or
    KEY_NOT_FOUND. A row that is absent, or expired by now_live, is inserted if u.insertable, whatever the condition.
    """
    version = schema.latest if isinstance(schema, Schema) else schema
    for n, _ in u.sets:
        if version.prop(n) is None:
            raise GraphError("PROP_NOT_FOUND", n)
    for n in u.returns:
        if version.prop(n) is None:
            raise GraphError("PROP_NOT_FOUND", n)
    if u.insertable:
        _insertable(u, version)
    props = [p.name for p in version.props]
    live = F.lit(True) if now_live is None else now_live
    old = base.where(live).select(*keys, F.lit(True).alias("_here"), *props)
    rows = targets.select(*keys).distinct().join(old, keys, "left")
    rows = rows.withColumn("_here", F.coalesce("_here", F.lit(False)))
    condition = F.lit(True) if u.condition is None else F.expr(u.condition) if isinstance(u.condition, str) else u.condition
    rows = rows.withColumn("_pass", ~F.col("_here") | F.coalesce(condition, F.lit(False)))
    olds = F.struct(*props).alias("_old")
    # An insert starts from defaults; SET items may read them.
    rows = rows.select(*keys, "_here", "_pass", olds, *[F.when(F.col("_here"), F.col(p.name)).otherwise(_default(p)).alias(p.name) for p in version.props])
    for n, item in u.sets:
        value = F.expr(item) if isinstance(item, str) else item
        rows = rows.withColumn(n, value.cast(version.prop(n).parsed.stored))
    status = F.when(~F.col("_here") & F.lit(not u.insertable), "KEY_NOT_FOUND").when(~F.col("_pass"), "FILTER_OUT").otherwise("SUCCEEDED")
    rows = rows.withColumn("_status", status)
    changed = rows.where("_status = 'SUCCEEDED'").select(*keys, *props)
    new = base.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
    shown = [F.when(F.col("_status") == "SUCCEEDED", F.col(n)).otherwise(F.col(f"_old.{n}")).alias(n) for n in u.returns]
    result = rows.select(*keys, (F.col("_status").eqNullSafe("SUCCEEDED") & ~F.col("_here")).alias("_inserted"), "_status", *shown)
    return new, result


def both_directions(edges: DataFrame) -> DataFrame:
    """Out- and in-edges as rows: _dir +1 or -1, the in-edge with its ends swapped. Since an edge is kept once, both appear or neither."""
    rest = [c for c in edges.columns if c not in ("_src", "_dst")]
    out = edges.select(F.lit(1).alias("_dir"), "_src", "_dst", *rest)
    return out.unionByName(edges.select(F.lit(-1).alias("_dir"), F.col("_dst").alias("_src"), F.col("_src").alias("_dst"), *rest))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
