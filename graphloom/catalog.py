"""The catalog: spaces, versioned tag and edge schemas, indexes, listeners and settings.

It is a plain object that turns into JSON and back; `sources.store` keeps it next to the data. Every listing is also
available as a DataFrame.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.admin import PARTS, Places, Sessions, TextClients, Users
from graphloom.errors import GraphError
from graphloom.types import INTS, PropertyType, vid_type

MAX_INDEX_FIELDS = 16


@dataclass(frozen=True)
class Prop:
    """default is a SQL expression over no columns, or None for no default."""

    name: str
    type: str
    nullable: bool = False
    default: str | None = None

    @property
    def parsed(self) -> PropertyType:
        return PropertyType.parse(self.type)


@dataclass(frozen=True)
class Version:
    props: tuple[Prop, ...]
    ttl_col: str | None = None
    ttl_duration: int = 0

    def prop(self, name: str) -> Prop | None:
        return next((p for p in self.props if p.name == name), None)


@dataclass
class Schema:
    """A tag or an edge type; the last version is the current one."""

    id: int
    name: str
    kind: str
    versions: list[Version] = field(default_factory=list)

    @property
    def latest(self) -> Version:
        return self.versions[-1]

    @property
    def ttl(self) -> tuple[str, int] | None:
        v = self.latest
        return (v.ttl_col, v.ttl_duration) if v.ttl_col and v.ttl_duration > 0 else None


@dataclass(frozen=True)
class IndexField:
    """length, in bytes, is asked for on STRING fields."""

    name: str
    length: int | None = None


@dataclass
class Index:
    id: int
    name: str
    kind: str
    schema: str
    fields: tuple[IndexField, ...] = ()
    status: str = "STARTING"  # until it is built; then BUILDING, and FINISHED


@dataclass
class Space:
    id: int
    name: str
    partitions: int = 100
    replicas: int = 1
    vid: str = "FIXED_STRING(8)"
    charset: str = "utf8"
    collation: str = "utf8_bin"
    schemas: dict[str, Schema] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    fulltext: dict[str, Index] = field(default_factory=dict)
    listeners: list[dict] = field(default_factory=list)
    writable: bool = True
    next_id: int = 1
    group: str | None = None


def _ttl_checked(props: tuple[Prop, ...], col: str | None, duration: int) -> tuple[str | None, int]:
    if duration and not col:
        raise GraphError("INVALID_PARM", "a TTL duration needs a column")
    if col:
        p = next((p for p in props if p.name == col), None)
        if p is None or p.parsed.name not in ("INT64", "TIMESTAMP"):
            raise GraphError("INVALID_PARM", f"TTL column {col} must be an INT64 or TIMESTAMP property")
    return col, duration


class Catalog(Users, Sessions, Places, TextClients):
    def __init__(self) -> None:
        for name, kind in PARTS.items():
            setattr(self, name, kind())
        self.spaces: dict[str, Space] = {}
        self.settings: dict[str, dict] = {}
        self.jobs: list[dict] = []
        self.next_id = 1

    # Spaces

    def create_space(self, name: str, partitions: int = 100, replicas: int = 1, vid: str = "FIXED_STRING(8)", charset: str = "utf8", collation: str = "utf8_bin", if_not_exists: bool = False, group: str | None = None) -> Space:
        if name in self.spaces:
            if if_not_exists:
                return self.spaces[name]
            raise GraphError("EXISTED", name)
        vid_type(vid)
        if partitions < 1 or replicas < 1:
            raise GraphError("INVALID_PARM", "partitions and replicas must be positive")
        if charset != "utf8" or collation not in ("utf8_bin", "utf8_general_ci"):
            raise GraphError("INVALID_PARM", f"unknown charset {charset} or collation {collation}")
        if group is not None:
            self.get_group(group)
        self.spaces[name] = Space(self.next_id, name, partitions, replicas, vid, charset, collation, group=group)
        self.next_id += 1
        return self.spaces[name]

    def drop_space(self, name: str, if_exists: bool = False) -> None:
        """Drops a space with all that is in it, and the roles that users have there. Its data goes with the next vacuum."""
        if self.spaces.pop(name, None) is None and not if_exists:
            raise GraphError("NOT_FOUND", name)
        for u in self.users.values():
            u["roles"].pop(name, None)

    def space(self, name: str) -> Space:
        if name not in self.spaces:
            raise GraphError("NOT_FOUND", f"space {name}")
        return self.spaces[name]

    def list_spaces(self, spark: SparkSession) -> DataFrame:
        rows = [(s.id, s.name, s.partitions, s.replicas, s.vid) for s in self.spaces.values()]
        return spark.createDataFrame(rows, "space_id int, name string, partitions int, replicas int, vid_type string")

    # Schemas

    def create(self, space: str, kind: str, name: str, props: list[Prop], ttl_col: str | None = None, ttl_duration: int = 0, if_not_exists: bool = False) -> Schema:
        """kind is tag or edge. A tag and an edge cannot share a name."""
        s = self.space(space)
        if name in s.schemas:
            if if_not_exists and s.schemas[name].kind == kind:
                return s.schemas[name]
            raise GraphError("EXISTED" if s.schemas[name].kind == kind else "CONFLICT", name)
        if len({p.name for p in props}) != len(props):
            raise GraphError("INVALID_PARM", "a property is given twice")
        for p in props:
            p.parsed  # noqa: B018  raises if unknown
        col, duration = _ttl_checked(tuple(props), ttl_col, ttl_duration)
        s.schemas[name] = Schema(s.next_id, name, kind, [Version(tuple(props), col, duration)])
        s.next_id += 1
        return s.schemas[name]

    def schema(self, space: str, name: str, kind: str | None = None) -> Schema:
        found = self.space(space).schemas.get(name)
        if found is None or kind not in (None, found.kind):
            raise GraphError("NOT_FOUND", f"{kind or 'schema'} {name}")
        return found

    def indexes_of(self, space: str, schema: str) -> list[Index]:
        return [i for i in self.space(space).indexes.values() if i.schema == schema]

    def alter(self, space: str, name: str, add: list[Prop] = (), change: list[Prop] = (), drop: list[str] = (), ttl_col: str | None = None, ttl_duration: int | None = None) -> Version:
        """Appends a version. Properties in an index cannot be changed or dropped, nor TTL set while there is an index."""
        schema = self.schema(space, name)
        last = schema.latest
        props = {p.name: p for p in last.props}
        col, duration = last.ttl_col, last.ttl_duration
        indexes = self.indexes_of(space, name)
        indexed = {f.name for i in indexes for f in i.fields}
        for p in add:
            if p.name in props:
                raise GraphError("EXISTED", p.name)
            p.parsed  # noqa: B018
            props[p.name] = p
        for p in change:
            if p.name not in props:
                raise GraphError("NOT_FOUND", p.name)
            if p.name in indexed:
                raise GraphError("CONFLICT", f"{p.name} is in an index")
            if p.name == col:
                raise GraphError("UNSUPPORTED", f"{p.name} is the TTL column")
            p.parsed  # noqa: B018
            props[p.name] = p
        for d in drop:
            if d not in props:
                raise GraphError("NOT_FOUND", d)
            if d in indexed:
                raise GraphError("CONFLICT", f"{d} is in an index")
            del props[d]
            if d == col:
                col, duration = None, 0
        if ttl_col is not None or ttl_duration is not None:
            if indexes:
                raise GraphError("UNSUPPORTED", "TTL cannot be set while there is an index")
            col = ttl_col if ttl_col is not None else col
            duration = ttl_duration if ttl_duration is not None else duration
        version = Version(tuple(props.values()), *_ttl_checked(tuple(props.values()), col, duration))
        schema.versions.append(version)
        return version

    def drop(self, space: str, name: str, kind: str, if_exists: bool = False) -> None:
        s = self.space(space)
        if name not in s.schemas or s.schemas[name].kind != kind:
            if if_exists:
                return
            raise GraphError("NOT_FOUND", name)
        if self.indexes_of(space, name) or any(i.schema == name for i in s.fulltext.values()):
            raise GraphError("CONFLICT", f"{name} has an index")
        del s.schemas[name]

    def list_schemas(self, spark: SparkSession, space: str, kind: str) -> DataFrame:
        rows = [(s.id, s.name, len(s.versions) - 1, p.name, p.type, p.nullable, p.default) for s in self.space(space).schemas.values() if s.kind == kind for p in (s.latest.props or [Prop(None, None)])]
        return spark.createDataFrame(rows, "id int, name string, version int, property string, type string, nullable boolean, default_expr string")

    # Indexes

    def create_index(self, space: str, name: str, schema: str, fields: list[IndexField] = (), if_not_exists: bool = False) -> Index:
        """At most 16 fields, none twice; STRING fields need a length. Without fields the index lists keys only."""
        s = self.space(space)
        if name in s.indexes:
            if if_not_exists:
                return s.indexes[name]
            raise GraphError("EXISTED", name)
        target = self.schema(space, schema)
        if len(fields) > MAX_INDEX_FIELDS:
            raise GraphError("CONFLICT", f"more than {MAX_INDEX_FIELDS} fields")
        if len({f.name for f in fields}) != len(fields):
            raise GraphError("CONFLICT", "a field is given twice")
        for f in fields:
            p = target.latest.prop(f.name)
            if p is None:
                raise GraphError("NOT_FOUND", f.name)
            if p.parsed.name == "STRING" and not f.length:
                raise GraphError("INVALID_PARM", f"{f.name} needs an index length")
            if p.parsed.name != "STRING" and f.length:
                raise GraphError("INVALID_PARM", f"{f.name} cannot have an index length")
        if target.ttl and target.latest.ttl_col in {f.name for f in fields}:
            raise GraphError("UNSUPPORTED", "the TTL column cannot be indexed")
        if any(i.fields[: len(fields)] == tuple(fields) and len(i.fields) == len(fields) for i in self.indexes_of(space, schema)):
            raise GraphError("EXISTED", "an index on these fields")
        s.indexes[name] = Index(s.next_id, name, target.kind, schema, tuple(fields))
        s.next_id += 1
        return s.indexes[name]

    def index(self, space: str, name: str) -> Index:
        found = self.space(space).indexes.get(name)
        if found is None:
            raise GraphError("NOT_FOUND", f"index {name}")
        return found

    def drop_index(self, space: str, name: str, if_exists: bool = False) -> None:
        if self.space(space).indexes.pop(name, None) is None and not if_exists:
            raise GraphError("NOT_FOUND", name)

    def list_indexes(self, spark: SparkSession, space: str, kind: str) -> DataFrame:
        rows = [(i.id, i.name, i.schema, [f.name for f in i.fields], i.status) for i in self.space(space).indexes.values() if i.kind == kind]
        return spark.createDataFrame(rows, "id int, name string, schema string, fields array<string>, status string")

    def create_fulltext(self, space: str, name: str, schema: str, fields: list[str]) -> Index:
        s, target = self.space(space), self.schema(space, schema)
        if name in s.fulltext or any(i.schema == schema for i in s.fulltext.values()):
            raise GraphError("EXISTED", name)
        for f in fields:
            p = target.latest.prop(f)
            if p is None or p.parsed.name not in ("STRING", "FIXED_STRING"):
                raise GraphError("INVALID_PARM", f"{f} is no string property")
        s.fulltext[name] = Index(s.next_id, name, target.kind, schema, tuple(IndexField(f) for f in fields))
        s.next_id += 1
        return s.fulltext[name]

    def drop_fulltext(self, space: str, name: str) -> None:
        if self.space(space).fulltext.pop(name, None) is None:
            raise GraphError("NOT_FOUND", name)

    # Listeners and settings

    def add_listener(self, space: str, kind: str, target: str) -> None:
        s = self.space(space)
        if any(x["kind"] == kind for x in s.listeners):
            raise GraphError("EXISTED", f"listener {kind}")
        s.listeners.append({"kind": kind, "target": target})

    def remove_listener(self, space: str, kind: str) -> None:
        s = self.space(space)
        left = [x for x in s.listeners if x["kind"] != kind]
        if len(left) == len(s.listeners):
            raise GraphError("NOT_FOUND", f"listener {kind}")
        s.listeners = left

    def register_setting(self, module: str, name: str, value: object, mutable: bool = True) -> None:
        self.settings.setdefault(f"{module}.{name}", {"value": value, "mutable": mutable})

    def set_setting(self, module: str, name: str, value: object) -> None:
        found = self.settings.get(f"{module}.{name}")
        if found is None:
            raise GraphError("NOT_FOUND", name)
        if not found["mutable"] or type(found["value"]) is not type(value):
            raise GraphError("INVALID_PARM", name)
        found["value"] = value

    def get_setting(self, module: str, name: str) -> object:
        if f"{module}.{name}" not in self.settings:
            raise GraphError("NOT_FOUND", name)
        return self.settings[f"{module}.{name}"]["value"]

    def list_settings(self, spark: SparkSession) -> DataFrame:
        rows = [(*k.split(".", 1), json.dumps(v["value"]), v["mutable"]) for k, v in sorted(self.settings.items())]
        return spark.createDataFrame(rows, "module string, name string, value string, mutable boolean")

    def describe(self, spark: SparkSession) -> DataFrame:
        """(kind, space, name, detail as JSON) of everything that the catalog keeps, but for password hashes."""
        rows = []
        for s in self.spaces.values():
            whole = asdict(s)
            rows.append(("space", s.name, s.name, {k: v for k, v in whole.items() if k not in ("schemas", "indexes", "fulltext", "listeners")}))
            rows += [(x["kind"], s.name, n, x) for n, x in whole["schemas"].items()]
            rows += [(f"{x['kind']} index", s.name, n, x) for n, x in whole["indexes"].items()]
            rows += [("fulltext index", s.name, n, x) for n, x in whole["fulltext"].items()]
            rows += [("listener", s.name, x["kind"], x) for x in s.listeners]
        rows += [("setting", None, n, x) for n, x in self.settings.items()] + [("job", j["space"], str(j["id"]), j) for j in self.jobs]
        rows += [("user", None, n, {"roles": x["roles"]}) for n, x in self.users.items()] + [("session", x["space"], n, x) for n, x in self.sessions.items()]
        rows += [(kind, None, n, x) for kind, table in (("host", self.hosts), ("zone", self.zones), ("group", self.groups)) for n, x in table.items()]
        rows += [("text client", None, c["host"], c) for c in self.clients]
        return spark.createDataFrame([(*r[:3], json.dumps(r[3], sort_keys=True)) for r in rows], "kind string, space string, name string, detail string")

    # JSON

    def to_json(self) -> str:
        return json.dumps({"spaces": {k: asdict(v) for k, v in self.spaces.items()}, "settings": self.settings, "jobs": self.jobs, "next_id": self.next_id, **{n: getattr(self, n) for n in PARTS}})

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw, out = json.loads(text), Catalog()
        out.settings, out.jobs, out.next_id = raw["settings"], raw.get("jobs", []), raw["next_id"]
        for n, kind in PARTS.items():
            setattr(out, n, raw.get(n, kind()))

        def index(i: dict) -> Index:
            return Index(**{**i, "fields": tuple(IndexField(**f) for f in i["fields"])})

        for name, s in raw["spaces"].items():
            schemas = {k: Schema(v["id"], v["name"], v["kind"], [Version(tuple(Prop(**p) for p in x["props"]), x["ttl_col"], x["ttl_duration"]) for x in v["versions"]]) for k, v in s["schemas"].items()}
            out.spaces[name] = Space(**{**s, "schemas": schemas, "indexes": {k: index(i) for k, i in s["indexes"].items()}, "fulltext": {k: index(i) for k, i in s["fulltext"].items()}})
        return out


#: Types on which SUM, AVG, MIN and MAX are allowed.
NUMERIC = {*INTS, "FLOAT", "DOUBLE"}
