"""Users, sessions, zones and the dump of a catalog."""

import json

import pytest

from graphloom.catalog import Catalog, IndexField, Prop
from graphloom.errors import GraphError


@pytest.fixture
def catalog():
    c = Catalog()
    c.create_space("g", 4, 2)
    return c


def refused(code, call):
    with pytest.raises(GraphError) as e:
        call()
    assert e.value.code == code


def test_users_and_roles(spark, catalog):
    c = catalog
    c.create_user("ann", "one")
    c.create_user("ann", "other", if_not_exists=True)
    refused("EXISTED", lambda: c.create_user("ann", "x"))
    assert c.authenticate("ann", "one") and not c.authenticate("ann", "other") and not c.authenticate("bob", "one")
    c.change_password("ann", "one", "two")
    refused("INVALID_PASSWORD", lambda: c.change_password("ann", "one", "three"))
    c.alter_user("ann", "four")
    assert c.authenticate("ann", "four") and "four" not in c.to_json()
    c.grant_role("ann", "g", "DBA")
    assert c.may("ann", "g", "USER") and c.may("ann", "g", "DBA") and not c.may("ann", "g", "ADMIN") and not c.may("bob", "g", "GUEST")
    for code, call in (("INVALID_PARM", lambda: c.grant_role("ann", "g", "KING")), ("NOT_FOUND", lambda: c.grant_role("ann", "h", "USER")), ("NOT_FOUND", lambda: c.grant_role("bob", "g", "USER")), ("NOT_FOUND", lambda: c.revoke_role("ann", "g", "USER"))):
        refused(code, call)
    assert c.list_roles(spark, "g").collect() == [("ann", "g", "DBA")] == c.list_roles(spark, account="ann").collect()
    c.grant_role("ann", "g", "USER")
    c.revoke_role("ann", "g", "USER")
    assert c.list_roles(spark).collect() == [] and c.list_users(spark).collect() == [("ann",)]
    c.drop_user("ann")
    refused("NOT_FOUND", lambda: c.drop_user("ann"))
    c.drop_user("ann", if_exists=True)


def test_sessions(spark, catalog):
    c = catalog
    c.create_user("ann", "one")
    refused("NOT_FOUND", lambda: c.create_session("bob", "here", 1))
    one, two = c.create_session("ann", "here", 100), c.create_session("ann", "there", 100)
    assert c.update_session(one, 110, "g", {"1": "scan", "2": "walk"}) == []
    c.kill_query(one, 2)
    refused("NOT_FOUND", lambda: c.kill_query(one, 3))
    assert {(r["query"], r.status) for r in c.list_queries(spark).collect()} == {("1", "RUNNING"), ("2", "KILLING")}
    c = Catalog.from_json(c.to_json())
    assert c.update_session(one, 120, queries={"1": "scan"}) == ["2"] and c.session(one)["space"] == "g"
    assert sorted((r.session, r.updated, r.n_queries) for r in c.list_sessions(spark).collect()) == [(one, 120, 1), (two, 100, 0)]
    assert c.expire_sessions(150, 40) == 1
    refused("NOT_FOUND", lambda: c.session(two))
    c.remove_session(one)
    refused("NOT_FOUND", lambda: c.remove_session(one))


def test_hosts_zones_groups(spark, catalog):
    c = catalog
    for k in range(4):
        c.heartbeat(f"h{k}", 100 + k)
    assert [r.status for r in c.list_hosts(spark, 122).collect()] == ["OFFLINE", "OFFLINE", "ONLINE", "ONLINE"]
    c.add_zone("z1", ["h0", "h1"])
    c.add_zone("z2", ["h2"])
    c.add_host_to_zone("z2", "h3")
    c.add_group("west", ["z1"])
    c.create_space("h", 3, 2, group="west")
    assert c.parts_alloc("h") == {1: ["h0", "h1"], 2: ["h1", "h0"], 3: ["h0", "h1"]}
    parts = c.list_parts(spark, "g").collect()
    assert len(parts) == 4 and all(len(set(p.hosts)) == 2 and p.leader == p.hosts[0] for p in parts)
    bad = [("CONFLICT", lambda: c.add_zone("z3", ["h0"])), ("NOT_FOUND", lambda: c.add_zone("z3", ["h9"])), ("EXISTED", lambda: c.add_zone("z1", [])), ("CONFLICT", lambda: c.drop_zone("z1")), ("CONFLICT", lambda: c.drop_group("west")), ("CONFLICT", lambda: c.drop_zone_from_group("west", "z1")), ("EXISTED", lambda: c.add_zone_to_group("west", "z1")), ("NOT_FOUND", lambda: c.get_zone("z9")), ("CONFLICT", lambda: c.add_host_to_zone("z1", "h3")), ("NOT_FOUND", lambda: c.create_space("i", group="east"))]
    for code, call in bad:
        refused(code, call)
    c.add_zone_to_group("west", "z2")
    c.drop_zone_from_group("west", "z1")
    c.drop_host_from_zone("z2", "h3")
    assert (c.get_group("west"), c.get_zone("z2")) == (["z2"], ["h2"])
    refused("NO_HOSTS", lambda: c.parts_alloc("h"))
    c.drop_space("h")
    c.drop_group("west")
    c.drop_zone("z1")
    assert c.list_zones(spark).collect() == [("z2", ["h2"])] and c.list_groups(spark).collect() == []


def test_text_clients(spark, catalog):
    c = catalog
    refused("NOT_FOUND", c.sign_out)
    refused("INVALID_PARM", lambda: c.sign_in("http", [{"host": "x"}]))
    c.sign_in("http", [{"host": "x", "port": 9200}])
    refused("EXISTED", lambda: c.sign_in("http", [{"host": "y", "port": 1}]))
    assert c.list_clients(spark).collect() == [("http", "x", 9200, None)]
    c.sign_out()


def test_describe(spark, catalog):
    c = catalog
    c.create("g", "tag", "t", [Prop("a", "INT64"), Prop("s", "STRING", True)])
    c.create("g", "edge", "e", [])
    c.create_index("g", "i", "t", [IndexField("a")])
    c.create_fulltext("g", "f", "t", ["s"])
    c.add_listener("g", "fulltext", "/tmp/x")
    c.register_setting("m", "n", 3)
    c.create_user("ann", "secret")
    c.create_session("ann", "here", 1)
    c.heartbeat("h0", 1)
    rows = {(r.kind, r.space, r.name): json.loads(r.detail) for r in c.describe(spark).collect()}
    assert set(rows) == {("space", "g", "g"), ("tag", "g", "t"), ("edge", "g", "e"), ("tag index", "g", "i"), ("fulltext index", "g", "f"), ("listener", "g", "fulltext"), ("setting", None, "m.n"), ("user", None, "ann"), ("session", None, "1"), ("host", None, "h0")}
    assert rows["tag index", "g", "i"]["status"] == "STARTING" and rows["user", None, "ann"] == {"roles": {}}
