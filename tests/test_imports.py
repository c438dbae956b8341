"""Imports by format: replays, failures and what is left of them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from candela.functions.keys import packed, unpacked
from candela.operators import imports
from candela.sources import landing
from candela.sources.feeds import Parsed


def envelope(spark, *entities, edges=()):
    body = {"entities": [dict(zip(("key", "name", "entity_type", "country"), e)) for e in entities], "relationships": [dict(zip(("subject", "object", "relation", "locator"), e)) for e in edges], "warnings": ["w"]}
    return spark.createDataFrame([(json.dumps(body),)], "j string").select(F.from_json("j", landing.ENVELOPE).alias("r")).select("r.*")


ROWS = [("a", "North Steel Works", "ORGANIZATION", "cz"), ("b", "North Steel Works Ltd", "ORGANIZATION", None), ("c", "Body", "PUBLIC_BODY", None), ("bad", "x", "PLANET", None)]
EDGES = [("c", "a", "AWARDED_TO", "/1"), ("c", "missing", "AWARDED_TO", "/2")]


def test_a_replay_is_answered_from_the_receipt(spark, tmp_path):
    store = imports.ImportStore(spark, f"{tmp_path}/s")
    rows = envelope(spark, *ROWS, edges=EDGES)
    first = store.run("normalized", rows, "src", "d", "me", review=True)
    again = store.run("normalized", rows, "src", "d", "you")
    assert (first["replayed"], again["replayed"]) == (False, True) and first["batch_id"] == again["batch_id"] and first["counts"] == again["counts"]
    assert first["counts"] == {"entities": 3, "edges": 1, "claims": 1, "money_flows": 0, "ownership": 0, "quarantine": 2, "problems": 1, "review": 1}
    assert store.table("edges").count() == 1
    assert sorted(r.reason for r in store.table("quarantine").collect()) == ["entity_type", "unresolved_reference"]
    assert [r.action for r in store.audit_log().orderBy("at").collect()] == ["IMPORT_SUCCEEDED", "IMPORT_REPLAYED"]
    assert store.run("normalized", rows, "src", "other", "me")["replayed"] is False


def test_a_failure_leaves_its_class_and_no_rows_and_may_be_repeated(spark, tmp_path, monkeypatch):
    store = imports.ImportStore(spark, f"{tmp_path}/s")
    rows = envelope(spark, *ROWS, edges=EDGES)
    own = imports.write_tables

    def failing(tables, path, batch):
        own(tables, path, batch)
        raise OSError("the disk says something private")

    with monkeypatch.context() as m:
        m.setattr(imports, "write_tables", failing)
        with pytest.raises(OSError):
            store.run("normalized", rows, "src", "d", "me")
    assert store.table("edges").count() == 0
    job = store.jobs().first()
    assert (job.status, job.error) == ("FAILED", "OSError")
    assert "private" not in str(store.receipts().collect()) + str(store.audit_log().collect())
    assert store.run("normalized", rows, "src", "d", "me")["replayed"] is False
    assert store.table("edges").count() == 1 and store.jobs().first().status == "SUCCEEDED"
    assert store.receipts().where(F.col("status") == "FAILED").count() == 0
    with pytest.raises(ValueError, match="unknown format"):
        store.run("nothing", rows, "src", "d2", "me")


def test_packed_ids_are_the_ids(spark):
    ids = ["a" * 64, "A" * 64, "0f" * 32, "0f" * 32 + "\n", "f" * 63, "f" * 65, "", "e7", "é", "\x01" + "ab", None]
    rows = spark.createDataFrame([(v,) for v in ids], "v string").select("v", packed(F.col("v")).alias("p")).withColumn("u", unpacked(F.col("p")))
    got = rows.collect()
    assert [r.u for r in got] == [r.v for r in got] and len({bytes(r.p) for r in got if r.p is not None}) == len(ids) - 1
    assert rows.where("length(p) <= 33 and length(v) = 64").count() == 2


def test_import_keeps_mapped_matched_and_minted_ids_and_moves_them_packed(spark, tmp_path):
    entity = "key string, name string, entity_type string, scheme string, identifier string"
    entities = spark.createDataFrame([("k1", "A", "ORGANIZATION", None, None), ("k2", "B", "ORGANIZATION", "LEI", "X1"), ("k3", "C", "ORGANIZATION", "LEI", "X2"), ("k4", "D", "CONTRACT", None, None)], entity)
    edge = "subject string, object string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz, amount decimal(24,6), currency string, ownership_percent decimal(7,4), contract string, locator string"
    edges = spark.createDataFrame([("k1", "k2", "AWARDED_TO", None, None, None, None, None, "k4", "/1"), ("k3", "k1", "OWNS", None, None, None, None, None, None, "/2"), ("k1", "k2", "AWARDED_TO", None, None, None, None, None, "k4", "/1"), ("k1", "gone", "OWNS", None, None, None, None, None, None, "/3")], edge)
    mappings = spark.createDataFrame([("s", "k1", "mapped")], imports.NO_MAPPINGS)
    identifiers = spark.createDataFrame([("known", "LEI", "X1", None, True, 1)], imports.NO_IDENTIFIERS)
    folder = str(tmp_path / "staged")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("candela.session.staging_folder", lambda spark: folder)
        tables = imports.import_tables(Parsed(entities, edges, None), "s", "b", mappings, identifiers)
    digest = lambda *parts: hashlib.sha256("|".join("~" if p is None else f"={p}" for p in parts).encode()).hexdigest()
    ids = {"k1": "mapped", "k2": "known", "k3": digest("LEI", "X2", None), "k4": digest("s", "k4")}
    assert {(r.entity_id, r.name) for r in tables["entities"].collect()} == set(zip(ids.values(), "ABCD"))
    want = {("mapped", "AWARDED_TO", "known"), (ids["k3"], "OWNS", "mapped")}
    found = tables["edges"].collect()
    assert {(r.subject_id, r.relation, r.object_id) for r in found} == want
    assert {r.semantic_key for r in found} == {digest(s, p, o, None, None) for s, p, o in want}
    assert {(r.subject_entity_id, r.predicate) for r in tables["claims"].collect()} == {w[:2] for w in want} and tables["claims"].count() == 2
    assert [tuple(r) for r in tables["quarantine"].collect()] == [("edge", "unresolved_reference")]
    # The id of a key's own digest is staged as a mark, other digests as 33 bytes.
    held = {r.key: bytes(r.entity_id) for r in spark.read.parquet(folder + "/ids-*").collect()}
    assert held["k4"] == imports.OWN and len(held["k3"]) == 33 and held["k1"] == b"\x00mapped"
