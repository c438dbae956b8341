"""Version stores, folded cases, percentiles by histogram, binned cutoffs and evidence stores against plain Python."""

import random
from datetime import datetime as D
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from candela.operators import cases, evidence, metrics, temporal, versions


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")


def test_version_store(spark, tmp_path, monkeypatch):
    store = versions.VersionStore(spark, f"{tmp_path}/v", "k", {"k": "int", "a": "string", "b": "int"})
    rows = lambda *r: spark.createDataFrame(r, "k int, a string, b int")
    state = lambda day: sorted((r.k, r.a, r.b) for r in store.snapshot(at(day)).collect())
    one, two, three = [(1, "x", 1), (2, None, 2), (3, "z", None)], [(1, "x", 1), (2, None, 3), (4, "n", 4)], [(3, "z", None), (4, "n", 4)]
    assert store.load(rows(*one, (1, "a", 0)), at(1)) == 1
    assert store.load(rows(*two), at(2)) == 2
    # A load that fails before its receipt is as if it had not been.
    with monkeypatch.context() as m:
        m.setattr(store, "_receipt", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.load(rows((9, "bad", 9)), at(3))
    assert state(9) == two
    assert store.load(rows(*three), at(3)) == 3
    assert [state(d) for d in (1, 2, 3)] == [one, two, three]
    kinds = sorted((r.version_id, r.operation, r.k) for r in store.log().collect())
    assert kinds == [(1, "BASELINE", 1), (1, "BASELINE", 2), (1, "BASELINE", 3), (2, "DELETE", 3), (2, "INSERT", 4), (2, "UPDATE", 2), (3, "DELETE", 1), (3, "DELETE", 2), (3, "INSERT", 3)]
    store.compact(2)
    assert [state(d) for d in (2, 3)] == [two, three]
    with pytest.raises(LookupError, match="HISTORY_UNAVAILABLE"):
        store.snapshot(at(1))
    assert store.load(rows(*three), at(4)) == 4 and store.log().where("version_id = 4").count() == 0
    assert store.load(rows().limit(0), at(5)) == 5 and state(5) == []
    with pytest.raises(Exception, match="without a key"):
        store.load(rows((None, "x", 1)), at(6))


def brute_case(actions):
    state, accepted, releases = "OPEN", 0, []
    for seq, action in sorted(actions):
        to = cases.TRANSITIONS.get((state, action))
        if to:
            accepted += 1
            if to == "PUBLISHED":
                releases.append([seq, None])
            elif state == "PUBLISHED":
                releases[-1][1] = seq
            state = to
    return state, accepted, len(actions) - accepted, releases


@pytest.fixture()
def uncoalesced(spark):
    """Small partitions stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_cases_fold_over_chunks(spark, uncoalesced):
    rng = random.Random(5)
    own = {"hot": 400, "b": 7, "c": 1, None: 5}
    rows = [(c, k, rng.choice(["review", "publish", "withdraw", "appeal", "note", None])) for c, n in own.items() for k in range(n)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "case_id string, seq int, action string").repartition(5)
    chunks = cases._chunks(events)
    assert chunks.where("case_id = 'hot'").select("chunk").distinct().count() > 1
    want = {c: brute_case([(s, a) for x, s, a in rows if x == c]) for c in own}
    got = {r.case_id: (r.state, r.accepted, r.rejected, r.published) for r in cases.case_states(events).collect()}
    assert got == {c: (s, a, r, len(p)) for c, (s, a, r, p) in want.items()}
    told = sorted((str(r.case_id), r.number, r.published_at, r.withdrawn_at) for r in cases.case_releases(events).collect())
    assert told == sorted((str(c), k, p, w) for c, (_, _, _, ps) in want.items() for k, (p, w) in enumerate(ps, 1))
    assert cases.case_releases(events.where("false")).count() == cases.case_states(events.where("false")).count() == 0


@pytest.mark.parametrize(("cuts", "ordered"), [(4, 3), (1024, 100_000)])
def test_percentiles_by_histogram(spark, cuts, ordered):
    rng = random.Random(2)
    values = {"a": [rng.randrange(1000) for _ in range(500)], "b": [7] * 40, "c": [3], None: [rng.randrange(5) for _ in range(30)], "d": [0] * 99 + [10**9]}
    rows = [(k, Decimal(v) / 1000) for k, vs in values.items() for v in vs] + [("a", None)]
    got = {r.route: (r.p50, r.p95, r.p99) for r in metrics.latency_percentiles(spark.createDataFrame(rows, "route string, latency decimal(24,6)"), ["route"], cuts, ordered).collect()}
    for key, vs in values.items():
        s, n = sorted(Decimal(v) / 1000 for v in vs), len(vs)
        assert got[key] == (float((s[(n + 1) // 2 - 1] + s[n // 2]) / 2), s[max(1, n * 95 // 100) - 1], s[max(1, n * 99 // 100) - 1])


@pytest.mark.parametrize(("few", "bins"), [(0, 3), (0, 1024), (256, 8)])
def test_many_cutoffs(spark, few, bins):
    rng = random.Random(9)
    day = lambda: D(2024, 1, 1) + timedelta(hours=rng.randrange(400))
    intervals = [(k, s, s + timedelta(hours=rng.randrange(1, 200)) if rng.random() < 0.8 else None, rng.choice(["INSERT", "DELETE"])) for k in range(60) for s in [day()]] + [(99, None, None, "INSERT")]
    cutoffs = [(day(),) for _ in range(30)] + [(D(2023, 1, 1),), (D(2030, 1, 1),), (None,)]
    got = temporal.as_of_many(spark.createDataFrame(intervals, "record_id int, known_from timestamp_ntz, known_to timestamp_ntz, operation string"), spark.createDataFrame(cutoffs, "known_at timestamp_ntz"), few=few, bins=bins)
    want = [(k, t) for k, s, e, o in intervals for (t,) in cutoffs if o != "DELETE" and t and s and s <= t and (e is None or t < e)]
    assert sorted((r.record_id, r.known_at) for r in got.collect()) == sorted(want)


def test_many_cutoffs_need_no_nested_loop(spark, capsys):
    intervals = spark.createDataFrame([(1, D(2024, 1, 1), None, "INSERT")], "record_id int, known_from timestamp_ntz, known_to timestamp_ntz, operation string")
    cutoffs = spark.range(1000).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("known_at"))
    temporal.as_of_many(intervals, cutoffs).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_running_totals_meet_no_pair_of_version_and_cutoff(spark, capsys):
    rng = random.Random(4)
    day = lambda: D(2024, 1, 1) + timedelta(hours=rng.randrange(300))
    intervals = [(s, s + timedelta(hours=rng.randrange(0, 90)) if rng.random() < 0.8 else None, rng.choice(["INSERT", "DELETE"]), rng.choice([None, Decimal(rng.randrange(-500, 500)) / 8])) for _ in range(80) for s in [day()]] + [(None, None, "INSERT", Decimal(1)), (D(2023, 6, 1), D(2023, 6, 2), "INSERT", None)]
    cutoffs = {day() for _ in range(50)} | {D(2023, 6, 1, 5), D(2022, 1, 1), D(2030, 1, 1), None}
    rows, asked = spark.createDataFrame(intervals, "known_from timestamp_ntz, known_to timestamp_ntz, operation string, value decimal(24,6)"), spark.createDataFrame([(t,) for t in cutoffs], "known_at timestamp_ntz")
    want = {}
    for t in cutoffs - {None}:
        live = [v for s, e, o, v in intervals if o != "DELETE" and s and s <= t and (e is None or t < e)]
        if live:
            want[t] = (len(live), sum((v for v in live if v is not None), Decimal(0)) if any(v is not None for v in live) else None)
    for bins in (1, 3, 1024):
        got = temporal.live_totals(rows, asked, "value", bins=bins)
        assert {r.known_at: (r.live, r.total) for r in got.collect()} == want
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_evidence_store(spark, tmp_path):
    store = evidence.EvidenceStore(spark, f"{tmp_path}/e")
    rows = lambda *r: spark.createDataFrame([(s, e, bytearray(c) if c is not None else None) for s, e, c in r], "source string, external_id string, content binary")
    done = lambda df: sorted(r.status for r in df.collect())
    assert done(store.put(rows(("s", "a", b"1"), ("s", "a", b"1"), ("s", "b/.. x", b"")), "p1")) == ["STORED", "STORED"]
    assert done(store.put(rows(("s", "a", b"1"), ("s", "a", b"2")), "p2")) == ["PRESENT", "STORED"]
    assert store.objects().count() == 3 and store.changed().count() == 0
    # A put without its receipt has stored nothing.
    spark.createDataFrame([("s", "z", "h", 1, "s/z", bytearray(b"z"))], "source string, external_id string, content_hash string, byte_length long, object_key string, content binary").write.parquet(f"{tmp_path}/e/objects/put=lost")
    assert store.objects().count() == 3
    assert {r.object_key.split("/")[2] for r in store.objects().collect()} == {"a", "b_.._x"}
