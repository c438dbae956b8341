"""Sinks that survive failures between their writes, and chains sealed over several batches."""

import hashlib

import pytest
from pyspark.errors import StreamingQueryException

from candela.operators import audit
from candela.streaming import jobs


def land(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, landed, out, checkpoint):
    stream = jobs.read_landing(spark, f"{landed}/*", "batch_id long, payload string", files_per_batch=1)
    jobs.ingest_envelopes(stream, out, checkpoint).awaitTermination()


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_failure_between_the_writes_doubles_and_loses_nothing(spark, tmp_path, monkeypatch, step):
    landed, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    land(spark, landed, [(1, "a"), (2, "b"), (3, "a")], "batch_id long, payload string", "f1")
    run(spark, landed, out, checkpoint)
    land(spark, landed, [(4, "b"), (5, "c"), (6, "d")], "batch_id long, payload string", "f2")
    own = getattr(jobs.BatchSink, step)

    def failing(self, *args, **kw):
        if step == "write":
            own(self, *args, **kw)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(jobs.BatchSink, step, failing)
    with pytest.raises(StreamingQueryException):
        run(spark, landed, out, checkpoint)
    seen = jobs.committed(spark, out, jobs.ENVELOPES)
    assert sorted(r.payload for r in seen.collect()) == ["a", "b"]  # what the failed batch wrote is invisible
    monkeypatch.undo()
    run(spark, landed, out, checkpoint)
    want = [(1, "a"), (2, "b"), (5, "c"), (6, "d")]
    got = jobs.committed(spark, out, jobs.ENVELOPES).collect()
    assert sorted((r.batch_id, r.payload) for r in got) == want
    assert {r.digest for r in got} == {hashlib.sha256(p.encode()).hexdigest() for _, p in want}
    # A stream with another checkpoint starts at batch 0 again and finds all digests.
    run(spark, landed, out, f"{tmp_path}/other")
    assert jobs.committed(spark, out, jobs.ENVELOPES).count() == 4


def test_a_batch_with_its_receipt_is_not_written_again(spark, tmp_path):
    sink = jobs.BatchSink(spark, f"{tmp_path}/out", "x int", "ck")
    sink.write(spark.createDataFrame([(1,)], "x int"), 0)
    assert not sink.done(0) and sink.written().count() == 0
    sink.commit(0)
    assert sink.done(0) and not sink.done(1) and [r.x for r in sink.written().collect()] == [1]
    assert sink.written(besides=sink.token(0)).count() == 0


def test_chains_of_text_keys_go_on_over_batches(spark, tmp_path):
    landed, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "chain string, seq int, body string"
    rows = [("x", k, f"b{k}") for k in range(6)] + [("y", k, None) for k in range(3)] + [(None, 1, "n")]
    for k, part in enumerate((rows[:3], rows[3:5] + rows[6:8], rows[5:6] + rows[8:])):
        land(spark, landed, part, schema, f"f{k}")
    stream = jobs.read_landing(spark, f"{landed}/*", schema, files_per_batch=1)
    jobs.seal_events(stream, "chain", "seq", ["seq", "body"], out, f"{tmp_path}/ck").awaitTermination()
    got = jobs.committed(spark, out, jobs.sealed_schema(stream, "chain", "seq"))
    want = audit.seal(spark.createDataFrame(rows, schema), "chain", "seq", ["seq", "body"])
    columns = ["chain", "seq", "previous_hash", "event_hash"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
