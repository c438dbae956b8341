"""Case workflow, claim reviews and corrections, as folds over events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.session import staged

#: Fixed values: (state, action) pairs that are legal and the state they lead to.
TRANSITIONS = {
    ("OPEN", "review"): "REVIEWED",
    ("REVIEWED", "publish"): "PUBLISHED",
    ("PUBLISHED", "withdraw"): "WITHDRAWN",
    ("PUBLISHED", "appeal"): "OPEN",
    ("WITHDRAWN", "appeal"): "OPEN",
}


#: All states, the one that cases begin in first.
STATES = ["OPEN", *sorted(set(TRANSITIONS.values()) - {"OPEN"})]
CHUNK = "case_id {key}, chunk int, n long, ends array<struct<state: int, accepted: long, published: long>>"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (case_id, chunk, seq, action), sorted, as one map per chunk: for each state where the chunk's actions lead from it."""
    step = [{action: STATES.index(to) for (state, action), to in TRANSITIONS.items() if state == own} for own in STATES]
    published = STATES.index("PUBLISHED")
    now, n, ends = None, 0, []

    def told() -> pa.RecordBatch:
        rows = [{"state": s, "accepted": a, "published": p} for s, a, p in ends]
        kind = pa.list_(pa.struct([("state", pa.int32()), ("accepted", pa.int64()), ("published", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([now[0]], key), pa.array([now[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([rows], kind)], ["case_id", "chunk", "n", "ends"])

    for batch in batches:
        key = batch.schema.types[0]
        for case, chunk, action in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if now != (case, chunk):
                if now:
                    yield told()
                now, n, ends = (case, chunk), 0, [[k, 0, 0] for k in range(len(STATES))]
            n += 1
            for end in ends:
                to = step[end[0]].get(action)
                if to is not None:
                    end[0] = to
                    end[1] += 1
                    end[2] += to == published
    if now:
        yield told()


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (case_id, chunk, seq, action, start, published) as (case_id, seq, number, opens): accepted publications and what ends them."""
    known = STATES.index("PUBLISHED")
    now, state, number = None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for case, chunk, seq, action, start, before in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (case, chunk):
                now, state, number = (case, chunk), start, before
            to = TRANSITIONS.get((STATES[state], action))
            if to is not None:
                if to == "PUBLISHED":
                    number += 1
                    out.append((case, seq, number, True))
                elif state == known:
                    out.append((case, seq, number, False))
                state = STATES.index(to)
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [batch.schema.types[0], batch.schema.types[2], pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["case_id", "seq", "number", "opens"])


def _chunks(events: DataFrame) -> DataFrame:
    """The events with a chunk: ranges of (case_id, seq) of alike size, so a long case is in many of them."""
    rows = events.select("case_id", "seq", "action").repartitionByRange("case_id", "seq")
    return staged(rows.withColumn("chunk", F.spark_partition_id()).select("case_id", "chunk", "seq", "action"), "chunks")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("case_id", "chunk").sortWithinPartitions("case_id", "chunk", "seq")


def _ends(chunks: DataFrame) -> DataFrame:
    """Per case its chunks' maps folded in order: the end, and the state and publications at each chunk's start.

    Maps from state to state combine whatever their chunks' sizes, so chunks are
    folded apart; a case has at most as many as there are partitions.
    """
    maps = _in_order(chunks).mapInArrow(_folded, CHUNK.format(key=chunks.schema["case_id"].dataType.simpleString()))
    per = maps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "ends"))).alias("parts"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("state"), zero.alias("accepted"), zero.alias("published"), zero.alias("n"), F.array().cast("array<struct<chunk: int, state: int, published: bigint>>").alias("starts"))

    def step(acc, part):
        end = F.get(part["ends"], acc["state"])
        begin = F.struct(part["chunk"].alias("chunk"), acc["state"].alias("state"), acc["published"].alias("published"))
        return F.struct(end["state"].alias("state"), (acc["accepted"] + end["accepted"]).alias("accepted"), (acc["published"] + end["published"]).alias("published"), (acc["n"] + part["n"]).alias("n"), F.concat(acc["starts"], F.array(begin)).alias("starts"))

    return per.select("case_id", F.aggregate("parts", start, step).alias("end")).select("case_id", "end.*")


def case_states(events: DataFrame) -> DataFrame:
    """Per case its state after its actions in order, how many were legal, and how often it was published.

    events: case_id, seq (unique in a case), action. An illegal action changes
    nothing and counts as rejected.
    """
    names = F.array(*[F.lit(s) for s in STATES])
    return _ends(_chunks(events)).select("case_id", F.get(names, F.col("state")).alias("state"), "accepted", (F.col("n") - F.col("accepted")).alias("rejected"), "published")


def case_releases(events: DataFrame) -> DataFrame:
    """A row for each time a case was published: when, and when a withdrawal or an appeal ended it, if one did."""
    chunks = _chunks(events)
    starts = staged(_ends(chunks).select("case_id", F.explode("starts").alias("s")).select("case_id", "s.*"), "starts")
    rows = _in_order(chunks.join(starts, ["case_id", "chunk"])).select("case_id", "chunk", "seq", "action", "state", "published")
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    moves = rows.mapInArrow(_moved, f"case_id {kind['case_id']}, seq {kind['seq']}, number long, opens boolean")
    at = lambda opens: F.max(F.when(F.col("opens") == opens, F.col("seq")))
    return moves.groupBy("case_id", "number").agg(at(True).alias("published_at"), at(False).alias("withdrawn_at"))


def public_releases(releases: DataFrame, limit: int = 100) -> DataFrame:
    """Releases that aren't withdrawn, newest first."""
    rows = releases.where("withdrawn_at is null").select("release_id", "title", "summary", "published_at")
    return rows.orderBy(F.col("published_at").desc(), "release_id").limit(limit)


def duty_violations(cases: DataFrame) -> DataFrame:
    """Cases whose reviewer created them, or whose publisher created or reviewed them."""
    reviewed = F.col("reviewer") == F.col("creator")
    published = (F.col("publisher") == F.col("creator")) | (F.col("publisher") == F.col("reviewer"))
    return cases.where(F.coalesce(reviewed, F.lit(False)) | F.coalesce(published, F.lit(False)))


def review_claims(claims: DataFrame, reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each review's outcome; verification needs evidence, and synthetic evidence never promotes."""
    found = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.coalesce(F.bool_or("is_demo"), F.lit(False)).alias("any_demo"))
    rows = reviews.join(claims.select("claim_id", "verification_status"), "claim_id", "left").join(found, "claim_id", "left")
    n, demo = F.coalesce("n_evidence", F.lit(0)), F.coalesce("any_demo", F.lit(False))
    promotes = F.col("new_status") != "RETRACTED"
    reason = F.when(F.col("verification_status").isNull(), "UNKNOWN_CLAIM").when(promotes & (n == 0), "NO_EVIDENCE").when(promotes & demo, "SYNTHETIC_EVIDENCE").otherwise("ACCEPTED")
    status = F.when(reason == "ACCEPTED", F.col("new_status")).otherwise(F.col("verification_status"))
    return rows.select("claim_id", reason.alias("outcome"), status.alias("verification_status"), n.alias("n_evidence"))


def correct_validity(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """Version images after corrections: the new interval and an unverified claim; others unchanged."""
    fix = corrections.select("edge_id", F.col("valid_from").alias("new_from"), F.col("valid_to").alias("new_to"), F.lit(True).alias("corrected"))
    rows = edges.join(fix, "edge_id", "left")
    hit = F.coalesce("corrected", F.lit(False))
    return rows.select(
        "edge_id",
        F.when(hit, F.col("new_from")).otherwise(F.col("valid_from")).alias("valid_from"),
        F.when(hit, F.col("new_to")).otherwise(F.col("valid_to")).alias("valid_to"),
        F.when(hit, F.lit("UNVERIFIED")).otherwise(F.col("verification_status")).alias("verification_status"),
        hit.alias("corrected"),
    )


def retire_parser(rows: DataFrame, method: str) -> DataFrame:
    """Rows derived by a method are retracted and superseded; others stay."""
    hit = F.col("derivation_method") == method
    return rows.withColumns({"verification_status": F.when(hit, "RETRACTED").otherwise(F.col("verification_status")), "superseded": F.col("superseded") | F.coalesce(hit, F.lit(False))})
