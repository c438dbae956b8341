"""Hash chains over audit events, one per chain key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StringType, StructField, StructType

from candela.functions.keys import marked

GENESIS = "0" * 64


def _chained(at_chain: int, at_body: int, at_head: int):
    """Rows of a partition sorted by chain and order, with the previous and their own hash; a chain starts at its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), GENESIS
        for batch in batches:
            previous, own = [], []
            for chain, body, head in zip(*(batch.column(k).to_pylist() for k in (at_chain, at_body, at_head))):
                if chain != now:
                    now, last = chain, head
                previous.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                own.append(last)
            columns = [c for k, c in enumerate(batch.columns) if k not in (at_body, at_head)]
            names = [n for k, n in enumerate(batch.schema.names) if k not in (at_body, at_head)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], [*names, "previous_hash", "event_hash"])

    return run


def seal(events: DataFrame, chain: str, order: str, payload: list[str], heads: DataFrame | None = None) -> DataFrame:
    """ST6: each event with the previous hash and its own, which covers both.

    heads (chain's column, event_hash) has the last hash of chains that go on.

    A chain is sequential by nature, so its events stream through one task in
    order, with one hash held; a log is keyed into chains by source or day.
    """
    body = F.concat_ws("|", *[marked(F.col(c)) for c in payload])
    rows = events.withColumn("__body", body)
    if heads is None:
        rows = rows.withColumn("__head", F.lit(GENESIS))
    else:
        known = heads.select(F.col(chain).alias("__chain"), F.col("event_hash").alias("__hash"))
        rows = rows.join(known, F.col(chain).eqNullSafe(F.col("__chain")), "left").select(*rows.columns, F.coalesce("__hash", F.lit(GENESIS)).alias("__head"))
    rows = rows.repartition(chain).sortWithinPartitions(chain, order, "__body")
    schema = StructType([*events.schema.fields, StructField("previous_hash", StringType()), StructField("event_hash", StringType())])
    return rows.mapInArrow(_chained(events.columns.index(chain), len(events.columns), len(events.columns) + 1), schema)


def check(sealed: DataFrame, chain: str, order: str, payload: list[str]) -> DataFrame:
    """Events whose link or own hash is broken."""
    w = W.Window.partitionBy(chain).orderBy(order)
    body = F.concat_ws("|", *[marked(F.col(c)) for c in payload])
    wanted = F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))
    own = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), body), 256)
    rows = sealed.withColumns({"link_ok": F.col("previous_hash") == wanted, "hash_ok": F.col("event_hash") == own})
    return rows.where(~F.col("link_ok") | ~F.col("hash_ok"))
