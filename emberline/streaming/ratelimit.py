"""A limit on notifications per recipient, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "recipient long, id long, at long, sent boolean"


def limited_batch(rows: DataFrame, seconds: int) -> DataFrame:
    """``rows`` (recipient, id, at) with sent: a message goes out if the recipient's last one that did is ``seconds`` back.

    The decision depends on the chain of all earlier ones, so a recipient's messages pass one task in order of time (then id); all
    it holds is a batch and the time of the last one sent, and it leaps from one sent to the next. A row without recipient or time
    is never sent.
    """

    def run(batches):
        who, last = None, 0
        for batch in batches:
            recipient, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            sent = np.zeros(len(batch), bool)
            heads = np.flatnonzero(np.concatenate(([True], recipient[1:] != recipient[:-1]))) if len(batch) else []
            for low, high in zip(heads, [*heads[1:], len(batch)], strict=True):
                known = who is not None and recipient[low] == who
                k = low + int(np.searchsorted(at[low:high], last + seconds)) if known else low
                who = recipient[low]
                while k < high:
                    sent[k], last = True, int(at[k])
                    k = max(k + 1, low + int(np.searchsorted(at[low:high], last + seconds)))
            yield pa.record_batch([*batch.columns, pa.array(sent)], names=["recipient", "id", "at", "sent"])

    plain = rows.select(F.col("recipient").cast("long"), F.col("id").cast("long"), F.col("at").cast("long"))
    usable = F.col("recipient").isNotNull() & F.col("at").isNotNull()
    dealt = plain.filter(usable).repartition("recipient").sortWithinPartitions("recipient", "at", "id")
    return dealt.mapInArrow(run, SCHEMA).unionByName(plain.filter(~usable).withColumn("sent", F.lit(False)))


def limited_stream(rows: DataFrame, seconds: int) -> DataFrame:
    """The same over a stream; the time of the last message sent is the state kept for each recipient. Each micro-batch's messages are taken in the order of their
    times; a recipient's share of a micro-batch is held in memory, so bound what a trigger reads."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        sent = []
        for at in rows["at"].tolist():
            due = last is None or at - last >= seconds
            last = at if due else last
            sent.append(due)
        if last is not None:
            state.update((last,))
        yield rows.assign(recipient=key[0], sent=sent)[["recipient", "id", "at", "sent"]]

    plain = rows.select(F.col("recipient").cast("long"), F.col("id").cast("long"), F.col("at").cast("long"))
    usable = F.col("recipient").isNotNull() & F.col("at").isNotNull()
    dealt = plain.filter(usable).groupBy("recipient").applyInPandasWithState(fold, SCHEMA, "last long", "append", "NoTimeout")
    return dealt.unionByName(plain.filter(~usable).withColumn("sent", F.lit(False)))
