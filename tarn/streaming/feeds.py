"""Change feeds with state: what a key has seen last is kept by the stream, not read from the table.

A stateful operator holds one sequence per key in RocksDB and lets through only changes behind it,
the last one of each key in a batch. Applying a batch then touches the buckets of its own keys and
no others; the table's keys are never read to find out what is late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarn.lake.keyed import KeyedTable
from tarn.operators.merge import require_columns

#: The state store that holds keys on disk and in batches, so that their number is not bound by memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"
#: Columns on the way through the operator (names with an underscore ahead would be changed there).
KEY, SLOT = "key_of_change", "slot_of_change"
#: Groups that keys are handled in: a few for each shuffle partition. Fixed for the life of a checkpoint.
SLOTS = 1024


class LastAccepted(StatefulProcessor):
    """Emits a key's last change of a batch if its sequence is above all before; the state maps keys to sequences.

    Works on the keys of one slot at a time, so that pandas handles many keys in a call; the state is
    still one small entry per key.
    """

    def __init__(self, columns: Sequence[str], seq: Sequence[str], state: T.StructType):
        self.columns, self.seq, self.state = list(columns), list(seq), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", T.StructType([T.StructField(KEY, T.StringType())]), self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            both = part if best is None else pd.concat([best, part], ignore_index=True)
            # A stable sort keeps the first of equal sequences ahead; only a key's best row is held.
            best = both.sort_values(self.seq, kind="stable", ascending=False).drop_duplicates(KEY, keep="first")
        if best is None or best.empty:
            return
        places = list(zip(*(best[c].tolist() for c in self.seq), strict=True))
        later = []
        for name, place in zip(best[KEY].tolist(), places, strict=True):
            seen = self.last.getValue((name,))
            later.append(seen is None or place > tuple(seen))
            if later[-1]:
                self.last.updateValue((name,), place)
        accepted = best[later]
        if len(accepted):
            yield accepted[self.columns]

    def close(self) -> None:
        pass


def _as_long(df: DataFrame, column: str):
    """A sequence as a long that orders alike: microseconds of a time, days of a date, the number itself."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(column).cast("bigint")
    raise ValueError(f"{column} is neither a whole number nor a time")


def accepted_changes(
    changes: DataFrame, pk: str | Sequence[str], seq: str | Sequence[str], slots: int = SLOTS
) -> DataFrame:
    """The stream of changes that are later than all their key has seen, one per key and batch.

    ``seq`` columns are whole numbers or times and compare in order; a change without a sequence
    (NULL) is before all others and only accepted as a key's first. Of equal sequences one stays,
    and none is accepted after it. NULL keys are keys. Rows keep the columns of ``changes``. State
    is an entry of key and sequence for each key; ``slots`` bounds how many keys one call sees and
    must stay the same for a checkpoint.
    """
    pk, seq = ([pk] if isinstance(pk, str) else list(pk)), ([seq] if isinstance(seq, str) else list(seq))
    require_columns(changes, [*pk, *seq], "key or sequence")
    names = [f"seq_of_change_{i}" for i in range(len(seq))]
    least = F.lit(-(1 << 63)).cast("bigint")
    ordered = changes.withColumns({
        **{n: F.coalesce(_as_long(changes, c), least) for n, c in zip(names, seq, strict=True)},
        KEY: F.to_json(F.struct(*pk), {"ignoreNullFields": "false"}),
        SLOT: F.pmod(F.xxhash64(*pk), F.lit(slots)).cast("int"),
    })
    state = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return ordered.groupBy(SLOT).transformWithStateInPandas(
        statefulProcessor=LastAccepted(changes.columns, names, state), outputStructType=changes.schema,
        outputMode="Update", timeMode="None",
    )


@contextmanager
def disk_state(spark: SparkSession):
    """State of queries started inside is kept by RocksDB."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, before)


def stream_into_keyed(
    table: KeyedTable, stream: DataFrame, seq: str | Sequence[str], op_col: str, checkpoint: str, delete_op: str = "delete",
    slots: int = SLOTS,
) -> list[tuple[int, int]]:
    """Apply all that has landed of a change feed, in any order, then stop; the next call goes on after it.

    Returns (changes accepted, buckets rewritten) of each batch. A batch given again after a crash
    finds the state before it and applies the same changes, which leaves the table as it is.
    Columns of the stream that the table lacks (the sequence, say) stay out of it.
    """
    accepted = accepted_changes(stream, table.pk, seq, slots)
    done: list[tuple[int, int]] = []
    extra = [c for c in stream.columns if c not in table.schema.fieldNames() and c != op_col]

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rewrite = table.apply(batch.drop(*extra), op_col, delete_op)
            done.append((batch.count(), rewrite.rewritten))
        finally:
            batch.unpersist()

    with disk_state(stream.sparkSession):
        query = (
            accepted.writeStream.foreachBatch(handle).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return done
