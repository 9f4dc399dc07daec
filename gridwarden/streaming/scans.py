"""Port scans on a stream, in event-time order."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridwarden.functions import constants as K
from gridwarden.functions.times import epoch_micros, event_time
from gridwarden.operators.detect import MICROS, _scan_rows

#: Rows taken together, and in how many parts they wait at most if none is a slot of its own.
ROWS_AT_ONCE, PARTS = 200_000, 100

_OUT = "src string, us bigint, dst string, port int, start bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark):
    """Streams started from now on keep their state in RocksDB, which state per key and timers
    need; a stream with a checkpoint stays with what it has."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def detect_scans_stream(conn, threshold=K.SCAN_PORTS, seconds=K.SCAN_SECONDS, refire=False,
                        watermark="10 minutes", slot_seconds=None):
    """``detect_scans`` for a stream of connections.

    A connection is logged when it ends but timed when it starts, so the watermark should
    exceed the longest connection of interest. Rows wait until the watermark has passed the end
    of their time slot, and a source's slots are then taken in time order, so the result does not
    depend on arrival. What waits lies in the state store, each ``ROWS_AT_ONCE`` rows of a source
    in time order, packed in parts of a slot or of neighbouring ones with few rows; the parts are
    merged as the watermark passes them. A task holds ``ROWS_AT_ONCE`` rows of one source or one
    slot, and of each such run the part that is being merged. Of the
    open window the state has the start and at most ``threshold`` + 1 ports, and a timer at its
    end drops it. Slots are as long as a window unless ``slot_seconds`` says otherwise: longer
    ones answer later and cost less, as for logs of the past.

    Connections of a source with the same time and port (``refire``: and protocol) wait as one
    row per batch of rows, with their number and the least of the other hosts.
    """
    keyed_state(conn.sparkSession)
    events = conn.select(
        F.col("orig_h").alias("src"), F.col("resp_h").alias("dst"),
        F.col("resp_p").alias("port"), F.coalesce("proto", F.lit("")).alias("proto"),
        epoch_micros(F.col("ts")).alias("us"), event_time(F.col("ts")).alias("event_time"),
    ).where("src IS NOT NULL AND us IS NOT NULL").withWatermark("event_time", watermark)
    hits = events.groupBy("src").transformWithStateInPandas(
        ScanTracker(threshold, seconds * MICROS, refire, (slot_seconds or seconds) * MICROS),
        _OUT, "Append", "EventTime")
    message = K.SCAN_MESSAGE_SENSOR if refire else K.SCAN_MESSAGE_AGENT
    return _scan_rows(hits, threshold, message, agent=not refire)


class ScanTracker(StatefulProcessor):
    """The scans of one source after another; see ``detect_scans_stream``."""

    def __init__(self, threshold, width, refire, slot):
        self.threshold, self.width, self.refire, self.slot = threshold, width, refire, slot
        self.same = ["us", "port", "proto"] if refire else ["us", "port"]

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, seen array<string>")
        self.index = handle.getValueState("index", "slots array<bigint>, parts array<bigint>")
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", "rows binary")

    def close(self):
        pass

    def _waiting_parts(self):
        return dict(zip(*self.index.get())) if self.index.exists() else {}

    def handleInputRows(self, key, rows, timerValues):
        parts = self._waiting_parts()
        first, held, size = min(parts, default=None), [], 0
        for pdf in rows:
            held.append(pdf)
            size += len(pdf)
            if size >= ROWS_AT_ONCE:
                self._store(pd.concat(held), parts)
                held, size = [], 0
        if held:
            self._store(pd.concat(held), parts)
        self._keep(parts)
        if first is None or min(parts) < first:
            self._wake(min(parts) + 1)
        yield from ()

    def _store(self, rows, parts):
        packed = rows.groupby(self.same, as_index=False).agg(
            dst=("dst", "min"), n=("us", "size")).astype({"port": np.int32})
        self._put(pa.Table.from_pandas(packed, preserve_index=False), parts)

    def _put(self, table, parts):
        """Write rows in time order, under the first slot of each part. A part takes whole slots
        until it has a share of ``ROWS_AT_ONCE``: scattered rows are not written slot by slot."""
        slots, at = np.unique(table.column("us").to_numpy() // self.slot, return_index=True)
        begin = 0
        for i, end in enumerate([*at[1:].tolist(), len(table)]):
            if end - at[begin] < ROWS_AT_ONCE // PARTS and end < len(table):
                continue
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, table.schema) as writer:
                    writer.write_table(table.slice(at[begin], end - at[begin]))
                slot = int(slots[begin])
                part = parts.get(slot, 0)
                self.waiting.updateValue((slot, part), (out.getvalue().to_pybytes(),))
            parts[slot] = part + 1
            begin = i + 1

    def _keep(self, parts):
        if parts:
            self.index.update((list(parts), list(parts.values())))
        elif self.index.exists():
            self.index.clear()

    def _wake(self, slot):
        self.handle.registerTimer(slot * self.slot // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Slots before this one are complete: what comes yet is later.
        now = timerValues.getCurrentWatermarkInMs() * 1000 // self.slot
        start, seen = self.open.get() if self.open.exists() else (None, [])
        known, parts, held, size, most = start, self._waiting_parts(), [], 0, ROWS_AT_ONCE
        due = sorted(slot for slot in parts if slot < now)
        rest = []
        for at, slot in enumerate(due):
            for part in range(parts.pop(slot)):
                with pa.ipc.open_stream(self.waiting.getValue((slot, part))[0]) as reader:
                    table = reader.read_all()
                self.waiting.removeKey((slot, part))
                complete, later = self._cut(table, now)
                held.append(complete)
                size += len(complete)
                if len(later):
                    rest.append(later)
            last = slot == due[-1]
            if size >= most or last:
                # Parts yet to come begin with their slot or later; what lies before is whole.
                tables, held = zip(*[self._cut(t, now if last else due[at + 1]) for t in held])
                held = [t for t in held if len(t)]
                size = sum(map(len, held))
                most = max(ROWS_AT_ONCE, 2 * size)
                start, seen, found = self._taken(tables, start, set(seen))
                if found is not None:
                    yield found.assign(src=key[0])[["src", "us", "dst", "port", "start"]]
        if rest:
            self._put(pa.concat_tables(rest).sort_by("us"), parts)
        if due:
            self._keep(parts)
        if start is not None and start + self.width < now * self.slot:
            if known is not None:
                self.open.clear()
            start = None
        elif due:
            self.open.update((start, sorted(seen)))
        if parts:
            self._wake(min(parts) + 1)
        elif start is not None:
            self._wake((start + self.width) // self.slot + 1)

    def _cut(self, table, slot):
        """The rows, in time order, before a slot and from it on."""
        at = int(np.searchsorted(table.column("us").to_numpy(), slot * self.slot))
        return table.slice(0, at), table.slice(at)

    def _taken(self, tables, start, seen):
        """The open window after these rows, and the rows that fire."""
        if not any(map(len, tables)):
            return start, seen, None
        rows = pa.concat_tables(tables).to_pandas().sort_values(
            [*self.same, "dst"], kind="stable", ignore_index=True)
        port = rows["port"].astype(str)
        start, seen, fired = advance(
            rows["us"].to_numpy(np.int64),
            (port + "/" + rows["proto"] if self.refire else port).to_numpy(object),
            start, seen, self.threshold, self.width, self.refire)
        if not fired:
            return start, seen, None
        at, starts = zip(*fired)
        hit = rows.iloc[list(at)].assign(start=starts)
        hit["port"] = hit["port"].astype(np.int32)
        return start, seen, hit.loc[hit.index.repeat(hit["n"])] if self.refire else hit


def advance(us, keys, start, seen, threshold, width, refire):
    """Take sorted events into the open window; (row, window start) of each that fires."""
    fired, at = [], 0
    while at < len(us):
        if start is None or us[at] - start > width:
            start, seen = int(us[at]), set()
        end = int(np.searchsorted(us, start + width, "right"))
        if len(seen) <= threshold:
            _, first = np.unique(keys[at:end].astype(str), return_index=True)
            new = [i for i in np.sort(first) + at if keys[i] not in seen]
            need = threshold - len(seen)
            if not refire and 0 < need <= len(new):
                fired.append((new[need - 1], start))
            if refire and need <= len(new):
                since = new[need - 1] if need else at
                until = new[need] if need < len(new) else end
                fired += [(i, start) for i in range(since, until)]
            seen |= {keys[i] for i in new[:max(need, 0) + 1]}
        at = end
    return start, seen, fired
