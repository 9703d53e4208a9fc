"""The capture engine as keyed streaming state: a buffer of recent tokens per session that drains into a stored history.

Events are rows (session, seq, kind, batch_id, batch_size, key, value); kind is decode, prefill, flush or reset, key and
value hold the vectors of all heads one after the other (null for flush and reset). A prefill batch is handled when all
of its rows have come. Rows follow seq within an Arrow batch, and arrival across Arrow batches and micro-batches; a batch
is worked off before the next is taken, so a session's events are never held all at once. A source limit
(maxFilesPerTrigger) bounds what a micro-batch brings.

Events travel to the operator as blocks of a bucket's events, one binary value each, and what it gives travels on as such, so that
Spark hands over a row for each block and not for each event.

Output rows: out "token" for each drained token (session, epoch, chunk_id, seq, key, value), "reset" for a reset with the epoch
that it begins, whose chunks are numbered from 0 again, and "count" with a session's totals whenever its events have been worked off.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..errors import BufferTooSmall, InvalidDim
from ..operators.blocks import from_bytes, to_bytes
from ..operators.history import History
from ..specs import KvSpec

EVENTS = "session long, seq long, kind string, batch_id long, batch_size long, key array<float>, value array<float>"
OUTPUT = (
    "session long, out string, epoch long, chunk_id long, seq long, key array<float>, value array<float>, total long, compressed long, buffered long"
)
SESSION_STATE = "total long, compressed long, chunks long, epoch long, parts long, seqs array<long>, keys array<binary>, values array<binary>"
#: Sessions are dealt into so many groups of state. Part of a checkpoint: a stream goes on with the number that it began with.
BUCKETS = 1024
#: Events of a bucket that are put in order at once, and rows of a block that goes out.
HELD, ROWS = 1 << 16, 1 << 13
#: Bytes of events that a task deals over buckets at once.
DEALT_BYTES = 32 << 20
NUMBERS = ("session", "seq", "batch_id", "batch_size")


class Ring:
    """A buffer of up to `capacity` tokens in order of arrival, emptied as a whole."""

    def __init__(self, capacity: int, tokens=()):
        if capacity < 1:
            raise InvalidDim("the capacity must be positive")
        self.capacity, self.contents, self.total_written = capacity, list(tokens), 0

    def __len__(self) -> int:
        return len(self.contents)

    @property
    def space_left(self) -> int:
        return self.capacity - len(self.contents)

    @property
    def is_full(self) -> bool:
        return not self.space_left

    def write(self, tokens: list) -> None:
        """All of the tokens, or none if there is no room for all."""
        if len(tokens) > self.space_left:
            raise BufferTooSmall(f"{len(tokens)} tokens do not fit into {self.space_left} places")
        self.contents += tokens
        self.total_written += len(tokens)

    def drain(self) -> list:
        out, self.contents = self.contents, []
        return out

    def reset(self) -> None:
        self.contents, self.total_written = [], 0


class Engine:
    """The rules of the buffer over tokens of any kind; `drained` takes (chunk_id, token)."""

    def __init__(self, capacity: int, ring=(), total: int = 0, compressed: int = 0, chunks: int = 0, epoch: int = 0):
        self.buffer, self.total, self.compressed, self.chunks, self.epoch = Ring(capacity, ring), total, compressed, chunks, epoch
        self.drained: list[tuple] = []

    @property
    def ring(self) -> list:
        return self.buffer.contents

    def _out(self, tokens: list) -> None:
        if tokens:
            self.drained += [(self.chunks, t) for t in tokens]
            self.chunks += 1
            self.compressed += len(tokens)

    def drain(self) -> None:
        self._out(self.buffer.drain())

    def decode(self, tokens: list) -> None:
        """One after the other: a full buffer drains only when another token comes."""
        at = 0
        while at < len(tokens):
            if self.buffer.is_full:
                self.drain()
            part = tokens[at : at + self.buffer.space_left]
            self.buffer.write(part)
            at += len(part)
        self.total += len(tokens)

    def prefill(self, tokens: list) -> None:
        """All at once: the buffer drains first if they do not fit, and what is beyond its capacity goes past it."""
        lead = max(0, len(tokens) - self.buffer.capacity)
        if len(tokens) > self.buffer.space_left:
            self.drain()
        self._out(tokens[:lead])
        self.buffer.write(tokens[lead:])
        self.total += len(tokens)

    def reset(self) -> None:
        self.buffer.reset()
        self.total, self.compressed, self.chunks, self.epoch = 0, 0, 0, self.epoch + 1


class CaptureProcessor(StatefulProcessor):
    """Keeps buffer, counters and unfinished prefill batches of each session of a bucket and, with an order by time, what has come
    too early.

    A call has the sessions of one bucket (`BUCKETS`), so that what Spark asks for a call is asked once for many sessions; a session
    that has events costs one read and one write of its own row of the state. Vectors are bytes in the state and on their way through
    it. A session's row holds its buffer, at most `capacity` tokens; parts of unfinished batches are written once, as they come.
    """

    def __init__(self, capacity: int, bucket_ms: int = 0):
        self.capacity, self.bucket_ms = capacity, bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session long", SESSION_STATE)
        self.open = handle.getMapState("open", "session long, batch_id long", "rows long, parts string")
        self.waiting = handle.getMapState("waiting", "session long, part long", "tokens binary")
        if self.bucket_ms:
            self.parts = handle.getValueState("parts", "parts long")
            self.due = handle.getMapState("due", "part long", "at long")
            self.early = handle.getMapState("early", "part long", "events binary")

    def handleInputRows(self, key, rows, timerValues):
        if self.bucket_ms:
            for frame in _gathered(rows):
                self._keep(frame, timerValues.getCurrentWatermarkInMs())
        else:
            for frame in _gathered(_unpack_events(data) for blocks in rows for data in blocks["events"]):
                yield from self._work(frame, ["session", "seq"])

    def _until(self, frame):
        """The end of each event's step of time."""
        return (-(-(_milliseconds(frame["ts"]) + 1) // self.bucket_ms) * self.bucket_ms).to_numpy()

    def _keep(self, frame, now: int) -> None:
        """Puts events away by how far they are ahead, in powers of two of a step. A part is opened at its earliest step, what is then
        left of it is put away again, nearer, so an event is written as often as the logarithm of the steps that it waits."""
        import numpy as np

        until = self._until(frame)
        far = np.frexp(np.maximum((until - now) // self.bucket_ms, 1).astype(np.float64))[1]
        parts = (self.parts.get() or (0,))[0]
        for f in np.unique(far).tolist():
            at = int(until[far == f].min())
            self.early.updateValue((parts,), (_pack_events(frame[far == f]),))
            self.due.updateValue((parts,), (at,))
            self.handle.registerTimer(at)  # of equal timers there is one
            parts += 1
        self.parts.update((parts,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        opened = [part for part, (at,) in self.due.iterator() if at <= now]
        if not opened:
            return
        events = pd.concat([_unpack_events(self.early.getValue(part)[0]) for part in opened], ignore_index=True)
        for part in opened:
            self.early.removeKey(part)
            self.due.removeKey(part)
        ripe = self._until(events) <= now
        if not ripe.all():
            self._keep(events[~ripe], now)
        yield from self._work(events[ripe], ["session", "ts", "seq"])

    def _work(self, frame, order: list[str]):
        """Works off events session by session, in this order."""
        tokens, rest, session, engine, parts = [], [], None, None, 0
        for number, kind, batch, size, events in _runs(frame, order):
            if number != session:
                if engine:
                    rest.append(self._store(session, engine, parts))
                session, (engine, parts) = number, self._load(number)
            if kind == "decode":
                engine.decode(events)
            elif kind == "prefill":
                parts = self._prefill(session, engine, batch, size, events, parts)
            elif kind == "flush":
                engine.drain()
            elif kind == "reset":
                engine.epoch += len(events) - 1
                engine.reset()
                rest.append((session, "reset", engine.epoch, *[None] * 7))
            tokens += [(session, "token", engine.epoch, chunk, *token, None, None, None) for chunk, token in engine.drained]
            engine.drained = []
            if len(tokens) >= ROWS:
                yield _block(tokens)
                tokens = []
        if engine:
            rest.append(self._store(session, engine, parts))
        for rows in (tokens, rest):
            if rows:
                yield _block(rows)

    def _load(self, session: int) -> tuple[Engine, int]:
        found = self.sessions.getValue((session,))
        if not found:
            return Engine(self.capacity), 0
        *state, parts, seqs, keys, values = found
        return Engine(self.capacity, zip(seqs, *([None if v is None else bytes(v) for v in c] for c in (keys, values))), *state), parts

    def _store(self, session: int, engine: Engine, parts: int) -> tuple:
        ring = engine.ring
        self.sessions.updateValue((session,), (engine.total, engine.compressed, engine.chunks, engine.epoch, parts, *([t[i] for t in ring] for i in range(3))))
        return session, "count", engine.epoch, None, None, None, None, engine.total, engine.compressed, len(ring)

    def _prefill(self, session: int, engine: Engine, number: int, size: int, tokens: list, parts: int) -> int:
        """Hands a prefill batch to the engine when its last row has come; until then its parts wait."""
        there, named = self.open.getValue((session, number)) or (0, "")
        if there + len(tokens) < size:
            self.waiting.updateValue((session, parts), (_pack_tokens(tokens),))
            self.open.updateValue((session, number), (there + len(tokens), f"{named} {parts}"))
            return parts + 1
        for p in map(int, named.split()):
            tokens = _unpack_tokens(self.waiting.getValue((session, p))[0]) + tokens
            self.waiting.removeKey((session, p))
        if there:
            self.open.removeKey((session, number))
        engine.prefill(sorted(tokens, key=lambda t: t[0]))
        return parts

    def close(self) -> None:
        pass


def _gathered(frames):
    """Frames of up to HELD rows and one more batch: what is put in order at once."""
    import pandas as pd

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= HELD:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(frame, order: list[str]):
    """(session, kind, batch_id, batch_size, tokens) of each run of events of one session and kind, and within prefill of one batch."""
    import numpy as np

    columns = {c: frame[c].to_numpy().astype("int64") for c in ("session", "seq", "batch_id", "batch_size")}
    if "ts" in order:
        columns["ts"] = _milliseconds(frame["ts"]).to_numpy()
    at = np.lexsort([columns[c] for c in reversed(order)])
    session, seq, batch, size = (columns[c][at] for c in ("session", "seq", "batch_id", "batch_size"))
    kind = frame["kind"].to_numpy()[at]
    tokens = list(zip(seq.tolist(), *(_bytes_of(frame[c].to_numpy()[at]) for c in ("key", "value"))))
    starts = np.flatnonzero((session[1:] != session[:-1]) | (kind[1:] != kind[:-1]) | (batch[1:] != batch[:-1])) + 1
    starts = [0, *starts.tolist()] if len(at) else []
    for start, end in zip(starts, [*starts[1:], len(at)]):
        yield int(session[start]), kind[start], int(batch[start]), int(size[start]), tokens[start:end]


def _milliseconds(times):
    return times.astype("datetime64[ms]").astype("int64")


def _bytes_of(vectors) -> list:
    """Vectors as little-endian single-precision bytes, which they may already be."""
    import numpy as np

    return [v if v is None or isinstance(v, bytes) else np.asarray(v, "<f4").tobytes() for v in vectors]


def _pack_tokens(tokens: list) -> bytes:
    import pyarrow as pa

    kinds = (pa.int64(), pa.binary(), pa.binary())
    return to_bytes(pa.table({n: pa.array(c, t) for n, c, t in zip(("seq", "key", "value"), zip(*tokens), kinds)}))


def _unpack_tokens(data: bytes) -> list:
    return list(zip(*(c.to_pylist() for c in from_bytes(data).columns)))


def _pack_events(part) -> bytes:
    import pyarrow as pa

    numbers = {c: part[c].to_numpy().astype("int64") for c in NUMBERS}
    vectors = {c: pa.array(_bytes_of(part[c]), pa.binary()) for c in ("key", "value")}
    return to_bytes(pa.table({"ts": part["ts"].astype("datetime64[us]").to_numpy(), "kind": part["kind"].tolist(), **numbers, **vectors}))


def _unpack_events(data: bytes):
    return from_bytes(data).to_pandas()


def _as_bytes(column):
    """An Arrow list column of single-precision vectors as a binary one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.concat_arrays([column, column.slice(0, 0)])  # of its own, without an offset
    values = pc.fill_null(column.values, float("nan")).cast(pa.float32())
    ends = np.asarray(column.offsets).astype(np.int32) * np.int32(4)
    valid = None if not column.null_count else pa.array(np.packbits(np.asarray(column.is_valid()), bitorder="little")).buffers()[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(ends), pa.py_buffer(np.asarray(values, "<f4"))])


def _as_vectors(column):
    """The other way round."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ok = np.asarray(column.is_valid())
    x = np.frombuffer(b"".join(column.filter(pa.array(ok)).to_pylist()), "<f4")
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) // 4
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~ok, False)), pa.array(x, pa.float32()))


def _dealt(batches):
    """(bucket, events): the events of a task as blocks of one bucket, in order of arrival."""
    import numpy as np
    import pyarrow as pa

    def blocks(held):
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = np.asarray(table.column("bucket"))
        at = np.argsort(bucket, kind="stable")
        bucket, table = bucket[at], table.drop_columns(["bucket"]).take(pa.array(at)).combine_chunks()
        for i, name in enumerate(table.column_names):
            if name in ("key", "value") and table.num_rows:
                table = table.set_column(i, name, _as_bytes(table.column(i).chunk(0)))
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        data = [to_bytes(table.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(data, pa.binary())], names=["bucket", "events"])

    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD or size >= DEALT_BYTES:
            yield blocks(held)
            held, rows, size = [], 0, 0
    if rows:
        yield blocks(held)


def _block(rows: list):
    """A row (out, rows) of the operator: rows of OUTPUT with vectors as bytes, all of them tokens or none."""
    import pandas as pd
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [x.split() for x in OUTPUT.split(", ")]
    table = pa.table({n: pa.array(v, kinds.get(t, pa.binary())) for (n, t), v in zip(names, zip(*rows))})
    return pd.DataFrame({"out": ["token" if rows[0][1] == "token" else "rest"], "rows": [to_bytes(table)]})


def _rows(blocks: DataFrame) -> DataFrame:
    """The OUTPUT rows of blocks of the operator."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                table = from_bytes(data.as_buffer())
                for i, name in enumerate(table.column_names):
                    if name in ("key", "value"):
                        table = table.set_column(i, name, _as_vectors(table.column(i).chunk(0)))
                yield from table.to_batches()

    return blocks.select("rows").mapInArrow(run, OUTPUT)


def _captured(events: DataFrame, capacity: int, bucket_ms: int = 0) -> DataFrame:
    """(out, rows): what `capture_stream` gives, in blocks."""
    of_batch = [F.when(F.col("kind") == "prefill", F.col(c)).otherwise(0).alias(c) for c in ("batch_id", "batch_size")]
    bucket = F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).alias("bucket")
    if bucket_ms:  # a row for each event, as Spark drops late ones row by row
        as_bytes = F.arrow_udf(lambda column: _as_bytes(column), "binary")  # noqa: PLW0108
        dealt = events.select(bucket, "session", "seq", "kind", *of_batch, *[as_bytes(c).alias(c) for c in ("key", "value")], "ts")
    else:
        dealt = events.select(bucket, "session", "seq", "kind", *of_batch, "key", "value").mapInArrow(_dealt, "bucket long, events binary")
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=CaptureProcessor(capacity, bucket_ms), outputStructType="out string, rows binary", outputMode="Append", timeMode="EventTime" if bucket_ms else "None"
    )


def capture_stream(events: DataFrame, capacity: int, bucket_ms: int = 0) -> DataFrame:
    """Streaming DataFrame of OUTPUT rows from a stream of EVENTS. Needs the RocksDB state store provider.

    With bucket_ms, events also have a time `ts` with a watermark and are worked off by (ts, seq), whatever order they arrive in:
    they wait in the state until the watermark has passed their time, in steps of bucket_ms. What is later than the watermark
    is dropped, as Spark does with late rows.
    """
    return _rows(_captured(events, capacity, bucket_ms))


def recent(spark: SparkSession, checkpoint: str, spec: KvSpec) -> DataFrame:
    """(session, token_idx, kv_head, key, value): the tokens that are in the buffers now, read from the state of a stream's
    checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "sessions").load(checkpoint)
    held = F.explode(F.arrays_zip("user_map_value.seqs", "user_map_value.keys", "user_map_value.values")).alias("t")
    ring = rows.select(F.col("user_map_key.session").alias("session"), held)
    d = spec.head_dim

    vector = F.arrow_udf(lambda column: _as_vectors(column), "array<float>")  # noqa: PLW0108
    heads = ring.select("session", F.col("t.seqs").alias("token_idx"), vector(F.col("t.keys")).alias("key"), vector(F.col("t.values")).alias("value"))
    heads = heads.withColumn("kv_head", F.explode(F.sequence(F.lit(0), F.lit(spec.num_kv_heads - 1))))
    return heads.select("session", "token_idx", "kv_head", *[F.slice(c, F.col("kv_head") * d + 1, d).alias(c) for c in ("key", "value")])


def by_head(drained: DataFrame, spec: KvSpec) -> DataFrame:
    """(session, epoch, chunk_id, token_idx, kv_head, key, value) of "token" rows: a row for each head."""
    d = spec.head_dim
    heads = drained.where("out = 'token'").withColumn("kv_head", F.explode(F.sequence(F.lit(0), F.lit(spec.num_kv_heads - 1))))
    part = lambda c: F.slice(c, F.col("kv_head") * d + 1, d).alias(c)
    return heads.select("session", "epoch", "chunk_id", F.col("seq").alias("token_idx"), "kv_head", part("key"), part("value"))


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a stream leaves on disk, unless the session says otherwise: of its state the versions that going on needs, which are looked
#: through every so often, and no shuffle of a job that has ended.
KEPT = (
    ("spark.sql.streaming.minBatchesToRetain", "2"), ("spark.sql.streaming.stateStore.maintenanceInterval", "10s"),
    ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
)
#: With an order by time all events pass through the state; those that have left it go from its files at once.
COMPACT = ("spark.sql.streaming.stateStore.rocksdb.compactOnCommit", "true")


@contextmanager
def settings(spark: SparkSession, *pairs: tuple[str, str]):
    """With these settings in the session, and those of before after it."""
    before = [(name, spark.conf.get(name, None)) for name, _ in pairs]
    try:
        for name, value in pairs:
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before:
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(events: DataFrame, history: History, counts_to: str, checkpoint: str, bucket_ms: int = 0, arrivals=None) -> DataFrame:
    """Runs the engine over a stream of EVENTS until what is there now is worked off.

    Drained tokens are quantized and appended to history, a micro-batch at a time and again under the same number when a
    micro-batch is repeated; resets are noted there; each session's totals go to counts_to. Returns the last totals of each
    session (session, epoch, total, compressed, buffered).

    arrivals, an iterator, brings in more of the stream with each of its steps. A step is taken when all that came before is worked
    off and committed, so it may remove that, and what lies on disk is what came in one step.
    """
    spark, spec = events.sparkSession, history.spec

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        tokens, rest = (_rows(batch.where(F.col("out") == out)) for out in ("token", "rest"))
        history.append(by_head(tokens, spec), f"stream-{number}")
        history.append_resets(rest.where("out = 'reset'").select("session", "epoch"), f"stream-{number}")
        counts = rest.where("out = 'count'").select("session", F.lit(number).alias("micro_batch"), "epoch", "total", "compressed", "buffered")
        counts.write.mode("overwrite").parquet(f"{counts_to.rstrip('/')}/batch={number}")
        batch.unpersist()

    with settings(spark, STATE_STORE, *[(n, v) for n, v in (*KEPT, *[COMPACT] * bool(bucket_ms)) if spark.conf.get(n, None) is None]):
        stream = _captured(events, spec.ring_capacity, bucket_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        if arrivals is None:
            stream.trigger(availableNow=True).start().awaitTermination()
        else:
            query = stream.trigger(processingTime="500 milliseconds").start()
            try:
                for _ in arrivals:
                    query.processAllAvailable()
            finally:
                query.stop()
    last = F.max(F.struct("micro_batch", "epoch", "total", "compressed", "buffered")).alias("c")
    return spark.read.parquet(counts_to).groupBy("session").agg(last).select("session", "c.epoch", "c.total", "c.compressed", "c.buffered")
