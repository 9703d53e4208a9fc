"""Capture of a token stream into a compressed history and a buffer of recent tokens, as batch queries.

The buffer drains whole when it is full and another token comes, so where a token lies follows from its place and from
its session's token count alone. Token places come with the rows; counts are one aggregation with partial sums, so a
session that holds most of the tokens is no burden to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidDim
from ..specs import KvSpec
from . import codecs


def capture(tokens: DataFrame, capacity: int, prefill: DataFrame | None = None) -> DataFrame:
    """Adds n_tokens, chunk_id and is_recent to tokens (session, token_idx gapless from 0).

    prefill (session, prefill) says how many of a session's first tokens came at once into an empty engine: those beyond
    the capacity are compressed directly, as chunk 0. chunk_id is null for recent tokens.
    """
    counts = tokens.groupBy("session").agg(F.countDistinct("token_idx").alias("n_tokens"))
    if prefill is not None:
        counts = counts.join(prefill, "session", "left")
        lead = F.greatest(F.coalesce("prefill", F.lit(0)) - capacity, F.lit(0))
    else:
        lead = F.lit(0)
    counts = counts.select("session", "n_tokens", lead.cast("long").alias("_lead"))
    chunk = F.floor((F.col("token_idx") - F.col("_lead")) / capacity)
    last = F.floor((F.col("n_tokens") - F.col("_lead") - 1) / capacity)
    recent = (F.col("token_idx") >= F.col("_lead")) & (chunk == last)
    number = F.when(F.col("token_idx") < F.col("_lead"), 0).otherwise(chunk + (F.col("_lead") > 0).cast("int"))
    return (
        tokens.join(counts, "session").withColumn("is_recent", recent)
        .withColumn("chunk_id", F.when(~F.col("is_recent"), number.cast("long"))).drop("_lead")
    )


#: Events whose effect on the buffer is worked out together.
BLOCK_EVENTS = 4096


def capture_events(events: DataFrame, capacity: int, block: int = BLOCK_EVENTS) -> DataFrame:
    """(session, place, epoch, chunk_id, is_recent) of every token of any sequence of events, those before a reset included.

    events are rows (session, place, kind, batch_id, batch_size), place gapless from 0 in a session (`placed`); kind is
    decode, prefill, flush or reset, and the rows of a prefill batch follow each other. chunk_id is null for recent tokens.

    What an event does depends on how full the buffer is, and on nothing else that came before. So a block of events is a table:
    for each filling at its start, the filling at its end and the chunks in between. Blocks make their tables in parallel,
    the tables of a session are chained in order, and blocks then run once more from the filling that they really start
    with: a parallel prefix scan, in which a busy session is as many tasks as it has blocks. A token's chunk is known when it is
    written: the buffer's next drain is the next chunk.
    """
    if capacity < 1:
        raise InvalidDim("the capacity must be positive")
    prefills = events.where("kind = 'prefill'").groupBy("session", "batch_id").agg(F.min("place").alias("place"), F.count("*").alias("size"))
    steps = events.where("kind <> 'prefill'").select("session", "place", "kind", F.lit(1).cast("long").alias("size"))
    steps = steps.unionByName(prefills.select("session", "place", F.lit("prefill").alias("kind"), "size"))
    steps = steps.withColumn("block", F.floor(F.col("place") / block))
    session = events.schema["session"].dataType.simpleString()

    def table(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by("place")
        fill, chunks = np.arange(capacity + 1), np.zeros(capacity + 1, np.int64)
        resets = 0
        for kind, size in zip(group["kind"].to_pylist(), group["size"].to_pylist()):
            fill, chunks, resets = _transition(kind, size, fill, chunks, resets, capacity)[:3]
        facts = {"fills": pa.array([fill.tolist()], pa.list_(pa.int64())), "chunks": pa.array([chunks.tolist()], pa.list_(pa.int64())), "resets": pa.array([resets], pa.int64())}
        return pa.table({"session": group["session"][:1], "block": group["block"][:1], **facts})

    def chain(batches):
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["session"] != now:
                    now, state = r["session"], (0, 0, 0)
                out.append((now, r["block"], *state))
                fill, chunks, epoch = state
                state = r["fills"][fill], r["chunks"][fill] + (0 if r["resets"] else chunks), epoch + r["resets"]
            if out:
                columns = [pa.array(c, batch.schema.field(0).type if i == 0 else pa.int64()) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, names=["session", "block", "fill", "done", "epoch"])

    def run(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by("place")
        fill, chunks = (np.array([group[c][0].as_py()]) for c in ("fill", "done"))
        epoch, out = group["epoch"][0].as_py(), []
        for kind, size in zip(group["kind"].to_pylist(), group["size"].to_pylist()):
            was = epoch
            fill, chunks, resets, lead, ring = _transition(kind, size, fill, chunks, 0, capacity)
            epoch += resets
            out.append((was, lead, ring - (lead > 0), ring, int(chunks[0]), epoch))
        names = ("epoch", "lead", "lead_chunk", "chunk", "now", "now_epoch")
        return pa.table({**{c: group[c] for c in ("session", "place", "kind", "size")}, **{n: pa.array([int(v) for v in c], pa.int64()) for n, c in zip(names, zip(*out))}})

    tables = steps.groupBy("session", "block").applyInArrow(table, f"session {session}, block long, fills array<long>, chunks array<long>, resets long")
    starts = tables.repartition("session").sortWithinPartitions("session", "block").mapInArrow(chain, f"session {session}, block long, fill long, done long, epoch long")
    ready = steps.join(starts, ["session", "block"])
    worked = ready.groupBy("session", "block").applyInArrow(
        run, f"session {session}, place long, kind string, size long, epoch long, lead long, lead_chunk long, chunk long, now long, now_epoch long"
    )
    ends = worked.groupBy("session").agg(F.max(F.struct("place", "now", "now_epoch")).alias("end")).select("session", "end.now", "end.now_epoch")
    worked = worked.drop("now", "now_epoch")
    decoded = worked.where("kind = 'decode'").select("session", "place", "epoch", "chunk")
    starts_of = worked.where("kind = 'prefill'").select("session", F.col("place").alias("first"), "epoch", "lead", "lead_chunk", "chunk")
    filled = events.where("kind = 'prefill'").select("session", "place", "batch_id").join(prefills.select("session", "batch_id", F.col("place").alias("first")), ["session", "batch_id"])
    filled = filled.join(starts_of, ["session", "first"]).select(
        "session", "place", "epoch", F.when(F.col("place") - F.col("first") < F.col("lead"), F.col("lead_chunk")).otherwise(F.col("chunk")).alias("chunk")
    )
    tokens = decoded.unionByName(filled).join(ends, "session")
    recent = (F.col("chunk") == F.col("now")) & (F.col("epoch") == F.col("now_epoch"))
    return tokens.select("session", "place", "epoch", F.when(~recent, F.col("chunk")).alias("chunk_id"), recent.alias("is_recent"))


def _transition(kind: str, size: int, fill, chunks, resets: int, capacity: int):
    """(filling, chunks, resets, lead, chunk) after an event, for every filling at once; lead tokens go past the buffer into the
    chunk before `chunk` (of the first filling), into which the others go when the buffer drains."""
    lead = 0
    if kind == "decode":
        full = fill == capacity
        fill, chunks = fill * ~full + 1, chunks + full
    elif kind == "prefill":
        lead = max(0, size - capacity)
        drains = (fill + size > capacity) & (fill > 0)
        fill, chunks = fill * ~drains + size - lead, chunks + drains + (lead > 0)
    elif kind == "flush":
        fill, chunks = fill * 0, chunks + (fill > 0)
    elif kind == "reset":
        fill, chunks, resets = fill * 0, chunks * 0, resets + 1
    return fill, chunks, resets, lead, int(chunks[0])


def counters(captured: DataFrame) -> DataFrame:
    """(session, total, compressed, buffered)."""
    return captured.groupBy("session").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_recent")).alias("compressed"), F.count_if("is_recent").alias("buffered")
    )


def chunks(captured: DataFrame) -> DataFrame:
    """(session, chunk_id, n_tokens) of the compressed history."""
    return captured.where(~F.col("is_recent")).groupBy("session", "chunk_id").agg(F.count("*").alias("n_chunk_tokens"))


def flush(captured: DataFrame) -> DataFrame:
    """Everything into the history: the recent tokens become the session's last chunk."""
    last = captured.groupBy("session").agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0)).alias("_next"))
    return (
        captured.join(last, "session").withColumn("chunk_id", F.coalesce("chunk_id", "_next")).withColumn("is_recent", F.lit(False)).drop("_next")
    )


def compress(tokens: DataFrame, spec: KvSpec) -> DataFrame:
    """key_code and value_code of every row; the vectors themselves go."""
    coded = codecs.encode(codecs.encode(tokens, "key", spec.key, to="key_code"), "value", spec.value, to="value_code")
    return coded.drop("key", "value")


def flat_view(store: DataFrame) -> DataFrame:
    """Hex codes of the history per head, in token order within a head."""
    return store.select(
        *[c for c in store.columns if c not in ("key_code", "value_code")],
        F.hex("key_code.mse_indices").alias("key_codes"), F.hex("key_code.qjl_signs").alias("key_signs"), F.hex("value_code.data").alias("value_codes"),
    )


def memory_bytes(store_rows: DataFrame, spec: KvSpec) -> DataFrame:
    """(session, n_rows, bytes) of the compressed history."""
    per_row = spec.key.bytes_per_vector + spec.value.bytes_per_vector
    return store_rows.groupBy("session").agg(F.count("*").alias("n_rows"), (F.count("*") * per_row).alias("bytes"))


def decompress(store: DataFrame, spec: KvSpec) -> DataFrame:
    """key and value vectors of the history's codes."""
    both = codecs.decode(codecs.decode(store, spec.key, code="key_code", to="key"), spec.value, code="value_code", to="value")
    return both.drop("key_code", "value_code")


def placed(rows: DataFrame, by: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds token_idx: the place of each row among those of its `by`, from 0 in the given order.

    bucket has to grow with the order. Rows are ranked within (by, bucket) and the counts of earlier buckets are added, so
    a session is spread over as many tasks as it has buckets.
    """
    bucketed = rows.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    ranked = bucketed.withColumn("_at", inside).join(before, [by, "_bucket"])
    return ranked.withColumn("token_idx", (F.col("_at") + F.col("_before")).cast("long")).drop("_bucket", "_at", "_before")
