"""A stored, append-only history of compressed tokens: a folder of Parquet batches, and a view of them in token order.

Every append writes one new folder, which counts only when its job has been committed, so that a failed append leaves
nothing behind and an append that is repeated under its name replaces itself. Rows are (session, epoch, chunk_id,
token_idx, kv_head, key_code, value_code).

A reset appends a mark (session, epoch): rows of that session's earlier epochs are gone for every reader. Marks are few beside
tokens and are anti-joined on read; nothing is rewritten.

The view keeps the rows in order of (session, kv_head, token_idx) as sorted runs. `refresh` sorts only the batches that no run
has yet, into a new run; FANOUT runs of a level are merged into one of the next, so a row is rewritten once a level and the
number of runs grows with the logarithm of the number of batches. A run names the batches that it holds in a file beside its rows and appears
by being renamed, so a reader sees a batch in one run, before and after a merge and if one was broken off.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..specs import KvSpec
from . import kv

SCHEMA = (
    f"session long, epoch long, chunk_id long, token_idx long, kv_head int, key_code {udfs.PROD_TYPE}, value_code {udfs.VALUE_TYPE}"
)
MARKS = "session long, epoch long"
ORDER = ("session", "kv_head", "token_idx")
#: Runs of a level that are merged into one of the next.
FANOUT = 4


class History:
    def __init__(self, spark: SparkSession, path: str, spec: KvSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def _at(self, name: str = ""):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _names(self, folder: str, prefix: str, marker: str = "_SUCCESS") -> list[str]:
        """Names of the committed folders below one."""
        fs, top = self._at(folder)
        if not fs.exists(top):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        statuses = [s for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
        return sorted(s.getPath().getName() for s in statuses if fs.exists(path(s.getPath(), marker)))

    def _load(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def append(self, tokens: DataFrame, batch: str | None = None) -> None:
        """Quantizes tokens (session, epoch, chunk_id, token_idx, kv_head, key, value) and adds them as one batch."""
        coded = kv.compress(tokens, self.spec).select("session", "epoch", "chunk_id", "token_idx", F.col("kv_head").cast("int").alias("kv_head"), "key_code", "value_code")
        coded.write.mode("overwrite").parquet(f"{self.path}/batch={batch or uuid.uuid4().hex}")

    def append_resets(self, marks: DataFrame, batch: str | None = None) -> None:
        """Notes resets (session, epoch): that session begins anew with that epoch."""
        marks.select(F.col("session").cast("long"), F.col("epoch").cast("long")).write.mode("overwrite").parquet(f"{self.path}/resets/batch={batch or uuid.uuid4().hex}")

    def resets(self) -> DataFrame:
        """(session, since): the epoch that each reset session is in."""
        marks = self._load([f"resets/{n}" for n in self._names("resets", "batch=")], MARKS)
        return marks.groupBy("session").agg(F.max("epoch").alias("since"))

    def read(self) -> DataFrame:
        """All committed rows, in no order, those before a reset too."""
        return self._load(self._names("", "batch="), SCHEMA)

    def _since_reset(self, rows: DataFrame) -> DataFrame:
        marks = self.resets().alias("m")
        return rows.alias("r").join(marks, F.expr("r.session = m.session and r.epoch < m.since"), "left_anti")

    def latest(self) -> DataFrame:
        """The rows of each session since its last reset."""
        return self._since_reset(self.read())

    def _runs(self) -> dict[str, set[str]]:
        """The runs to read and the batches in each. A run whose batches are all in another one has been merged."""
        fs, _ = self._at()
        found = {}
        for name in self._names("view", "level=", "_batches"):
            stream = fs.open(self._at(f"view/{name}/_batches")[1])
            try:
                found[name] = set(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
            finally:
                stream.close()
        return {n: b for n, b in found.items() if not any(b < other or (b == other and n > m) for m, other in found.items() if m != n)}

    def _write_run(self, rows: DataFrame, batches: set[str], level: int) -> None:
        name = uuid.uuid4().hex
        rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.parquet(f"{self.path}/view/new={name}")
        fs, held = self._at(f"view/new={name}")
        out = fs.create(self._at(f"view/new={name}/_batches")[1])
        try:
            out.write(bytearray("\n".join(sorted(batches)).encode()))
        finally:
            out.close()
        fs.rename(held, self._at(f"view/level={level}-{name}")[1])

    def refresh(self) -> dict[str, int]:
        """Brings the view up to date. Returns how many batches were sorted and how many runs merged."""
        runs = self._runs()
        new = set(self._names("", "batch=")) - set().union(*runs.values())
        merged = 0
        if new:
            self._write_run(self._load(sorted(new), SCHEMA), new, 0)
        level = 0
        while True:
            runs = self._runs()
            mine = sorted(n for n in runs if n.startswith(f"level={level}-"))
            if len(mine) < FANOUT:
                if not any(int(n.split("-")[0][6:]) > level for n in runs):
                    break
                level += 1
                continue
            self._write_run(self._load([f"view/{n}" for n in mine], SCHEMA), set().union(*(runs[n] for n in mine)), level + 1)
            for n in mine:
                fs, old = self._at(f"view/{n}")
                fs.delete(old, True)
            merged += len(mine)
            level += 1
        return {"sorted": len(new), "merged": merged}

    def view(self, sessions: list[int] | None = None) -> DataFrame:
        """The rows since the last resets as the view has them after `refresh`; of some sessions alone, the sorted files are
        skipped by their ranges."""
        rows = self._load([f"view/{n}" for n in self._runs()], SCHEMA)
        return self._since_reset(rows if sessions is None else rows.where(F.col("session").isin(sessions)))

    def flat(self) -> DataFrame:
        """The rows in token order within each session and head."""
        return self.latest().orderBy(*ORDER)

    def counters(self) -> DataFrame:
        """(session, num_tokens, num_chunks, bytes) of every session that has rows or was reset."""
        key, value = self.spec.key, self.spec.value
        rows = self.latest().groupBy("session", "chunk_id").agg(F.countDistinct("token_idx").alias("tokens"), F.count("*").alias("n"))
        sums = [F.sum(F.coalesce(c, F.lit(0))) for c in ("tokens", "n")]
        rows = rows.unionByName(self.resets().select("session"), allowMissingColumns=True)
        return rows.groupBy("session").agg(
            sums[0].alias("num_tokens"), F.count("chunk_id").alias("num_chunks"), (sums[1] * (key.bytes_per_vector + value.bytes_per_vector)).alias("bytes")
        )

    def reset(self) -> None:
        """Removes the history's own folder."""
        fs, folder = self._at()
        fs.delete(folder, True)
