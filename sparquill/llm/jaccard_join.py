"""Exact self-join of documents by the Jaccard similarity of their word n-grams.

Every document becomes a set of 64-bit shingle hashes, ordered rarest first by a corpus-wide frequency table of
SKETCH bins (any fixed order keeps the join exact; rarity keeps it cheap). Two sets of similarity t share a shingle
within their prefixes, so candidates meet on prefix shingles, pass the length and positional filters, are made distinct
and are verified once: a suffix filter over hash ranges of the two sets first, then the exact intersection.

Equal sets are one class and are never compared. In a group of near copies the pairs would grow with the square of its
size, and the classes' links only matter up to reachability. So the join runs twice: first each class meets only the
leader of each prefix shingle, the class in which that shingle stands earliest (an original stands before its edited
copies); then only classes that are not yet connected meet each other, whatever their number. No link between parts
that are not connected anyway is lost, and no bucket, partner or candidate is capped.

Defined cases: a null or empty text has no shingles and is linked with nothing; fewer words than n make one shingle;
repeated rows keep a row each; rows that share a doc_id are compared by their own
texts; a null doc_id never names a component, its component_id is null; an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, discard, small, stash, table, tidy
from ._tokens import slices, worker_store

N_GRAM = 4
THRESHOLD = 85  # per cent
SKETCH = 1 << 19


class _Hashes(dict):
    """word -> 64-bit hash; starts afresh after 200,000 words."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _shingler(n: int):
    """text bytes -> sorted distinct shingle hashes (uint64)."""
    import numpy as np

    store = worker_store()
    if not hasattr(store, "shingle_words"):
        store.shingle_words = _Hashes()
    hashes = store.shingle_words
    # fixed odd multipliers, one per place in the shingle
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i * i) % (1 << 64) | 1) for i in range(n)]

    def shingles(text: bytes | None):
        words = text.lower().split() if text else []
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        m = max(min(len(words), 1), len(words) - n + 1)
        s = np.zeros(m, np.uint64)
        for i in range(min(n, len(words))):
            s += h[i : i + m] * odd[i] if len(words) >= n else h[i : i + 1] * odd[i]
        if 0 < len(words) < n:
            s += np.uint64(len(words))
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))] if m else s

    return shingles


def frequencies(docs: DataFrame, n: int = N_GRAM, sketch: int = SKETCH):
    """Number of documents' shingles in each of `sketch` hash bins: a table of fixed size, from all documents."""
    import numpy as np

    def gather(batches):
        import pyarrow as pa

        shingles = _shingler(n)
        total = np.zeros(sketch, np.int64)
        for (texts,) in (part for batch in batches for part in slices(batch)):
            held, size = [], 0
            for text in texts:
                held.append(shingles(text))
                size += len(held[-1])
                if size > 1 << 18:
                    total += np.bincount((np.concatenate(held) % np.uint64(sketch)).astype(np.int64), minlength=sketch)
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) % np.uint64(sketch)).astype(np.int64), minlength=sketch)
        at = np.nonzero(total)[0]
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bin", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(gather, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(sketch, np.int64)
    got = found.toArrow()  # `sketch` rows at most; Arrow columns, as a Python object for each row would fill the driver
    out[got["bin"].to_numpy()] = got["n"].to_numpy()
    return out


def prefixes(docs: DataFrame, n: int = N_GRAM, threshold: int = THRESHOLD, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, set_id (equal sets share it; null for empty sets) and the prefix, rarest shingle first."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(frequencies(docs, n, sketch), (1 << 32) - 1).astype(np.uint32))

    def cut(batches):
        import pyarrow as pa
        import xxhash

        shingles, often = _shingler(n), shared.value
        for ids, texts in (part for batch in batches for part in slices(batch)):
            sizes, sets, parts, ends = [], [], [], [0]
            for text in texts:
                s = shingles(text)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    order = np.argsort(often[(s % np.uint64(sketch)).astype(np.int64)], kind="stable")
                    s = s[order[: len(s) - (threshold * len(s) + 99) // 100 + 1]]
                parts.append(s.view(np.int64))
                ends.append(ends[-1] + len(s))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "doc_id long, n_shingles long, set_id binary, prefix array<long>"
    )


def _shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, shingles) of the classes in `wanted` (rep, set_id, doc_id), from their texts."""

    def sets(batches):
        import pyarrow as pa
        import xxhash

        shingles = _shingler(n)
        for (texts,) in (part for batch in batches for part in slices(batch)):
            found = [shingles(text).tobytes() for text in texts]
            columns = [pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "shingles"])

    ids = small(wanted.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi")
    found = texts.select("text").mapInArrow(sets, "set_id binary, shingles binary").dropDuplicates(["set_id"])
    return found.join(wanted.select("set_id", "rep"), "set_id").select("rep", "shingles")


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes that stand in pairs, as rep."""
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for a, b, xs, ys in (part for batch in batches for part in slices(batch)):
            keep = []
            for x, y in zip(xs, ys):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-threshold * (len(x) + len(y)) // (100 + threshold))  # least intersection of a similar pair
                # suffix filter: within a range of hashes the sets share at most the smaller count
                cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
                bx, by = np.diff(np.searchsorted(x, cuts), prepend=0, append=len(x)), np.diff(np.searchsorted(y, cuts), prepend=0, append=len(y))
                if np.minimum(bx, by).sum() < need:
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= threshold * (len(both) - same))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, threshold: int) -> Column:
    """Length filter, and positional filter: what can still be shared from this shingle on reaches the least intersection."""
    need = F.ceil(threshold * (n1 + n2) / (100 + threshold) - 1e-9)
    return (100 * n1 >= threshold * n2) & (100 * n2 >= threshold * n1) & (F.least(n1 - p1, n2 - p2) >= need)


@tidy
def join(docs: DataFrame, n: int = N_GRAM, threshold: int = THRESHOLD, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with an equal set) of every row of docs."""
    found = stash(prefixes(docs, n, threshold, sketch))
    known = found.where("set_id is not null and doc_id is not null")
    classes = stash(
        known.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("r")).select("set_id", "r.*").withColumn("rep", F.monotonically_increasing_id())
    )
    tokens = classes.select("rep", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    met = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    # tables that grow with the corpus are joined by a shuffle at every size
    shared = stash(tokens.join(met.hint("merge"), "token"))  # shingles that stand in two prefixes at least

    leader = shared.groupBy("token").agg(F.min(F.struct("pos", "rep", "n")).alias("l"))
    led = shared.join(leader.hint("merge"), "token").where((F.col("rep") != F.col("l.rep")) & _may_link(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), threshold))
    first = stash(led.select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct())
    keys = classes.select("rep", "set_id", "doc_id")
    sets = stash(_shingle_sets(docs, stash(keys.join(_ends(first), "rep")), n))
    links = stash(_verified(first, sets, threshold))
    parts = components(links)

    placed = stash(
        shared.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("part"))
    )
    discard(shared)
    # a pair with a token's leader has met there already; at the first token they share, no filter hides it
    lead = F.min(F.struct("pos", "rep", "n"))["rep"].alias("lead")
    apart = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), lead).where("lo != hi").select("token", "lead")
    open_ = stash(placed.join(apart.hint("merge"), "token").where("rep != lead").drop("lead"))
    discard(placed)
    x, y = open_.alias("x"), open_.alias("y")
    second = stash(
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where((F.col("x.rep") < F.col("y.rep")) & (F.col("x.part") != F.col("y.part")) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), threshold))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    new = _ends(second).join(sets.select("rep"), "rep", "left_anti")
    more_sets = stash(_shingle_sets(docs, stash(keys.join(new, "rep")), n))
    more = stash(_verified(second, sets.union(more_sets), threshold))
    whole = parts if more.isEmpty() else components(links.union(more))

    named = classes.select("rep", "set_id", F.col("doc_id").alias("class_id")).join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return (
        found.select("doc_id", "n_shingles", "set_id")
        .join(named.join(least, "component").select("set_id", "class_id", "component_id"), "set_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "class_id")
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that are the only one or, by doc_id, the first of their group of near copies."""
    ids = join(docs, n, threshold).where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    # as above; the texts are shuffled once, as they are anyway where the ids are too many to be sent to the tasks
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = f"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents
), s as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {N_GRAM} then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - {N_GRAM - 2}), lambda i: array_to_string(w[i:i + {N_GRAM - 1}], ' ')) end)) as s
  from d
), c as (
  select s, min(doc_id) as rep, any_value(len(s)) as n from s where len(s) > 0 group by s
), p as (
  select rep, n, unnest(s) as g from c
), e as (
  select a.rep as a, b.rep as b from p a join p b on a.g = b.g and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*))
), r as (
  select rep as node, rep as reach from c
  union
  select r.node, x.b as reach from r join (select a, b from e union all select b, a from e) x on r.reach = x.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.least, s.doc_id) as component_id, c.rep as class_id
from s left join c on s.s = c.s left join (select node, min(reach) as least from r group by node) m on m.node = c.rep
"""
