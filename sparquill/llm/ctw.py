"""Context-tree weighting over the bytes of texts, and the add-one unigram baseline beside it.

A byte is eight binary decisions. Each decision has a tree of contexts: the 0 to DEPTH bytes before it. A node holds a
Krichevsky-Trofimov estimate, and weighting mixes the estimates of all depths by how well each explains the training
texts. A code is a predicted byte with its context, unfolded; a text's end is the byte 0.

Training codes are gathered from every training text by one aggregation and stay distributed, as their number grows
with the corpus. Subtrees deeper than SHALLOW bytes are weighted where their codes are, dealt by the SHALLOW + 1 nearest
bytes; their sums meet in the shallow part, of 2**24 codes at most, which travels to every task. The values of the
FREQUENT_CODES most common codes travel to the tasks as well, the other codes of the scored texts meet theirs in a join.
Word counts of the baseline are handled alike.

Defined cases: a null or empty text is the end alone; a null doc_id hashes as the empty string; repeated rows and equal
doc_ids keep a row each; without training rows every estimate is that of an empty tree; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash, table, tidy
from ._tokens import slices, worker_store

DEPTH = 5
SHALLOW = 2
CONTEXT_BITS = tuple(8 * d for d in range(DEPTH + 1))  # bits of context at each depth
#: Codes that are weighted at once, or more where they share a subtree.
BLOCK = 1 << 18
#: At most so many codes have their values sent to every task.
FREQUENT_CODES = 1 << 20
#: Weighted logarithms are summed in these steps, so that the sums are exact in any order.
STEPS = 1 << 20
#: At most so many words have their counts sent to every task.
FREQUENT = 1 << 17
CHUNK = 1 << 18  # bytes of text handled at once
HELD_WORDS = 300_000  # words that a worker keeps


def _classes():
    """byte -> its place in a code: itself."""
    import numpy as np

    return np.arange(256, dtype=np.uint64)


def _chunks(batches, *more: int):
    """(rows of the columns `more`, texts) of about CHUNK bytes."""
    rows, texts, held = [], [], 0
    for columns in (part for batch in batches for part in slices(batch)):
        for row in zip(*(columns[i] for i in (0, *more))):
            texts.append(row[0] or b"")
            rows.append(row[1:])
            held += len(texts[-1])
            if held >= CHUNK:
                yield rows, texts
                rows, texts, held = [], [], 0
    if texts:
        yield rows, texts


def _codes(texts: list[bytes], classes):
    """(code of each predicted byte with its context, first code of each text)."""
    import numpy as np

    pad = bytes(DEPTH)
    raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    c = classes[raw]
    code = c[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        code |= c[DEPTH - d : len(c) - d] << np.uint64(CONTEXT_BITS[d])
    keep = np.ones(len(code), bool)
    ends = np.cumsum(lengths + DEPTH) - DEPTH
    for i in range(1, DEPTH):  # of a text's zeros all but the first are only context
        keep[(ends + i)[ends + i < len(code)]] = False
    return code[keep], np.cumsum(lengths + 1) - (lengths + 1)


def _word_key(word: bytes) -> int:
    import xxhash

    key = xxhash.xxh3_64_intdigest(word)
    return key - (1 << 64) if key >> 63 else key


def counts(training: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts words by hash, 1 the byte codes, 2 the texts."""

    def gather(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        def rows(kind, keys, n):
            columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

        classes, words, codes, texts_seen = _classes(), Counter(), [], 0
        for _, texts in _chunks(batches):
            texts_seen += len(texts)
            for text in texts:
                words.update(text.lower().split())
            codes.append(np.unique(_codes(texts, classes)[0], return_counts=True))
            if len(codes) == 8:
                codes = [_merged(codes)]
            if len(words) > HELD_WORDS:
                yield rows(0, [_word_key(w) for w in words], list(words.values()))
                words.clear()
        if texts_seen:
            yield rows(0, [_word_key(w) for w in words], list(words.values()))
            key, n = _merged(codes)
            yield rows(1, key.astype(np.int64), n)
            yield rows(2, [0], [texts_seen])

    found = training.select(F.col("text").cast("binary").alias("text")).mapInArrow(gather, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _merged(parts):
    import numpy as np

    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _lgamma(x):
    """Logarithm of the gamma function for an array of positive numbers."""
    import numpy as np

    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _mask(bits: int):
    import numpy as np

    return np.uint64((1 << bits) - 1)


class ContextTree:
    """Weighted tree from code counts. nodes[d][j]: keys, P(bit 1) and own weight of the nodes at depth d, bit j.

    A part of the tree has the depths from `first` to `last`; split[j] then holds the keys at depth `last` and the sums
    of the weighted logarithms below them. whole[j]: keys and weighted logarithms at depth `first`.
    """

    def __init__(self, codes, n, first=0, last=DEPTH, split=None):
        import numpy as np

        codes = codes.astype(np.uint64)
        self.nodes = {d: [None] * 8 for d in range(last, first - 1, -1)}
        self.whole = []
        for j in range(8):
            below = split and split[j]
            for d in self.nodes:
                gram = codes & _mask(8 + CONTEXT_BITS[d])
                keys, at = np.unique(gram >> np.uint64(8 - j), return_inverse=True)
                one = np.bincount(at, n * ((gram >> np.uint64(7 - j)) & np.uint64(1)), len(keys))
                zero = np.bincount(at, n, len(keys)) - one
                kt = _lgamma(one + 0.5) + _lgamma(zero + 0.5) - _lgamma(one + zero + 1) - np.log(np.pi)
                if d == DEPTH:
                    whole, own = kt, np.ones(len(keys))
                else:
                    parent = np.searchsorted(keys, below[0] & _mask(CONTEXT_BITS[d] + j))
                    whole = np.logaddexp(kt, np.bincount(parent, below[1], len(keys))) - np.log(2)
                    own = np.exp(kt - np.log(2) - whole)
                self.nodes[d][j] = (keys, (one + 0.5) / (one + zero + 1), own)
                below = (keys, whole)
            self.whole.append(below)

    @classmethod
    def of(cls, nodes: dict) -> ContextTree:
        tree = cls.__new__(cls)
        tree.nodes = nodes
        return tree

    def mix(self, codes, j, p):
        """P(bit j is 1) of each code at the least depth, from that below the greatest."""
        import numpy as np

        for d, nodes in self.nodes.items():
            key = (codes & _mask(8 + CONTEXT_BITS[d])) >> np.uint64(8 - j)
            keys, one, own = nodes[j]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            # a context that was never met says one half at every depth below it
            p = np.where(keys[at] == key, own[at] * one[at] + (1 - own[at]) * p, 0.5)
        return p

    def log10(self, codes, deeper=None):
        """log10 P(byte | context) of each code; deeper: the part of the tree below this one."""
        import numpy as np

        codes = codes.astype(np.uint64)
        total = np.zeros(len(codes))
        for j in range(8):
            p = np.full(len(codes), 0.5)
            p = self.mix(codes, j, deeper.mix(codes, j, p) if deeper else p)
            bit = (codes >> np.uint64(7 - j)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def _subtrees(batches):
    """(keys, n, wanted) of whole subtrees, from batches in the order of their contexts."""
    import numpy as np

    held, size, limit = [], 0, BLOCK
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
        size += batch.num_rows
        if size >= limit:
            columns = [np.concatenate(x) for x in zip(*held)]
            context = columns[0] >> 8 & ((1 << CONTEXT_BITS[SHALLOW + 1]) - 1)
            other = np.nonzero(context != context[-1])[0]
            at = other[-1] + 1 if len(other) else 0
            if at:
                yield [x[:at] for x in columns]
            held = [[x[at:] for x in columns]]
            size -= at
            limit = max(BLOCK, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _deep(codes: DataFrame, schema: str, work) -> DataFrame:
    """work(tree of the depths below SHALLOW, wanted keys) -> columns, for the subtrees of codes (key, n, wanted)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for keys, n, wanted in _subtrees(batches):
            tree = ContextTree(keys[n > 0], n[n > 0], SHALLOW + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in work(tree, keys[wanted])], names=names)

    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << CONTEXT_BITS[SHALLOW + 1]) - 1))
    dealt = codes.select("key", "n", "wanted", context.alias("context")).repartition("context").sortWithinPartitions("context")
    return dealt.mapInArrow(run, schema)


def shallow_tree(codes: DataFrame) -> ContextTree:
    """The depths up to SHALLOW of the tree of codes (key, n), which hold what is weighted below them."""
    import numpy as np

    def sums(tree, _):
        out = []
        for j, (keys, whole) in enumerate(tree.whole):
            parents, at = np.unique(keys & _mask(CONTEXT_BITS[SHALLOW] + j), return_inverse=True)
            out.append((np.full(len(parents), j, np.int32), parents.astype(np.int64), np.rint(np.bincount(at, whole, len(parents)) * STEPS).astype(np.int64)))
        return [np.concatenate(x) for x in zip(*out)]

    below = _deep(codes.withColumn("wanted", F.lit(False)), "j int, key long, whole long", sums)
    # 2**24 rows at most
    below = _by_key(below.groupBy("j", "key").agg(F.sum("whole").alias("whole")))
    split = [(below["key"][at].astype(np.uint64), below["whole"][at] / STEPS) for at in (below["j"] == j for j in range(8))]
    gram = F.col("key").bitwiseAND(F.lit((1 << (8 + CONTEXT_BITS[SHALLOW])) - 1))
    top = _by_key(codes.groupBy(gram.alias("key")).agg(F.sum("n").alias("n")))
    return ContextTree(top["key"], top["n"], 0, SHALLOW, split)


def code_values(codes: DataFrame, top) -> DataFrame:
    """(key, value): log10 P of the wanted ones of codes (key, n, wanted); top: broadcast of the shallow tree's nodes."""
    return _deep(codes, "key long, value double", lambda tree, keys: (keys, ContextTree.of(top.value).log10(keys, tree)))


class _Known:
    """Values of the frequent codes: most are found in their slot, the rest by search."""

    def __init__(self, keys, values):
        import numpy as np

        self.keys, self.values = keys, values
        self.slot_keys, self.slot_values = np.full(1 << 21, (1 << 64) - 1, np.uint64), np.full(1 << 21, np.nan)
        at = self._slots(keys)
        self.slot_keys[at], self.slot_values[at] = keys, values
        mine = self.slot_keys[at] == keys
        self.slot_values[at[mine]] = values[mine]

    @staticmethod
    def _slots(keys):
        import numpy as np

        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)

    def of(self, codes):
        """The value of each code, nan of others."""
        import numpy as np

        at = self._slots(codes)
        out = np.where(self.slot_keys[at] == codes, self.slot_values[at], np.nan)
        missing = np.nonzero(np.isnan(out))[0]
        if len(missing) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, codes[missing]), len(self.keys) - 1)
            out[missing] = np.where(self.keys[at] == codes[missing], self.values[at], np.nan)
        return out


def _by_key(df: DataFrame) -> dict:
    """Columns of a small table in the order of its keys; Arrow columns, as rows would fill the driver's memory."""
    columns = df.toArrow().sort_by("key")
    return {c: columns[c].to_numpy() for c in columns.column_names}


def _least(found: DataFrame, step, limit: int) -> int:
    """The lowest step of counts that `limit` rows or fewer reach."""
    by_step = {r["s"]: r["c"] for r in found.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()}
    least, held = max(by_step, default=0) + 1, 0
    for s in sorted(by_step, reverse=True):
        held += by_step[s]
        if held > limit:
            break
        least = s
    return least


class _Values(dict):
    """word -> log10(count + 1) of a frequent word, nan of others."""

    def __init__(self, keys, values):
        super().__init__()
        self.keys_, self.values_ = keys, values

    def __missing__(self, word):
        import numpy as np

        if len(self) > HELD_WORDS:
            self.clear()
        key = _word_key(word)
        at = int(np.searchsorted(self.keys_, key))
        value = float(self.values_[at]) if at < len(self.keys_) and self.keys_[at] == key else float("nan")
        self[word] = value
        return value


@tidy
def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (with the end) and bits_per_byte (the
    code length) of every row of docs."""
    import numpy as np

    spark = docs.sparkSession
    found = stash(counts(training))
    is_word = F.col("kind") == 0
    size = found.agg(
        F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)).alias("words"),
        F.count(F.when(is_word, 1)).alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("texts"),
    ).first()
    n_train, v = size["words"] + size["texts"], size["distinct"] + (size["texts"] > 0)
    step = F.floor(F.log2("n") * 8)  # eighths of a doubling
    least = _least(found.where(is_word), step, FREQUENT)
    frequent = _by_key(found.where(is_word & (step >= least)).select("key", "n"))
    trained = found.where("kind = 1").select("key", "n")
    top = spark.sparkContext.broadcast(shallow_tree(trained).nodes)
    common = _by_key(code_values(trained.withColumn("wanted", step >= _least(trained, step, FREQUENT_CODES)), top))
    shared = spark.sparkContext.broadcast(
        (common["key"].astype(np.uint64), common["value"], frequent["key"], np.log10(frequent["n"] + 1.0))
    )
    end_known, end_value = size["texts"] > 0, float(np.log10(size["texts"] + 1))
    schema = "row long, kind int, key long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, value double, score double"

    def measure(batches):
        import pyarrow as pa

        store = worker_store()
        if getattr(store, "ctw_of", None) is not shared:
            store.ctw = None  # what an earlier run left goes first
            store.ctw_of, store.ctw = shared, (_Known(*shared.value[:2]), _Values(*shared.value[2:]))
        known_codes, values = store.ctw
        classes = _classes()
        kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.float64()] * 2
        names = [x.split()[0] for x in schema.split(", ")]
        for rows, texts in _chunks(batches, 1, 2, 3):
            codes, begins = _codes(texts, classes)
            logs = known_codes.of(codes)
            other = np.nonzero(np.isnan(logs))[0]
            logs[other] = 0
            scores = np.add.reduceat(logs, begins, dtype=np.float64)
            out: list[list] = [[] for _ in names]
            rest: list[list] = [[] for _ in range(4)]
            for (row, doc, held_out), text, total in zip(rows, texts, scores.tolist()):
                words = text.lower().split()
                value = np.fromiter(map(values.__getitem__, words), np.float64, len(words))
                rare = np.nonzero(np.isnan(value))[0]
                known = len(words) - len(rare) + end_known
                for column, x in zip(out, (row, None, None, None, doc, held_out, len(words) + 1, known, len(text) + 1, float(np.nansum(value)) + end_value, total)):
                    column.append(x)
                if len(rare):
                    keys, times = np.unique(np.array([_word_key(words[i]) for i in rare], np.int64), return_counts=True)
                    for column, x in zip(rest, (np.full(len(keys), row, np.int64), np.zeros(len(keys), np.int32), keys, times)):
                        column.append(x)
            if len(other):
                text_no = np.searchsorted(begins, other, "right") - 1
                order = np.lexsort((codes[other], text_no))
                text_no, keys = text_no[order], codes[other][order].astype(np.int64)
                starts = np.nonzero(np.concatenate(([True], (text_no[1:] != text_no[:-1]) | (keys[1:] != keys[:-1]))))[0]
                of_row = np.array([row for row, *_ in rows], np.int64)[text_no[starts]]
                for column, x in zip(rest, (of_row, np.ones(len(starts), np.int32), keys[starts], np.diff(np.append(starts, len(keys))))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
            if rest[0]:
                columns = [pa.array(np.concatenate(x)) for x in rest]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(n, k) for k in kinds[4:]], names=names)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    measured = stash(
        docs.select(
            F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")
        ).mapInArrow(measure, schema)
    )
    vocabulary = found.where(is_word & (step < least)).select("key", "n")
    rare = (
        measured.where("kind = 0").select("row", "key", "times").join(vocabulary, "key")
        .groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_value"))
    )
    others = measured.where("kind = 1").select("row", "key", "times")
    codes = trained.withColumn("wanted", F.lit(False)).union(others.select("key", F.lit(0).cast("long"), F.lit(True)).distinct())
    valued = code_values(codes.groupBy("key").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted")), top)
    rest_score = others.join(valued, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("_score"))
    norm = float(np.log10(n_train + v + 1))
    return (
        measured.where("kind is null").join(rare, "row", "left").join(rest_score, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            (F.col("value") + F.coalesce("_value", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
            (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"), "n_bytes",
        )
        .withColumn("bits_per_byte", -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))
    )


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 != 2)


def op9_ctw(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, training_part(docs))
