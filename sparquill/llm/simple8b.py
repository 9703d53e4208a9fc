"""Token ids as Simple-8b words: a 4-bit selector says how many ids of what width the other 60 bits hold.

A segment is a self-contained run of whole documents in doc_id order. Its ids are coded in blocks of BLOCK ids; the
segment keeps the word at which each block begins, so blocks can be decoded on their own and all words of a segment at
once. Ids of more than 60 bits are escapes: selector 15 points into the segment's list of raw values.

`write` stores the segments, in order, as rows of a Parquet folder, so that Spark's committer gives each of them
exactly once even when a task is run again; `read` decodes them.

Defined cases: a null or empty text is the end id alone; repeated rows and equal doc_ids keep a place each (ties by the
text's first characters, then its hash, and then as the rows come, so that many rows of one doc_id are spread over tasks);
a null doc_id comes first; an empty table writes no segment; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _offsets, shared_dir, table
from ._tokens import default_path, encoder, slices

#: Fixed values of the format: ids per word and bits per id, by selector. 15 is the escape, 14 is unused.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 128
SEGMENT_IDS = 1 << 18
KEPT_WORDS = 700_000  # per generation, in a worker
_HEADER = "<4sIQQQQQ"  # magic, version, documents, ids, blocks, words, escapes
_SEGMENTS = "part int, segment int, start_in_part long, n_ids long, payload binary"


def encode_ids(ids):
    """(words, first word of each block, raw values of the escapes) for unsigned ids in numpy."""
    import numpy as np

    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    bits = np.full((blocks, BLOCK + 60), 255, np.uint8)  # what lies past a block never fits
    width = np.zeros(blocks * BLOCK, np.uint8)
    rest = flat.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1 << step)
        width += (high * step).astype(np.uint8)
        rest = np.where(high, rest >> np.uint64(step), rest)
    width += rest.astype(bool)
    width[n:] = 255
    bits[:, :BLOCK] = width.reshape(blocks, BLOCK)

    def wider(a, b, by):  # the largest width in a window made of two
        out = np.full_like(a, 255)
        np.maximum(a[:, : a.shape[1] - by], b[:, by:], out=out[:, : a.shape[1] - by])
        return out

    top = {1: bits}
    for count, one, two in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 8), (20, 12, 12), (30, 15, 15), (60, 30, 30)):
        top[count] = wider(top[one], top[two], count - two)
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        np.copyto(choice, s, where=top[COUNTS[s]][:, :BLOCK] <= BITS[s])
    counts = np.ones(16, np.int64)
    counts[: len(COUNTS)] = COUNTS
    starts = np.zeros(blocks * BLOCK, bool)
    choice = choice.ravel()
    place = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(place + BLOCK, n)
    while len(place):  # one word of every block at a time
        starts[place] = True
        place = place + counts[choice[place]]
        more = place < end
        place, end = place[more], end[more]
    at = np.nonzero(starts)[0]
    selector = choice[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        mine = np.nonzero(selector == s)[0]
        for j in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= flat[at[mine] + j] << np.uint64(j * BITS[s])
    mine = np.nonzero(selector == ESCAPE)[0]
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    first = np.searchsorted(at, np.arange(blocks, dtype=np.int64) * BLOCK).astype(np.uint32)
    return words, first, flat[at[mine]]


def decode_ids(words, escapes):
    """The ids of whole blocks of words, all at once."""
    import numpy as np

    counts, bits = np.ones(16, np.int64), np.zeros(16, np.uint64)
    counts[: len(COUNTS)], bits[: len(BITS)] = COUNTS, BITS
    bits[ESCAPE] = 60
    selector = (words >> np.uint64(60)).astype(np.int64)
    many = counts[selector]
    word = np.repeat(np.arange(len(words)), many)
    j = (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
    width = bits[selector][word]
    ids = (words[word] >> (j * width)) & ((np.uint64(1) << width) - np.uint64(1))
    raw = selector[word] == ESCAPE
    if raw.any():
        ids[raw] = escapes[ids[raw].astype(np.int64)]
    return ids


def pack_segment(doc_ids, lengths, ids) -> bytes:
    """A segment's bytes. doc_ids may hold None."""
    import numpy as np

    words, first, escapes = encode_ids(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        (
            struct.pack(_HEADER, b"SQ8B", 1, len(doc_ids), len(ids), len(first), len(words), len(escapes)),
            known.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            first.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        )
    )


def unpack_segment(payload: bytes):
    """(doc_ids with None, lengths, ids) of a segment."""
    import numpy as np

    magic, version, docs, n, blocks, n_words, n_escapes = struct.unpack_from(_HEADER, payload)
    if (magic, version) != (b"SQ8B", 1):
        raise ValueError("not a Simple-8b segment")
    at, parts = struct.calcsize(_HEADER), []
    for kind, count in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", blocks), ("<u8", n_words), ("<u8", n_escapes)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    known, doc_ids, lengths, _, words, escapes = parts
    ids = decode_ids(words, escapes)
    if len(ids) != n:
        raise ValueError("a Simple-8b segment is damaged")
    return [int(d) if k else None for k, d in zip(known, doc_ids)], lengths.astype(np.int64), ids


def write(docs: DataFrame, to: str, path: str | None = None) -> str:
    """Tokenises docs and writes their segments in ascending doc_id order under `to`."""
    path = path or default_path()

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        packed = encoder(path, KEPT_WORDS)
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        names = ["part", "segment", "start_in_part", "n_ids", "payload"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        doc_ids, parts, held = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [part, segment, start, len(ids), pack_segment(doc_ids, [len(p) // 4 for p in parts], ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names), len(ids)

        for doc_column, text_column in (part for batch in batches for part in slices(batch)):
            for doc, text in zip(doc_column, text_column):
                doc_ids.append(doc)
                parts.append(packed(text))
                held += len(parts[-1]) // 4
                if held >= SEGMENT_IDS:
                    out, n = flush()
                    yield out
                    doc_ids, parts, held, segment, start = [], [], 0, segment + 1, start + n
        if doc_ids:
            yield flush()[0]

    order = ("doc_id", "head", "hash", "row")
    ordered = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.substring("text", 1, 64).alias("head"),
        F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    (
        ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
        .mapInArrow(encode, _SEGMENTS).write.parquet(to)
    )
    return to


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    segments = spark.read.schema(_SEGMENTS).parquet(at)
    # a row for each partition of the writing job
    before = _offsets(segments.groupBy(F.col("part").alias("_part")).agg(F.sum("n_ids").alias("_n")), "_n")

    def decode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for starts, payloads in (part for batch in batches for part in slices(batch, 1)):
            for at, payload in zip(starts, payloads):
                doc_ids, lengths, ids = unpack_segment(payload)
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(at + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (
        segments.join(F.broadcast(before), segments["part"] == before["_part"])
        .select((F.col("_before") + F.col("start_in_part")).alias("at"), "payload")
        .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op8_simple8b(spark, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark).rstrip('/')}/sparquill-ids-{uuid.uuid4().hex}"
    return read(spark, write(table(spark, sf_dir, "documents"), to))
