"""Packing documents into sequences of a fixed number of tokens, shortest pack first over the length histogram.

`pieces` tokenises and cuts documents; `plan` packs the histogram of piece lengths (at most seq_len rows, whatever the
corpus) into patterns with counts; `pack` ranks the pieces of each length and joins the patterns back by rank.

Defined cases: a null or empty text is the end id alone; repeated rows are packed once each; equal or null doc_ids are
packed as they come; an empty table packs into nothing; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import global_rank, stash, table, tidy
from ._tokens import default_path, encoder, slices

SEQ_LEN = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """A row per piece: whole documents up to seq_len tokens, longer ones cut at its multiples."""
    path = path or default_path()

    def cut(batches):
        import zlib

        import pyarrow as pa

        encode = encoder(path)
        for doc_column, text_column in (part for batch in batches for part in slices(batch)):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(doc_column, text_column):
                ids = encode(text)
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    part = ids[4 * start : 4 * (start + seq_len)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, _PIECES)


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for the ranks of each length.

    Lengths are placed longest first, each into the shortest pack (the most free room) until its count is used up; packs
    that look the same are one pattern with a count, so the work depends on seq_len and not on the number of pieces.
    """
    open_: dict[int, list[list]] = {}  # free room -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:  # no pack has room: new ones, with as many of this length as fit
                most = seq_len // length
                for count, of_it in ((left // most, most), (1, left % most)):
                    if count and of_it:
                        open_.setdefault(seq_len - of_it * length, []).append([count, [length] * of_it])
                break
            count, lengths = open_[room].pop()
            if count > left:
                open_[room].append([count - left, lengths])
            elif not open_[room]:
                del open_[room]
            used = min(count, left)
            open_.setdefault(room - length, []).append([used, [*lengths, length]])
            left -= used
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(open_):
        for count, lengths in open_[room]:
            offset = 0
            for length in lengths:
                rows.append((length, ranks[length], ranks[length] + count, sequence, offset))
                ranks[length] += count
                offset += length
            sequence += count
    return rows


@tidy
def pack(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, seq_len))
    # one row per length, at most seq_len rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for length in sorted(histogram):
        before.append((length, total))
        total += histogram[length]
    starts = spark.createDataFrame(before, "length long, _before long")
    slots = spark.createDataFrame(plan(histogram, seq_len), "length long, _lo long, _hi long, _seq long, offset long")
    ranked = global_rank(cut, "length", "doc_id", "start", "ids_crc32").join(F.broadcast(starts), "length")
    ranked = ranked.withColumn("_k", F.col("rank") - F.col("_before")).drop("rank", "_before")
    # the pattern table is bounded by seq_len, not by the corpus
    return (
        ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi")))
        .drop(slots["length"])
        .withColumn("sequence_id", F.col("_seq") + F.col("_k") - F.col("_lo"))
        .drop("_k", "_lo", "_hi", "_seq")
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
