"""Periodic runs in texts: aligned blocks of words are searched across their document, and what repeats at a distance that fits
the block's size seeds an exact extension to both sides.

A run is a stretch of words with smallest period q, at least max(SHORTEST, POWER * q) words long, that cannot be extended. Let B
be the power of two with B <= q < 2B. As the run is four periods long, a block of B words that begins at a multiple of B lies in
it together with its copy q words on. So for every B

* blocks whose words all recur B to 2B words later are kept (a lookup in the sorted places of each word, which is exact: a
  block without that has no copy there), other than those deep inside a run that is known, whose copies show that run again;
* the kept blocks are the integer-sequence keys of a pyahocorasick automaton, which is run over the words B to 3B words
  behind them; a block met d words on, B <= d < 2B, seeds the period d. A key has at most LETTERS integers, so that the
  automaton's way back from a mismatch is short: in large blocks each stands for B / LETTERS words, as their hash, and the
  words behind are read in as many interleaved sequences;
* a seed is compared word by word, then extended to both sides. Long enough stretches whose period is not a multiple of a smaller one are runs.

A block of small period q meets itself every q words. Of such a row of seeds only those can be a run's period that bring the
ends, or the beginnings, of the two stretches of period q over each other: two of them are extended, whatever their number, so
the work is in proportion to words times sizes.

The documents of a batch are laid end to end, with a separate mark after each, and searched together; tasks need nothing of
each other. A long text is split piece by piece; of its words only numbers are kept, 16 bytes a word.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows, equal and
null doc_ids are each searched; an empty table gives an empty one; other columns are carried, one named like a result is
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table, words

SHORTEST, POWER = 6, 4
#: Words of documents that are searched together, words of blocks in one automaton, and bytes of a text split at once.
TOGETHER = 400_000
AUTOMATON = 2_000_000
#: Integers of a key.
LETTERS = 16
PIECE = 1 << 20
FOUND = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


class _Numbers(dict):
    """word -> its number, from 0 in order of first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _numbered(text: bytes, numbers: dict):
    """Numbers of a text's words."""
    import re

    import numpy as np

    parts, at, blank = [], 0, re.compile(rb"[\x20\x09-\x0d]")
    while at < len(text):
        cut = blank.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        found = text[at:end].split()  # bytes are split at space and tab to carriage return
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Stretches:
    """Maximal stretches of a given period in seq, where every document ends with a number of its own."""

    def __init__(self, seq):
        self.seq, self.known = seq, {}

    def _equal_from(self, i: int, d: int) -> int:
        """The first place from i on that differs from the one d on."""
        seq, n, step = self.seq, len(self.seq) - d, 32
        while i < n:
            differ = (seq[i : min(i + step, n)] != seq[i + d : min(i + step, n) + d]).nonzero()[0]
            if len(differ):
                return i + int(differ[0])
            i, step = i + step, min(2 * step, 1 << 16)
        return n

    def _equal_to(self, i: int, d: int) -> int:
        """The first place from which all up to i equal those d on."""
        seq, step = self.seq, 32
        while i > 0:
            low = max(0, i - step)
            differ = (seq[low:i] != seq[low + d : i + d]).nonzero()[0]
            if len(differ):
                return low + int(differ[-1]) + 1
            i, step = low, min(2 * step, 1 << 16)
        return 0

    def around(self, low: int, high: int, d: int):
        """(start, end, new) of the stretch of period d over low to high; None if these words have no such period."""
        kept = self.known.setdefault(d, [])
        for start, end in kept:
            if start <= low and high <= end:
                return start, end, False
        if (self.seq[low : high - d] != self.seq[low + d : high]).any():
            return None
        found = self._equal_to(low, d), self._equal_from(low, d) + d
        kept[:] = [*kept[-2:], found]  # places are visited in rising order
        return *found, True

    def primitive(self, start: int, d: int) -> bool:
        """Whether the stretch of period d from start has no smaller period that divides d."""
        seq, rest, f = self.seq, d, 2
        while rest > 1:
            if rest % f:
                f = f + 1 if f * f <= rest else rest
                continue
            while rest % f == 0:
                rest //= f
            if (seq[start : start + d] == seq[start + d // f : start + d // f + d]).all():
                return False
        return True


def find_runs(seq, starts, ends, shortest: int = SHORTEST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted by start and period. Documents are seq[starts:ends], each followed by a mark,
    a number that stands nowhere else."""
    import numpy as np

    if power < 4:
        raise ValueError("shorter runs need not hold an aligned block and its copy")
    n = len(seq)
    first, last = (np.repeat(x, ends + 1 - starts) for x in (starts, ends))  # of each place's document
    keys = np.sort(seq * n + np.arange(n))
    runs: list[tuple[int, int, int]] = []
    stretches, size, letters = _Stretches(seq), 1, seq
    while n and size * power <= int((ends - starts).max()):
        at = np.arange(0, n, size)
        at = at[(at + 2 * size <= last[at]) & (last[at] - first[at] >= max(shortest, power * size))]
        at = at[~_inside(runs, at, size, n)]
        for offset in sorted(range(min(size, 16)), key=lambda o: (-o) % 5):
            place = at + offset * size // min(size, 16)
            word = seq[place] * n
            k = np.minimum(np.searchsorted(keys, word + place + size), n - 1)
            at = at[(keys[k] >= word + place + size) & (keys[k] < word + np.minimum(place + 2 * size, last[place]))]
        per = max(1, AUTOMATON // size)
        for part in range(0, len(at), per):
            _match(letters, at[part : part + per].tolist(), last, size, stretches, runs, shortest, power)
        size *= 2
        if size > LETTERS:
            letters = _doubled(letters, size // LETTERS // 2)
    return sorted(set(runs))


def _doubled(letters, m: int):
    """Letters of twice the words: 32 bits of a hash of those at each place and m words on."""
    import numpy as np

    x = letters.astype(np.uint64)
    both = x * np.uint64(0x9E3779B97F4A7C15)
    both[: len(x) - m] += (x[m:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    both ^= both >> np.uint64(29)
    return ((both * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)


def _inside(runs, at, size: int, n: int):
    """Which blocks begin at least three sizes before the end of a run of a period up to size that holds them."""
    import numpy as np

    change = np.zeros(n // size + 2, np.int64)
    known = np.array([(s, s + length - 3 * size) for s, length, q in runs if q <= size and length >= 3 * size], np.int64).reshape(-1, 2)
    low, high = -(-known[:, 0] // size), known[:, 1] // size + 1
    some = low < high
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some], -1)
    return (np.cumsum(change) > 0)[at // size]


def _match(letters, at: list[int], last, size: int, stretches: _Stretches, runs: list, shortest: int, power: int) -> None:
    """Adds to runs those that the blocks of `size` words at these places seed."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    m = max(1, size // LETTERS)  # words of a letter
    names: dict[tuple, int] = {}
    of, areas = {}, []
    for p in at:
        of[p] = names.setdefault(tuple(letters[p : p + size : m].tolist()), len(names))
        low, high = p + size, min(p + 3 * size, int(last[p]))
        if areas and low <= areas[-1][1]:
            areas[-1][1] = max(areas[-1][1], high)
        else:
            areas.append([low, high])
    if not names:
        return
    for block, name in names.items():
        automaton.add_word(block, name)
    automaton.make_automaton()
    for low, high in areas:
        met: list[tuple[int, int]] = []
        for phase in range(low, low + m):
            for end, name in automaton.iter(tuple(letters[phase : high - m + 1 : m].tolist())):
                o = phase + (end + 1) * m - size
                p = (o - size) // size * size  # the only block at a fitting distance
                if of.get(p) == name and o + size <= last[p]:
                    met.append((p, o - p))
        met.sort()
        begin = 0
        while begin < len(met):
            end, p = begin, met[begin][0]
            while end < len(met) and met[end][0] == p:
                end += 1
            _seeds(p, [d for _, d in met[begin:end]], size, stretches, runs, shortest, power)
            begin = end


def _seeds(p, met: list[int], size: int, stretches: _Stretches, runs: list, shortest: int, power: int) -> None:
    """Extends the distances at which the block at p was met again."""
    at = 0
    while at < len(met):
        end = at + 1
        while end < len(met) and 4 * (met[end] - met[end - 1]) <= size:
            end += 1
        row, at = met[at:end], end
        if len(row) > 2:
            q = row[1] - row[0]
            mine, other = stretches.around(p, p + size, q), stretches.around(p + row[0], p + row[0] + size, q)
            if mine and other and mine[0] == other[0]:
                continue  # one stretch of period q: every distance is a multiple of q
            if mine and other:
                row = sorted({other[0] - mine[0], other[1] - mine[1]}.intersection(row))
        for d in row:
            found = stretches.around(p, p + d + size, d)
            if found and found[2] and found[1] - found[0] >= max(shortest, power * d) and stretches.primitive(found[0], d):
                runs.append((found[0], found[1] - found[0], d))


def _search(texts: list) -> list[dict]:
    """A dictionary as FOUND for each text (bytes or None), searched together."""
    import numpy as np

    numbers = _Numbers()
    docs = [_numbered(t, numbers) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    seq = np.empty(int((sizes + 1).sum()), np.int64)
    for d, s, e in zip(docs, starts.tolist(), ends.tolist()):
        seq[s:e] = d
    seq[ends] = len(numbers) + np.arange(len(docs))
    docs.clear()
    found = find_runs(seq, starts, ends)
    spelled = list(numbers)
    change = np.zeros(len(seq) + 1, np.int64)
    of: list[list] = [[] for _ in texts]
    holder = np.searchsorted(starts, [r[0] for r in found], "right") - 1
    for (s, length, q), i in zip(found, holder.tolist()):
        of[i].append({"start": s - int(starts[i]), "length": length, "period": q})
        change[s + q] += 1
        change[s + length] -= 1
    kept = np.cumsum(change)[:-1] == 0
    out = []
    for runs, text, s, e in zip(of, texts, starts.tolist(), ends.tolist()):
        parts = [b" ".join(map(spelled.__getitem__, seq[x : min(x + PIECE, e)][kept[x : min(x + PIECE, e)]].tolist())) for x in range(s, e, PIECE)]
        out.append({"n_words": e - s, "runs": runs, "collapsed": b" ".join(p for p in parts if p).decode("utf-8", "replace")})
    return out


def _searcher():
    @F.arrow_udf(FOUND)
    def run(column):
        import pyarrow as pa

        texts, out, held, size = column.cast(pa.binary()), [], [], 0
        for at in range(0, len(texts), 500):
            for text in texts.slice(at, 500).to_pylist():
                held.append(text)
                size += len(text or b"") // 6 + 1
                if size > TOGETHER:
                    out += _search(held)
                    held, size = [], 0
        out += _search(held) if held else []
        run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())]))

    return run


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (array of start, length, period, in words) and collapsed: the text with one period of each run left."""
    whole = docs.withColumn("_found", _searcher()(text))
    for c in ("n_words", "runs", "collapsed"):
        whole = whole.withColumn(c, F.col("_found")[c])
    return whole.drop("_found")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the doc_id, one text in ten (h mod 10 = 0) from a word on repeats the words from there;
    where, and with which period, follows from h div 10."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = (h % 10 == 0) & F.col("text").isNotNull()
    g, w = F.col("_g"), F.col("_w")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(hit, words(F.col("text"))).alias("_w"))
    n = F.size("_w")
    placed = some.select("doc_id", "text", "_w", "_g", F.when(n > 0, g % n).cast("int").alias("_a"))
    placed = placed.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return placed.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    found = find(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    some = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return some.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
