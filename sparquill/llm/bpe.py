"""Byte-pair encoding and decoding by speculation: greedy longest match proposes, vectorised checks verify.

A text is cut into words by the vocabulary's pattern. The distinct words of a batch that the worker has not met are laid end
to end, and three steps over that one buffer encode them:

* propose: at every byte the longest token of the vocabulary that stands there, found by walking a trie for all places at
  once; the tokens of a word are those reached from its first byte by jumping over each match;
* verify: two neighbours are compatible if merging their bytes alone would never join across the seam. A token's edge is made
  by a chain of merges, each at its rank; undoing these on both sides, the later one first, shows every pair of pieces that
  ever stood at the seam, and whether a merge of the two came before the piece was used up. A row of tokens is the result of
  byte-pair merging if and only if all neighbours are compatible, as the first merge across a seam would happen in the pair
  alone too;
* merge: words with a seam that fails are merged exactly, by rank and then place: short ones all together, a merge of each a
  round, long ones with a heap.

Tables are made on the driver from the vocabulary file and broadcast: their size is that of the vocabulary. A worker keeps the
ids of up to MAX_WORDS words.

Defined cases: null and empty texts have no ids; the special token's string in a text is the special token; texts of any length
are worked off BLOCK words at a time; an unknown id decodes to nothing, bytes that are no UTF-8 to U+FFFD; repeated rows, equal
and null doc_ids are encoded as they come; an empty table gives an empty one; other columns are carried, one named like the
result is replaced.
"""

from __future__ import annotations

import types
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._tokens import worker_store

# The pattern that cuts a text into words before byte-level merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps the ids of.
MAX_WORDS = 400_000
#: Words of a long text that are looked up at once, and characters of short texts.
BLOCK = 100_000
CHARACTERS = 1_000_000
#: Bytes up to which failing words are merged together, and how many of them.
SHORT, TOGETHER = 48, 4000
NEVER = 1 << 40
#: Characters from here on are cut into words by the `regex` library only.
COMMON = 0x250


def _common_cut() -> Callable:
    """Function of a text of characters below COMMON: its words. The pattern's classes are spelled as ranges, which the standard
    library's expressions go through in half the time."""
    import re

    import regex

    def ranges(kind: str) -> str:
        found = [m.span() for m in regex.finditer(f"{kind}+", "".join(map(chr, range(COMMON))))]
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in found)

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    pattern = PATTERN.replace(r"\S", f"[^{space}]").replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for kind, spelled in ((r"\p{L}", letter), (r"\p{N}", number), (r"\s", space)):
        pattern = pattern.replace(kind, f"[{spelled}]")
    return re.compile(pattern).findall


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable ones for themselves, the others by the
    letters from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> types.SimpleNamespace:
    """Tables of a byte-level vocabulary file: tokens, merges, special tokens, the trie and what the seam check needs."""
    import json

    import numpy as np

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters = _byte_letters()
    ids = held["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in held["added_tokens"]}
    spelled = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
    n = max([*spelled, *specials.values()]) + 1
    tokens = [spelled.get(i, b"") for i in range(n)]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
    left, right, rank, made = (np.full(n, v, np.int64) for v in (-1, -1, -1, 0))
    for r, (a, b) in enumerate(pairs):
        new = ids[a + b]
        made[new] += 1
        left[new], right[new], rank[new] = ids[a], ids[b], r
    keys = np.array([ids[a] * n + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    out = types.SimpleNamespace(
        n=n, tokens=tokens, specials=specials, left=left, right=right, rank=rank, keys=keys[order], ranks=np.arange(len(keys))[order],
        news=np.array([ids[a + b] for a, b in pairs], np.int64)[order],
        byte_ids=np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64),
    )
    out.edges, out.children, out.accepts = _trie({t: i for i, t in spelled.items()})
    # a token that its own bytes do not merge into is never a result; nor is the check sure of one that two merges make
    out.sound = _sound(out) & (made <= 1)
    return out


def _trie(spelled: dict[bytes, int]):
    """(edges, children, accepts): edge node * 256 + byte leads to a child; accepts has a node's token or -1. Nodes with children
    have the first numbers."""
    import numpy as np

    prefixes = {t[:k] for t in spelled for k in range(len(t) + 1)}
    inner = {p[:-1] for p in prefixes if p}
    nodes = {p: i for i, p in enumerate(sorted(prefixes, key=lambda p: (p not in inner, len(p), p)))}
    edges = np.fromiter((nodes[p[:-1]] * 256 + p[-1] for p in nodes if p), np.int64, len(nodes) - 1)
    children = np.fromiter((i for p, i in nodes.items() if p), np.int64, len(nodes) - 1)
    accepts = np.full(len(nodes), -1, np.int64)
    for t, i in spelled.items():
        accepts[nodes[t]] = i
    return edges, children, accepts


def _steps(v):
    """Table of the trie's steps, by node * 256 + byte: the child, or -1. Made once on a worker."""
    import numpy as np

    if not hasattr(v, "steps"):
        v.steps = np.full((int(v.edges.max()) // 256 + 1) * 256, -1, np.int32)
        v.steps[v.edges] = v.children
    return v.steps


def _find(sorted_keys, wanted):
    """Places of wanted in sorted_keys, and which of them are there."""
    import numpy as np

    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def _seams_fail(v, a, b, skip_whole: bool = False):
    """Which pairs of tokens (a, b) merge across their seam when merged as one text. skip_whole: other than as wholes."""
    import numpy as np

    a, b = a.copy(), b.copy()
    used_a, used_b = np.full(len(a), NEVER), np.full(len(a), NEVER)  # rank at which the piece at the seam is used up
    bad, live = np.zeros(len(a), bool), np.arange(len(a))
    first = skip_whole
    while len(live):
        x, y = a[live], b[live]
        if not first:
            at, there = _find(v.keys, x * v.n + y)
            r = np.where(there, v.ranks[at], NEVER)
            # of two merges of one rank the one further left comes first: that of the left token, then the seam's
            bad[live] |= (r < used_a[live]) & (r <= used_b[live]) & (r < NEVER)
        first = False
        of_x, of_y = v.rank[x], v.rank[y]
        undo_x = of_x > of_y
        go_on = ~bad[live] & (undo_x | (of_y >= 0))
        live, undo_x, x, y = live[go_on], undo_x[go_on], x[go_on], y[go_on]
        lx, ly = live[undo_x], live[~undo_x]
        used_a[lx], a[lx] = v.rank[x[undo_x]], v.right[x[undo_x]]
        used_b[ly], b[ly] = v.rank[y[~undo_x]], v.left[y[~undo_x]]
    return bad


def _sound(v):
    """Tokens that their own bytes merge into."""
    import numpy as np

    merged = np.nonzero(v.rank >= 0)[0]
    ok = np.ones(v.n, bool)
    ok[merged] = ~_seams_fail(v, v.left[merged], v.right[merged], skip_whole=True)
    for t in merged[np.argsort(v.rank[merged])].tolist():  # parts come before what they make
        ok[t] &= ok[v.left[t]] and ok[v.right[t]]
    return ok


def propose(v, data, starts):
    """(places, tokens) of the greedy longest matches in data, a buffer of words that begin at starts; every word's tokens tile it."""
    import numpy as np

    n = len(data)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    length, token = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    steps = _steps(v)
    live, node, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(live):
        to = steps[node * 256 + data[live + depth]]
        there = to >= 0
        live, node = live[there], to[there].astype(np.int64)
        depth += 1
        accepted = v.accepts[node]
        takes = accepted >= 0
        length[live[takes]], token[live[takes]] = depth, accepted[takes]
        inside = (live + depth < ends[live]) & (node * 256 < len(steps))
        live, node = live[inside], node[inside]
    if (length == 0).any():
        raise ValueError("the vocabulary lacks a byte")
    jump, reached = np.append(np.arange(n) + length, n), np.zeros(n + 1, bool)
    reached[starts] = True
    before = 0
    while (count := int(reached.sum())) != before:  # a round reaches twice as many jumps
        before = count
        reached[jump[np.nonzero(reached)[0]]] = True
        jump = jump[jump]
    places = np.nonzero(reached[:n])[0]
    return places, token[places]


def merge(v, pieces: list[int], ranked: dict) -> list[int]:
    """Exact merging of one word's byte tokens: the lowest rank first, of equal ones the one further left."""
    from heapq import heapify, heappop, heappush

    n = len(pieces)
    following, preceding = [*range(1, n), -1], [-1, *range(n - 1)]
    queue = [(*found, i) for i in range(n - 1) if (found := ranked.get(pieces[i] * v.n + pieces[i + 1]))]
    heapify(queue)
    while queue:
        rank, new, i = heappop(queue)
        j = following[i]
        if pieces[i] < 0 or j < 0 or ranked.get(pieces[i] * v.n + pieces[j]) != (rank, new):
            continue  # one of the two has been merged since
        pieces[i], pieces[j] = new, -1
        k = following[i] = following[j]
        if k >= 0:
            preceding[k] = i
            if found := ranked.get(new * v.n + pieces[k]):
                heappush(queue, (*found, i))
        h = preceding[i]
        if h >= 0 and (found := ranked.get(pieces[h] * v.n + new)):
            heappush(queue, (*found, h))
    return [p for p in pieces if p >= 0]


def merge_together(v, words: list[bytes]) -> list[bytes]:
    """Exact merging of many words of up to SHORT bytes: a round makes the first merge of every word that still has one.

    Pieces keep the place of their first byte, and know the places of the pieces beside them; a last column stands for no piece.
    """
    import numpy as np

    none = np.int32(1 << 30)  # the rank of what does not merge
    if not hasattr(v, "byte_ranks"):  # of two neighbouring bytes
        x, y = np.divmod(np.arange(1 << 16), 256)
        at, there = _find(v.keys, v.byte_ids[x] * v.n + v.byte_ids[y])
        v.byte_ranks = np.where(there, v.ranks[at], none).astype(np.int32)
        v.of_rank = np.empty(len(v.keys), np.int64)
        v.of_rank[v.ranks] = v.news
    sizes = np.array([len(w) for w in words])
    rows, width = len(words), int(sizes.max())
    w = width + 1
    inside = np.arange(width) < sizes[:, None]
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    pieces, ranks = np.full((rows, w), -1, np.int64), np.full((rows, w), none, np.int32)
    pieces[:, :width][inside] = v.byte_ids[data]
    pairs = v.byte_ranks[data[:-1] * 256 + data[1:]]
    ranks[:, : width - 1][inside[:, 1:]] = np.delete(pairs, np.cumsum(sizes)[:-1] - 1)  # of each piece with the next
    after = np.tile(np.arange(1, w + 1, dtype=np.int32), (rows, 1))
    after[np.arange(rows), sizes - 1] = width
    before = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1))
    before[:, 0] = width
    pieces, flat, after, before = pieces.ravel(), ranks.ravel(), after.ravel(), before.ravel()
    live = np.arange(rows)
    while True:
        at = ranks[live].argmin(1) if len(live) < rows else ranks.argmin(1)  # the first of equal ranks
        base = live * w
        i = base + at
        least = flat[i]
        go_on = least < none
        if not go_on.all():
            live, base, i, least = live[go_on], base[go_on], i[go_on], least[go_on]
        if not len(live):
            break
        j = base + after[i]
        k, h = base + after[j], base + before[i]
        new = v.of_rank[least]
        pieces[i], pieces[j], flat[j] = new, -1, none
        after[i], before[k] = after[j], i - base
        x, y = np.concatenate([new, pieces[h]]), np.concatenate([pieces[k], new])
        at, there = _find(v.keys, x * v.n + y)
        found = np.where(there & (x >= 0) & (y >= 0), v.ranks[at], none)
        flat[i], flat[h] = found[: len(i)], found[len(i) :]
    filled = pieces.reshape(rows, w) >= 0
    ends = 4 * np.cumsum(filled.sum(1))
    packed = pieces[filled.ravel()].astype("<u4").tobytes()
    return [packed[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encode_words(v, words: list[bytes]):
    """(ids of each word as little-endian unsigned 32-bit integers, how many words were merged exactly)."""
    import numpy as np

    if not words:
        return [], 0
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    places, tokens = propose(v, data, starts)
    word = np.searchsorted(starts, places, "right") - 1
    failing = np.zeros(len(words), bool)
    failing[word[~v.sound[tokens]]] = True
    inside = np.nonzero(word[1:] == word[:-1])[0]
    seams, which = np.unique(tokens[inside] * v.n + tokens[inside + 1], return_inverse=True)
    failing[word[inside[_seams_fail(v, seams // v.n, seams % v.n)[which]]]] = True
    packed, first = tokens.astype("<u4").tobytes(), np.searchsorted(places, np.append(starts, len(data)))
    out = [packed[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    if failing.any():
        if not hasattr(v, "ranked"):
            v.ranked = dict(zip(v.keys.tolist(), zip(v.ranks.tolist(), v.news.tolist())))
        together = np.nonzero(failing & (sizes <= SHORT))[0].tolist()
        together.sort(key=lambda i: len(words[i]))  # words of one length fill their rows
        for at in range(0, len(together), TOGETHER):
            some = together[at : at + TOGETHER]
            for i, ids in zip(some, merge_together(v, [words[i] for i in some])):
                out[i] = ids
        for i in np.nonzero(failing & (sizes > SHORT))[0].tolist():
            at = int(starts[i])
            pieces = v.byte_ids[data[at : at + len(words[i])]].tolist()
            out[i] = np.array(merge(v, pieces, v.ranked), "<u4").tobytes()
    return out, int(failing.sum())


def text_encoder(v, limit: int = MAX_WORDS) -> Callable:
    """Function of a list of texts: the packed ids of each. It keeps the ids of up to `limit` words, and those of one call."""
    import re
    import struct
    from itertools import islice

    import regex

    cut, common_cut = regex.compile(PATTERN), _common_cut()
    uncommon = re.compile(f"[^\\x00-\\u{COMMON - 1:04x}]")
    special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(v.specials, key=len, reverse=True)) or "(?!)")
    known: dict[str, bytes] = {}

    def learn(words: set[str]) -> None:
        new = words.difference(known)
        if len(known) + len(new) > limit:
            known.clear()
            new = words
        new = list(new)
        known.update(zip(new, encode_words(v, [w.encode("utf-8", "replace") for w in new])[0]))

    def long(text: str) -> bytes:
        out, found = [], cut.finditer(text)
        while block := [m.group() for m in islice(found, BLOCK)]:
            learn(set(block))
            out.append(b"".join(map(known.__getitem__, block)))
        return b"".join(out)

    def with_specials(text: str) -> bytes:
        out, at = [], 0
        for m in special.finditer(text):
            out += [long(text[at : m.start()]), struct.pack("<I", v.specials[m.group()])]
            at = m.end()
        return b"".join([*out, long(text[at:])])

    def encode(texts: list) -> list[bytes]:
        out: list = [b""] * len(texts)
        some: list = []

        def short() -> None:
            learn(set().union(*[words for _, words in some]))
            for i, words in some:
                out[i] = b"".join(map(known.__getitem__, words))
            some.clear()

        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > CHARACTERS or special.search(text):
                out[i] = with_specials(text)
                continue
            some.append((i, cut.findall(text) if uncommon.search(text) else common_cut(text)))
            held += len(text)
            if held > CHARACTERS:
                short()
                held = 0
        short()
        return out

    return encode


def id_decoder(v) -> Callable:
    """Function of packed ids: their text."""
    import numpy as np

    spelled = list(v.tokens)
    for s, i in v.specials.items():
        spelled[i] = s.encode()

    def decode(packed: bytes) -> str:
        ids, parts = np.frombuffer(packed, "<u4"), []
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            parts.append(b"".join(map(spelled.__getitem__, part[part < v.n].tolist())))
        return b"".join(parts).decode("utf-8", "replace")

    return decode


def _held(path: str):
    """A function that gives, on a worker, what `make` makes of the broadcast vocabulary, once for as long as the worker lives."""
    shared = SparkSession.active().sparkContext.broadcast(vocabulary(path))

    def get(name: str, make: Callable):
        kept = worker_store().__dict__.setdefault("bpe", {})
        if (path, name) not in kept:
            kept[path, name] = make(shared.value)
        return kept[path, name]

    return get


def encode(docs: DataFrame, path: str | None = None, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with `to`: the text's ids as little-endian unsigned 32-bit integers."""
    held = _held(path or default_path())

    @F.arrow_udf("binary")
    def ids(column):
        import pyarrow as pa

        encoder = held("encode", text_encoder)
        step = 1000
        return pa.array([x for at in range(0, len(column), step) for x in encoder(column.slice(at, step).to_pylist())], pa.binary())

    return docs.withColumn(to, ids(text))


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """coded with `to`: the text of its ids, special tokens included; null ids give a null text."""
    held = _held(path or default_path())

    @F.arrow_udf("string")
    def texts(column):
        import pyarrow as pa

        decoder = held("decode", id_decoder)
        return pa.array([None if x is None else decoder(x) for at in range(0, len(column), 1000) for x in column.slice(at, 1000).to_pylist()], pa.string())

    return coded.withColumn(to, texts(ids))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(coded.select("doc_id", "ids")).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
