"""Periodic runs, byte-pair encoding and conversation repair against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest

from sparquill.llm import bpe, periodic, queries, repair

pytestmark = pytest.mark.filterwarnings("ignore")

# --- periodic runs ------------------------------------------------------------------------------------------------------


def plain_runs(w):
    """Every maximal stretch for every period, word by word."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            b = i + q
            smaller = any(q % f == 0 and all(w[k] == w[k + f] for k in range(a, b - f)) for f in range(1, q))
            if b - a >= max(6, 4 * q) and not smaller:
                out.add((a, b - a, q))
    return sorted(out)


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_words(rng):
    k = rng.choice([1, 2, 2, 3, 30])
    w = [rng.randrange(k) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(3)):
        u = [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        w += (u * rng.randrange(1, 9))[: rng.randrange(1, 160)]
    if rng.random() < 0.3:
        w = w * 4
    if rng.random() < 0.3:  # stretches of one word between others: rows of seeds
        m = rng.randrange(1, 40)
        w = ([0] * m + [1] + [0] * rng.randrange(0, 5) + [1][: rng.randrange(2)]) * rng.randrange(3, 7)
    return [f"w{x}" for x in w]


@pytest.mark.parametrize("letters,seed", [(16, 1), (2, 2), (1, 3)])
def test_runs_equal_brute_force(monkeypatch, letters, seed):
    monkeypatch.setattr(periodic, "LETTERS", letters)
    rng = random.Random(seed)
    for _ in range(250):
        docs = [odd_words(rng) for _ in range(rng.randrange(1, 5))]
        for got, w in zip(periodic._search([" ".join(w).encode() for w in docs]), docs):
            want = plain_runs(w)
            assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
            assert got["n_words"] == len(w) and got["collapsed"] == plain_collapsed(w, want)


def test_runs_of_long_texts(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 1000)
    rng = random.Random(4)
    some = [f"w{rng.randrange(500)}" for _ in range(7001)]
    w = ["x"] * 9000 + some * 5 + (["a"] * 2000 + ["b"]) * 4
    (got,) = periodic._search([" ".join(w).encode()])
    assert [(r["start"], r["length"], r["period"]) for r in got["runs"] if r["length"] > 1000] == [
        (0, 9000, 1), (9000, 35005, 7001), *[(44005 + 2001 * k, (2000, 8004)[0], 1) for k in range(1)], (44005, 8004, 2001), *[(44005 + 2001 * k, 2000, 1) for k in range(1, 4)],
    ]
    assert got["collapsed"] == plain_collapsed(w, [(r["start"], r["length"], r["period"]) for r in got["runs"]])


def plain_tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_op11(rows):
    out = []
    for doc_id, text in rows:
        w = plain_tail(doc_id, [x.decode() for x in (text or "").encode().split()])
        runs = plain_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        facts = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((doc_id, len(runs), *facts, sha(lines), sha(plain_collapsed(w, runs))))
    return sorted(out, key=str)


def test_op11_equals_brute_force(spark, sf_dir, tmp_path):
    got = queries.queries()["op11_periodic"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = {d for d, t in docs if len((t or "").split()) < 1500}
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(found) == len(docs)
    assert [r for r in found if r[0] in short] == plain_op11([r for r in docs if r[0] in short])
    assert sum(r[1] for r in found) > 10


def test_runs_odd_rows(spark, odd_docs, no_docs):
    out = periodic.find(odd_docs)
    rows = out.collect()
    assert out.columns == [*odd_docs.columns, "n_words", "runs", "collapsed"] and len(rows) == odd_docs.count()
    assert periodic.find(no_docs).count() == 0 and periodic.repeated_tails(no_docs).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_words"] == 0 and by[3][0]["collapsed"] == "" and by[5][0]["runs"] == []
    assert any(r["collapsed"] == "wort" and tuple(r["runs"][0]) == (0, 20000, 1) for r in by[8])
    assert len(by[2]) == 2 and len(by[None]) == 2


# --- byte-pair encoding -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.default_path())


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def odd_text(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.randrange(0xE000, 0x20000), 10, 39, 0x115])) for _ in range(rng.randrange(40)))
    if kind == 1:
        return "".join(rng.choice("aabbe '\n<|endoftext|> s　 ") for _ in range(60))
    if kind == 2:
        return rng.choice(["<|endoftext|>", "ab", "   ", " x", "1"]) * rng.randrange(9)
    if kind == 3:
        return "".join(rng.choice("thequickandbrown ingestion") for _ in range(200))
    return " ".join(rng.choice(["don't", "we'll", "A'S", "x y", "東京", "naïve", "12345", "\t\t", "  "]) for _ in range(30))


def test_encoding_equals_the_library(tokenizer, vocabulary, monkeypatch):
    rng = random.Random(6)
    texts = [odd_text(rng) for _ in range(1500)] + ["a" * 20000, "".join(rng.choice("abcdefghij") for _ in range(20000))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(map(unpacked, bpe.text_encoder(vocabulary)(texts))) == want
    monkeypatch.setattr(bpe, "CHARACTERS", 50)  # long texts go block by block
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert list(map(unpacked, bpe.text_encoder(vocabulary, limit=20)(texts))) == want
    decode = bpe.id_decoder(vocabulary)
    for ids in want[::3]:
        assert decode(struct.pack(f"<{len(ids)}I", *ids)) == tokenizer.decode(ids, skip_special_tokens=False)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert decode(struct.pack(f"<{len(ids)}I", *ids)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_seams_are_told_by_merging_pairs(vocabulary):
    """Two tokens are compatible if and only if exact merging of their bytes gives the two."""
    import numpy as np

    v = vocabulary
    assert v.sound.all()
    ranked = dict(zip(v.keys.tolist(), zip(v.ranks.tolist(), v.news.tolist())))
    rng = random.Random(7)
    a = [rng.randrange(256 if k % 3 else 50256) for k in range(3000)]
    b = [rng.randrange(3000 if k % 2 else 50256) for k in range(3000)]
    fails = bpe._seams_fail(v, np.array(a), np.array(b))
    for x, y, bad in zip(a, b, fails.tolist()):
        pieces = [int(v.byte_ids[c]) for c in v.tokens[x] + v.tokens[y]]
        assert (bpe.merge(v, pieces, ranked) != [x, y]) == bad
    words = ["the", " quick", "ingestion", "xqzzt"]
    assert bpe.encode_words(v, [w.encode() for w in words])[1] < len(words)  # most pass without merging


def test_op12_equals_the_library(spark, sf_dir, tokenizer):
    got = queries.queries()["op12_bpe"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_encoding_odd_rows(odd_docs, no_docs):
    out = bpe.decode(bpe.encode(odd_docs), to="back")
    assert out.columns == [*odd_docs.columns, "ids", "back"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r["back"] == (r["text"] or "") for r in rows)
    assert bpe.encode(no_docs).count() == 0


# --- conversations ------------------------------------------------------------------------------------------------------


def plain_repair(codes):
    """(cost, audit) by trying every edit. codes: (initial, fault)."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, last, inserted):
        found = [(0, "")] if i == len(codes) and last in ("", "a") else []
        to = "a" if last == "u" else "u"

        def add(cost, initial, rest):
            if rest:
                found.append((rest[0] + cost, initial + rest[1]))

        if inserted < 3:
            add(3, "I", go(i, to, inserted + 1))
        if i < len(codes):
            role, fault = codes[i]
            add(4, "D", go(i + 1, last, 0))
            if fault not in ("b", "d"):
                charge = 3 if fault == "t" else 0
                if role == "s" and last == "":
                    add(charge, "K", go(i + 1, "s", 0))
                if role == to:
                    add(charge, "K", go(i + 1, to, 0))
                add(3 + charge, "R", go(i + 1, to, 0))
        return min(found, default=None)

    for i in range(len(codes), -1, -1):  # from the end, so that no call goes deep
        for last in ("", "s", "u", "a"):
            for inserted in (3, 2, 1, 0):
                go(i, last, inserted)
    return go(0, "", 0)


def plain_rows(rows):
    """Rows after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        out[conv]
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def plain_report(rows):
    out = []
    for conv, mine in plain_rows(rows).items():
        seen, faults = set(), []
        for _, role, text in mine:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        cost, audit = plain_repair(tuple(zip(initials, faults)))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines, last, i = [], "", 0
        for e in audit:
            to = "a" if last == "u" else "u"
            name = "assistant" if to == "a" else "user"
            if e == "I":
                lines.append(f"{name}:")
                last = to
                continue
            _, role, text = mine[i]
            i += 1
            if e == "R":
                lines.append(f"{name}:{text}")
                last = to
            elif e == "K":
                lines.append(f"{role}:{text}")
                last = role[:1]
        counts = [faults.count(f) for f in "bdt"]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_search_and_chain_equal_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        rows = tuple((rng.choice("suuaax"), rng.choice(["", "", "", "t", "b"])) for _ in range(rng.randrange(1, 9)))
        codes = "".join("." if f == "b" else r.upper() if f == "t" else r for r, f in rows)
        for size in (1, 2, 3, 100):
            parts, chain = [codes[i : i + size] for i in range(0, len(codes), size)], repair._Chain()
            ways = [[w for s in range(4) for w in repair.search(p, s)] for p in parts]
            for k, w in enumerate(ways):
                fixed = dict(first_initial="u", last_initial="a", first_turn=1, last_turn=1, turns=1, **dict.fromkeys(repair._COUNTS, 0))
                chain.add(dict(block=k, costs=[x and x[0] for x in w], audits=[x and x[1] for x in w], **fixed))
            found = list(chain.rows())
            audit = "".join(w[r[2]][1] for w, r in zip(ways, found)) + "I" * len(repair.ENDS[found[-1][3]])
            assert (found[-1][-1], audit) == plain_repair(rows)


def test_op13_equals_brute_force(spark, sf_dir):
    got = queries.queries()["op13_repair"](spark, sf_dir)
    assert got.columns == REPORT
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(rows)


def odd_conversations():
    rng = random.Random(9)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Yes.", "It is so!", "x " * 3000 + "."]
    rows = [(c, t if t % 7 else None, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(texts)) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    return rows + rows[:9] + [(77, t, "ua"[t % 2], "again and again.") for t in range(300)] + [(78, 1, "user", "same.")] * 200


def test_op13_odd_rows(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, block string, at int, rows int"
    rows = odd_conversations()
    spark.createDataFrame([(*r, "b", 1, 2) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.queries()["op13_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == plain_report(rows)


def test_repair_in_small_blocks(spark):
    """A conversation far longer than a block: same report, and the repaired rows themselves have the structure."""
    rows = odd_conversations()
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(3)
    small, large = (sorted(map(tuple, repair.report(df, bits).collect()), key=str) for bits in (2, 9))
    assert small == large and any(len(r[7]) > 100 for r in small)
    by = defaultdict(list)
    for r in repair.repaired(df, 2).orderBy("block", "pos").collect():
        by[r["conv_id"]].append(r["role"][:1] + ":" + r["text"])
    import re

    for lines in by.values():
        assert re.fullmatch("s?(ua)+", "".join(x[0] for x in lines))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.report(none).count() == 0 and repair.repaired(none).count() == 0 and repair.damaged(none).count() == 0


def test_bpe_cuts_and_merges_like_the_plain_ways():
    """Ranges of characters cut as the pattern's classes do; merging words together is merging each."""
    import regex

    rng = random.Random(5)
    common = [chr(i) for i in range(bpe.COMMON)]
    cut, plain = bpe._common_cut(), regex.compile(bpe.PATTERN).findall
    for _ in range(2000):
        some = "".join(rng.choices([*common, *" \n\t's 'll a9²_\x1c\x85\xa0" * 8], k=rng.randint(0, 30)))
        assert cut(some) == plain(some)
    v = bpe.vocabulary(bpe.default_path())
    ranked = dict(zip(v.keys.tolist(), zip(v.ranks.tolist(), v.news.tolist())))
    words = [bytes(rng.choices(b"aeinorst hlABC\xc3\xa9\x00\xff", k=rng.randint(1, bpe.SHORT))) for _ in range(500)] + [b"a" * n for n in range(1, bpe.SHORT + 1)]
    want = [bpe.merge(v, v.byte_ids[list(w)].tolist(), ranked) for w in words]
    found = bpe.merge_together(v, words)
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in found] == want
    assert bpe.merge_together(v, [b"e"]) == [int(v.byte_ids[101]).to_bytes(4, "little")]
