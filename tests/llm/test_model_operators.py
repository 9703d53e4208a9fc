import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import _tokens, ctw, hilbert, langid, packing, preference, queries, simple8b
from sparquill.llm._tokens import default_path

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check_packing(rows, docs, tokenizer):
    """rows of pack() against whole-text encodings of docs (doc_id, text), which may repeat."""
    want = Counter((d, crc(ids_of(tokenizer, t))) for d, t in docs)
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQ_LEN
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(len(ids_of(tokenizer, t)) for _, t in docs)
    assert sum(r["length"] for r in rows) == total
    for d, t in docs:
        ids = ids_of(tokenizer, t)
        starts = Counter((r["start"], r["length"], r["ids_crc32"]) for r in whole[d] if r["doc_tokens"] == len(ids))
        for s in range(0, len(ids), packing.SEQ_LEN):
            part = ids[s : s + packing.SEQ_LEN]
            assert starts[s, len(part), crc(part)] >= 1
    assert want


def test_packing(spark, sf_dir, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.queries()["op7_packing"](spark, sf_dir).collect()
    check_packing(rows, docs, tokenizer)
    used = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) / (used * packing.SEQ_LEN) > 0.95


def test_packing_odd_rows(odd_docs, no_docs, tokenizer):
    check_packing(packing.pack(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert packing.pack(no_docs).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_covers_every_rank(histogram):
    rows = packing.plan(histogram, 64)
    for length, n in histogram.items():
        spans = sorted((lo, hi) for x, lo, hi, _, _ in rows if x == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    fill = Counter()
    for length, lo, hi, first, _ in rows:
        for s in range(first, first + hi - lo):
            fill[s] += length
    assert all(v <= 64 for v in fill.values()) and sorted(fill) == list(range(len(fill)))


@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 60000) | st.integers(0, 1), max_size=700))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    payload = simple8b.pack_segment([None, 5], [0, len(ids)], np.array(ids, np.uint64))
    docs, lengths, back = simple8b.unpack_segment(payload)
    assert docs == [None, 5] and lengths.tolist() == [0, len(ids)] and back.tolist() == ids


def test_simple8b_blocks_stand_alone():
    ids = np.random.default_rng(0).integers(0, 49408, 1000).astype(np.uint64)
    words, first, escapes = simple8b.encode_ids(ids)
    part = simple8b.decode_ids(words[first[3] : first[4]], escapes)
    assert (part == ids[3 * simple8b.BLOCK : 4 * simple8b.BLOCK]).all()


def test_plain_texts_take_no_word_to_the_library(tokenizer, monkeypatch):
    """op8, op7: a plain text's pieces go to the model alone, with the ids that the library gives for the whole text."""
    encode = _tokens.encoder(_tokens.default_path())
    rng = random.Random(3)
    odd = ["a", "zz", "ß", "ÿ", "À", "é", "Þ", "1", "29", "'", "'s", "'LL", "!", ".", "***", "\\", "^", "[", "~", "-", " ", "\n", "The", "é9é"]
    more = ["×", "÷", "ª", "µ", "İ", "ﬁ", "e\u0301", "€", "漢", "²", "\x00", "\x1c", "\x7f", "\xa0", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    plain = ["".join(rng.choices(odd, k=rng.randint(1, 12))) for _ in range(600)]
    mixed = ["".join(rng.choices(odd + more, k=rng.randint(1, 12))) for _ in range(600)]
    for text in plain + mixed:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == [*want, _tokens.END_ID], text
    monkeypatch.setattr(_tokens._WordIds, "made", None)
    assert all(len(encode(f"{text} new{i}x".encode())) > 4 for i, text in enumerate(plain))


def expected_files(docs, tokenizer):
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] is not None, (x[1] or "").encode()))):
        ids = ids_of(tokenizer, t)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_simple8b_files(spark, sf_dir, odd_docs, no_docs, tokenizer, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.queries()["op8_simple8b"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == sorted(expected_files(docs, tokenizer))
    odd = simple8b.read(spark, simple8b.write(odd_docs, str(tmp_path / "odd"))).collect()
    want = expected_files([(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert sorted(map(tuple, odd), key=str) == sorted(want, key=str)
    assert simple8b.read(spark, simple8b.write(no_docs, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("k, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_are_unit(k, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * k, indexing="ij"), -1).reshape(-1, k)
    index = hilbert.hilbert_index(grid, bits)
    assert (np.sort(index) == np.arange(len(grid))).all()
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


def check_shards(rows, docs):
    assert len(rows) == len(docs)
    counts = Counter(r["shard"] for r in rows)
    if len(rows) >= 16:
        assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_shards(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_shards(queries.queries()["op4_hilbert_shards"](spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    check_shards(hilbert.shard(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert hilbert.shard(no_docs).count() == 0


def test_shards_equal_a_plain_sort(spark, sf_dir):
    """Shard and slot of every row against quantising, ordering and cutting in plain Python."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.queries()["op4_hilbert_shards"](spark, sf_dir).collect()}
    size = lambda r: len((r["text"] or "").encode()) + 1

    def number(values):
        shared = 0
        known = [v.encode() for v in values if v is not None]
        lo, hi = min(known), max(known)
        while shared < min(len(lo), len(hi)) and lo[shared] == hi[shared]:
            shared += 1
        return lambda v: None if v is None else float(int.from_bytes(v.encode()[shared : shared + 6].ljust(6, b"\0"), "big"))

    scales = [number([r["lang"] for r in rows]), number([r["source"] for r in rows]), lambda v: math.log2(v + 1)]
    facts = [[f(v) for f, v in zip(scales, (r["lang"], r["source"], size(r)))] for r in rows]
    spans = [(min(x for x in c if x is not None), max(x for x in c if x is not None)) for c in zip(*facts)]
    top = (1 << hilbert.BITS) - 1
    cells = [[0 if x is None else 1 + math.floor((x - lo) / ((hi - lo) or 1.0) * (top - 1)) for x, (lo, hi) in zip(f, spans)] for f in facts]
    curve = hilbert.hilbert_index(np.array(cells), hilbert.BITS)
    order = sorted(range(len(rows)), key=lambda i: (curve[i], rows[i]["doc_id"]))
    begins = {}
    for rank, i in enumerate(order):
        shard = rank * 16 // len(rows)
        begins.setdefault(shard, rank)
        assert got[rows[i]["doc_id"]] == (shard, rank - begins[shard])


def test_shard_files_of_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'mine' as shard", "1 as _slot", "2 as _row", "3 as slot")
    out = spark.read.parquet(hilbert.write(docs, str(tmp_path / "clash")))
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns) and out.where("shard between 0 and 15").count() == out.count()


def test_shard_files_prune(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = spark.read.parquet(hilbert.write(docs, str(tmp_path / "shards")))
    assert out.drop("shard").exceptAll(docs).isEmpty() and out.count() == docs.count()
    per_shard = out.groupBy("shard").agg({"lang": "count"}).count()
    langs = out.select("shard", "lang").distinct().count()
    assert per_shard == 16 and langs < 16 * 4  # shards do not hold every language


def test_preference_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good answer"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", None),
        (3, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 0, "user", "x"), (4, 0, "user", "hi"), (4, 1, "assistant", "a"),
        (4, 2, "user", "u"), (4, 3, "assistant", "a"), (4, 4, "assistant", "b"), (4, 5, "user", "u"), (5, 0, "assistant", "only"),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, source string")
    made = lambda t: preference.format_pairs(preference.pair_up(preference.conversations(t)))
    out = made(turns).collect()
    assert sorted(((r["source"], r["chosen_id"], r["rejected_id"]) for r in out), key=str) == sorted(
        [("opening", 1, 2), ("opening", None, None), ("alone", None, None), ("alone", 3, None), ("replies", 4, 4), ("alone", 5, None)], key=str
    )
    pair = next(r for r in out if r["chosen_id"] == 1)
    assert pair["prompt"] == "<|user|>\nhi\n" and pair["n_prompt_turns"] == 1
    assert pair["chosen"] == "<|assistant|>\ngood answer\n"
    assert [pair["chosen"][s["start"] : s["end"]] for s in pair["chosen_spans"]] == ["good answer"]
    assert [pair["rejected"][s["start"] : s["end"]] for s in pair["rejected_spans"]] == ["bad"]
    cut = next(r for r in out if r["chosen_id"] == 4)
    assert cut["n_prompt_turns"] == 4 and cut["chosen"] == "<|assistant|>\nb\n" and cut["rejected"] == "<|assistant|>\na\n"
    assert made(turns.limit(0)).count() == 0
    alone = made(turns.where("conv_id = 1")).first()
    assert alone["rejected_id"] is None and alone["rejected"] is None and alone["n_prompt_turns"] == 0


def test_preference_pairs_of_a_common_opening(spark, sf_dir):
    """A conversation more changes no pair of another opening; a common opening pairs all of its conversations."""
    rows = [(i, 0, "user", "hello" if i % 3 else f"own {i}") for i in range(90)] + [(i, 1, "assistant", f"answer {i}") for i in range(90)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = lambda t: {(r["chosen_id"], r["rejected_id"]) for r in preference.pair_up(preference.conversations(t)).collect() if r["source"] == "opening"}
    common = [i for i in range(90) if i % 3]
    assert made(turns) == set(zip(common[::2], common[1::2]))
    assert made(turns.union(turns.where("conv_id = 0").selectExpr("-5L", "turn", "role", "text"))) == made(turns) | {(-5, 0)}
    out = queries.queries()["op5_preference_pairs"](spark, sf_dir).collect()
    assert sum(r["n_prompt_turns"] > 0 for r in out) > len(out) / 2


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3, 4)
    net.w = [w.astype(np.float64) for w in net.w]
    x, labels = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, labels)
    for w, g in zip(net.w, grads):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[0] == 256:
                at = (int(x[2, 1]), *at[1:])
            old = w[at]
            w[at] = old + 1e-3
            up = net.gradients(x, labels)[0]
            w[at] = old - 1e-3
            down = net.gradients(x, labels)[0]
            w[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_language_of_whole_texts_equals_a_plain_loop(spark):
    """Predictions against the network run byte by byte through each whole text, one direction after the other."""
    rng = np.random.default_rng(3)
    net = langid.Network(3, 5, seed=1)
    net.w[5] = np.array([0.1, -0.2, 0.0], np.float32)
    texts = ["".join(rng.choice(list("abc de\u00e9\u4e2d"), n)) for n in (1, 2, 130, 257, 700, 900, 5000)]

    def sigmoid(a):
        return 1 / (1 + np.exp(-a))

    def states(data, table, u):
        h, out = np.zeros(5), []
        for b in data:
            rec = h @ u
            z, r = sigmoid(table[b][:5] + rec[:5]), sigmoid(table[b][5:10] + rec[5:10])
            h = z * h + (1 - z) * np.tanh(table[b][10:] + r * rec[10:])
            out.append(h)
        return np.array(out)

    tf, uf, tb, ub, v, c = (w.astype(np.float64) for w in net.w)
    want = []
    for text in texts:
        data = text.encode()
        both = np.concatenate((states(data, tf, uf), states(data[::-1], tb, ub)[::-1]), 1)
        e = np.exp(both @ v + c)
        want.append((e / e.sum(1, keepdims=True)).mean(0))
    assert np.abs(net.probabilities([t.encode() for t in texts]) - np.array(want)).max() < 1e-5
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["a", "b", "c"], net).collect()
    for r in rows:
        assert r["lang_pred"] == "abc"[int(want[r["doc_id"]].argmax())] and abs(r["score"] - want[r["doc_id"]].max()) < 1e-5


def test_a_long_text_is_worked_off_in_pieces(monkeypatch):
    net = langid.Network(4, 5, seed=2)
    text = np.random.default_rng(3).integers(0, 256, 1000).astype(np.uint8).tobytes()
    want = net.probabilities([text, b"ab"])
    monkeypatch.setattr(langid, "SLAB", 500)
    for piece in (1, 7, 128, 300, 999, 1000, 4000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.abs(net.probabilities([b"ab", text])[::-1] - want).max() < 1e-5


def test_windows_are_cut_from_whole_texts(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc \u00e9"), n)) for n in (1, 30, 47, 48, 49, 150, 9000)]
    rows = [(None if i == 2 else i, t, "x") for i, t in enumerate(texts)]
    found = langid.sample(spark.createDataFrame([*rows, (9, None, "x"), (10, "de", None), (11, "", "x")], "doc_id long, text string, lang string"))
    assert len(found) == sum(any(c.isalpha() for c in t) for t in texts)
    whole = [t.encode() for t in texts]
    for lang, cuts in found:
        assert lang == "x" and len(cuts) == langid.WINDOWS
        for lead, part, rest in cuts:
            assert len(lead) <= langid.WARM_UP and len(part) <= langid.TRAIN_WINDOW and any(lead + part + rest in t for t in whole)
    late = [w for _, cuts in found for w in cuts if len(w[0]) == len(w[2]) == langid.WARM_UP and whole[-1].find(b"".join(w)) > 4000]
    assert late  # windows lie anywhere in a text


def test_language_accuracy(spark, sf_dir):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op6_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.predict(odd_docs, *langid.train(langid.sample(odd_docs), steps=5)).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert by[3] == by[4] == by[5] == by[10] == "und" and by[6] in ("en", "fr", "de")
    assert {r["lang_pred"] for r in langid.predict(odd_docs, *langid.train(langid.sample(no_docs))).collect()} == {"und"}


def base_score(text, counts, n, v, texts):
    w = (text or "").encode().lower().split()
    return sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[x] for x in w), texts])


def check_scores(rows, docs, training):
    counts = Counter(w for _, t in training for w in (t or "").encode().lower().split())
    n, v = sum(counts.values()) + len(training), len(counts) + (len(training) > 0)
    want = Counter((d, len((t or "").encode().lower().split()) + 1, round(base_score(t, counts, n, v, len(training)), 4)) for d, t in docs)
    assert Counter((r["doc_id"], r["n_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["train_tokens"] == n for r in rows)


def in_training(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2


def test_scores(spark, sf_dir, odd_docs, no_docs, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    monkeypatch.setattr(ctw, "FREQUENT", 50)  # most words then take the join
    rows = queries.queries()["op9_ctw"](spark, sf_dir).collect()
    check_scores(rows, docs, [x for x in docs if in_training(x[0])])
    sizes = {d: len((t or "").encode()) + 1 for d, t in docs}
    held = [r for r in rows if r["held_out"]]
    assert -sum(r["score"] for r in held) / math.log10(2) / sum(sizes[r["doc_id"]] for r in held) < 3.5  # bits a byte
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_scores(ctw.score(odd_docs, ctw.training_part(odd_docs)).collect(), odd, [x for x in odd if in_training(x[0])])
    assert ctw.score(no_docs, no_docs).count() == 0
    assert {r["n_known"] for r in ctw.score(odd_docs, no_docs).collect()} == {0}


def test_context_tree_equals_recursion():
    """Weighted probabilities against a direct recursion over the tree."""
    texts = [b"abracadabra", b"abba cab", b"banana\xc3\xa9"]
    classes = ctw._classes()
    codes, n = np.unique(ctw._codes(texts, classes)[0], return_counts=True)
    tree = ctw.ContextTree(codes, n)
    counts = dict(zip(codes.tolist(), n.tolist()))

    def kt(zero, one):
        return math.lgamma(zero + 0.5) + math.lgamma(one + 0.5) - math.lgamma(zero + one + 1) - math.log(math.pi)

    def node(depth, j, key):
        """(log KT, log weighted, P(1)) of the node with that key."""
        mask = (1 << (8 + ctw.CONTEXT_BITS[depth])) - 1
        mine = [(c, k) for c, k in counts.items() if (c & mask) >> (8 - j) == key]
        one = sum(k for c, k in mine if (c >> (7 - j)) & 1)
        zero = sum(k for _, k in mine) - one
        own = kt(zero, one)
        if depth == ctw.DEPTH:
            return own, own, (one + 0.5) / (zero + one + 1)
        deeper = (1 << (8 + ctw.CONTEXT_BITS[depth + 1])) - 1
        below = sum(node(depth + 1, j, k)[1] for k in {(c & deeper) >> (8 - j) for c, _ in mine})
        return own, np.logaddexp(own, below) - math.log(2), (one + 0.5) / (zero + one + 1)

    for code in [*codes[:6].tolist(), 0x123441]:
        log = 0.0
        for j in range(8):
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                key = (code & ((1 << (8 + ctw.CONTEXT_BITS[d])) - 1)) >> (8 - j)
                own, whole, one = node(d, j, key)
                seen = any((c & ((1 << (8 + ctw.CONTEXT_BITS[d])) - 1)) >> (8 - j) == key for c in counts)
                w = math.exp(own - math.log(2) - whole) if d < ctw.DEPTH else 1.0
                p = w * one + (1 - w) * p if seen else 0.5
            log += math.log10(p if (code >> (7 - j)) & 1 else 1 - p)
        assert abs(log - tree.log10(np.array([code], np.uint32))[0]) < 1e-9


def test_distributed_tree_equals_one_tree(spark, sf_dir, monkeypatch):
    """Scores over the deep distributed tree are those of one tree in memory; contexts of five unfolded bytes count."""
    monkeypatch.setattr(ctw, "FREQUENT_CODES", 500)  # most codes then take the join
    training = [b"Ab one two three", b"ab one twO three four", b"zz one two"] * 3
    scored = [*training[:3], b"one two new", b"", b"ab one two three"]
    frame = lambda texts: spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = ctw._classes()
    tree = ctw.ContextTree(*np.unique(ctw._codes(training, classes)[0], return_counts=True))
    for limit in (0, 20, 1000):
        monkeypatch.setattr(ctw, "FREQUENT_CODES", limit)
        got = {r["doc_id"]: r["score"] for r in ctw.score(frame(scored), frame(training)).collect()}
        assert len(got) == len(scored)
        for i, t in enumerate(scored):
            assert abs(got[i] - tree.log10(ctw._codes([t], classes)[0]).sum()) < 1e-4
    seen = ctw._codes([b"Abcdef", b"abcdef", b"Xbcdef"], classes)[0]
    assert len(np.unique(seen)) == 21 - 2  # only the three ends have equal contexts of five bytes


def test_plan_is_shortest_pack_first():
    """Room left in every pack, against placing single pieces longest first, each into the pack with the most room."""
    import random

    rng = random.Random(12)
    for _ in range(60):
        size = rng.choice([7, 16, 50])
        histogram = Counter(rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 120)))
        rooms: list[int] = []
        for length in sorted(histogram.elements(), reverse=True):
            best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if best is None or rooms[best] < length:
                rooms.append(size)
                best = len(rooms) - 1
            rooms[best] -= length
        filled, pieces = Counter(), Counter()
        for length, lo, hi, sequence, _ in packing.plan(dict(histogram), size):
            pieces[length] += hi - lo
            for i in range(hi - lo):
                filled[sequence + i] += length
        assert sorted(size - v for v in filled.values()) == sorted(rooms) and pieces == histogram


def test_states_equal_the_plain_formula_bit_for_bit():
    """op6: halving the weights once and working in place change no bit of what the network says."""
    import numpy as np

    net = langid.Network(3)
    x = np.random.default_rng(5).integers(0, 256, (30, 7)).astype(np.uint8)
    before = [w.copy() for w in net.w]
    table, u, h, half = net.w[0], net.w[1], net.h, np.float32(0.5)
    state, want = np.zeros((7, h), np.float32), []
    for row in x:
        inp, rec = table[row], state @ u
        gates = np.tanh((inp[:, : 2 * h] + rec[:, : 2 * h]) * half) * half + half
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(inp[:, 2 * h :] + r * rec[:, 2 * h :])
        state = new + z * (state - new)
        want.append(state)
    assert (net._run(x, None, table, u) == np.array(want)).all()
    assert all((a == b).all() for a, b in zip(net.w, before))
