import random
import re
from collections import Counter, defaultdict

import pytest
from compare import same
from pyspark.sql import functions as F

from sparquill.llm import decontaminate, jaccard_join, linededup, queries, quality
from sparquill.llm._common import components, global_rank

WORDS = [a + b for a in "ba be bi bo bu ca ce ci".split() for b in "la le lo na no ra ru ta".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts, with exact and near copies and shared lines."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        texts.append("\n".join(text(rng, rng.choice([3, 6, 12, 40])) for _ in range(rng.randrange(1, 6))))
    for t in texts[:12]:
        texts += [t, edited(rng, t.replace("\n", " "), 1), edited(rng, t.replace("\n", " "), 2)]
    line = text(rng, 60)
    texts += [text(rng, 30) + "\n" + edited(rng, line, k % 3) + "\n" + text(rng, 9) for k in range(9)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = same(duck, queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])
    assert got == want and len(got) > 0


def test_quality_odd_rows(odd_docs, no_docs):
    out = quality.apply_policy(quality.ledger(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_words"] == 0 and by[5][0]["base_failed"] and not by[4][0]["kept"]
    assert any(r["n_words"] == 20000 and r["n_repeat_words"] == 20000 for r in by[8])
    assert by[9][0]["n_dup_lines"] == 2
    assert quality.ledger(no_docs).count() == 0
    assert quality.keep_good(odd_docs).columns == odd_docs.columns


def test_quality_ablation(odd_docs):
    led = quality.ledger(odd_docs)
    masks = [r["fail_mask"] for r in led.collect()]
    policy = quality.POLICIES["v1"]
    for r in quality.ablate(led).collect():
        bit = quality.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(m & bit) for m in masks)
        assert r["n_only"] == sum((m & policy) == bit for m in masks)
        assert r["n_kept_without"] == sum((m & policy & ~bit) == 0 for m in masks)


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(min(1, len(w)), len(w) - n + 1)))


def brute_components(rows, n, threshold):
    sets = {i: shingles(t, n) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n, threshold", [(4, 85), (5, 80), (2, 60)])
def test_join_equals_brute_force(corpus, n, threshold):
    rows, docs = corpus
    got = {r["doc_id"]: r for r in jaccard_join.join(docs, n, threshold).collect()}
    assert {i: got[i]["component_id"] for i in got} == brute_components(rows, n, threshold)
    assert all(got[i]["n_shingles"] == len(shingles(t, n)) for i, t in rows)


def test_join_odd_rows(odd_docs, no_docs):
    out = jaccard_join.join(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add(r["component_id"])
    assert by[2] == {1} and by[3] == {3} and by[7] == {6} and by[None] == {None} and by[8] == {1, 8}
    assert jaccard_join.join(no_docs).count() == 0
    kept = [r["doc_id"] for r in jaccard_join.keep_one(odd_docs).collect()]
    assert 1 in kept and 2 not in kept and 3 in kept and 7 not in kept and kept.count(None) == 2


def line_tokens(line, n=5):
    w = [x for x in re.split("[ \t\x0b\x0c\r]", line) if x]
    return frozenset(tuple(w[j : j + n]) for j in range(max(min(1, len(w)), len(w) - n + 1)))


def brute_lines(rows, threshold=80):
    """{(doc_id, line_no): (places of the similar earlier lines, places of the equal ones)} of the lines that go."""
    lines = [((i, k), line_tokens(line)) for i, t in sorted(rows) for k, line in enumerate(t.split("\n"))]
    gone, having = {}, defaultdict(list)  # lines that share no token are not similar
    for p, (at, s) in enumerate(lines):
        met = {q for g in s for q in having[g]}
        similar = {lines[q][0] for q in met if 100 * len(s & lines[q][1]) >= threshold * len(s | lines[q][1])}
        if similar:
            gone[at] = similar, {lines[q][0] for q in met if lines[q][1] == s}
        for g in s:
            having[g].append(p)
    return gone


def check_lines(rows, found):
    want = brute_lines(rows)
    got = {(r["doc_id"], r["line_no"]): r for r in found}
    assert len(got) == len(found) and set(got) == set(want) and want
    for at, (similar, equal) in want.items():
        assert (got[at]["first"]["doc_id"], got[at]["first"]["line_no"]) in similar
        assert got[at]["is_copy"] == bool(equal)


def test_line_dedup_equals_brute_force(corpus):
    rows, docs = corpus
    check_lines(rows, linededup.matches(docs).collect())


def test_line_dedup_equals_brute_force_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_lines([(r["doc_id"], r["text"]) for r in docs.collect() if r["text"]], linededup.matches(docs).collect())


def test_line_tokens_are_longs_that_sort_as_they_are(spark):
    """op10: a set of tokens is known to hold no null; classes are named by it, and by the first words where a token is alone."""
    lines = ["a b c d e", "a b c d e f", "A b c d e", "w w w w w", "w w w w w w w", "w w w w", "a  b\tc d e", "x y z", "a b c d e f a b c d e f", "b c d e f a b c d e f a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    found = linededup._with_tokens(rows, [1] * linededup.BINS)
    assert not found.schema["tokens"].dataType.containsNull
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(lines) and all(list(r["tokens"]) == sorted(set(r["tokens"])) for r in got.values())
    same = {(i, j) for i in got for j in got if i < j and got[i]["tokens"] == got[j]["tokens"]}
    assert same == {(i, j) for i in got for j in got if i < j and (got[i]["k1"], got[i]["k2"]) == (got[j]["k1"], got[j]["k2"])}
    assert {(0, 6), (3, 4)} <= same and (3, 5) not in same and got[0]["k2"] != got[2]["k2"]


def test_line_dedup_deals_out_numbered_classes_once(spark, monkeypatch):
    """op10: tokens go with the number of their class, once for all its copies, and the table of all prefixes is gone before texts
    are read again; repeated rows and loose spaces change nothing."""
    import os

    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, body), (2, f" {body}  "), (2, f" {body}  "), (3, f"{body} end"), (3, f"{body} end"), (4, f"a  b\n\n{body}\tend"), (5, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written, seen = [], []
    real = linededup.stash

    def spy(df):
        out = real(df)
        written.append((df.columns, out._stashed_at.removeprefix("file://"), out.count()))
        if df.columns == ["id", "tokens"]:
            seen.append((out.count(), [c for c, path, _ in written if "prefix" in c and "doc_id" in c and os.path.exists(path)]))
        return out

    monkeypatch.setattr(linededup, "stash", spy)
    got = {(r["doc_id"], r["line_no"], r["is_copy"]) for r in linededup.matches(docs).collect()}
    assert got == {(2, 0, True), (3, 0, False), (4, 2, True)}
    assert seen[0] == (2, []) and any(c == ["token", "id", "pos"] for c, _, _ in written)
    prefix = next(n for c, _, n in written if "prefix" in c and "id" in c)
    assert prefix == 4  # classes, and not their eight lines


def test_line_dedup_removes_short_boilerplate(spark):
    rows = [(i, f"unique words number {i} {i * i}\nAll rights reserved.\nShare this") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.matches(docs).count() == 98
    assert linededup.dedup(docs).where("text like '%reserved%'").count() == 1


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    out = linededup.dedup(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[9].count("line one") == 1
    assert by[3] is None and by[4] == "" and by[6] == "one two" and 7 not in by
    texts = [r["text"] for r in rows if r["text"] and r["text"].startswith("the quick")]
    assert len(texts) == 1  # the copies hold nothing else
    assert linededup.dedup(no_docs).count() == 0
    clash = odd_docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_d", "_t", "_gone", "_kept", "_more", "row", "id", "tk", "of", "of_tk", "gone", "kept", "more", "k1")])
    assert linededup.dedup(clash).columns == clash.columns and linededup.dedup(clash).count() == len(rows)


def test_line_dedup_of_a_text_of_many_lines(spark):
    """Half a million lines of which every second one repeats: the cut is linear in them."""
    import time

    n = 500_000
    long = "\n".join(f"line number {i} of this text" if i % 2 else "all of these are the same line" for i in range(n))
    docs = spark.createDataFrame([(1, long), (2, "a text of its own, with a few more words")], "doc_id long, text string")
    began = time.time()
    (text,) = [r["text"] for r in linededup.dedup(docs).collect() if r["doc_id"] == 1]
    assert text.count("\n") == n // 2 and text.count("the same line") == 1
    assert time.time() - began < 120


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    items = [(i, text(rng, n)) for i, n in enumerate([3, 5, 12, 30, 60])]
    rows = []
    for i in range(30):
        t = text(rng, 80)
        item = items[i % 5][1]
        if i < 15:
            t = text(rng, 10) + " " + (item if i < 10 else edited(rng, item, 1)).upper() + " " + text(rng, 10)
        rows.append((i, t))
    rows += [(40, items[3][1]), (41, " ".join(items[4][1].split()[:20])), (42, None), (43, "")]
    return items, rows, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")


def test_decontamination_equals_brute_force(leaks):
    import math

    items, rows, benchmark, docs = leaks
    low = lambda t: (t or "").lower().split()
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    df = Counter()
    for _, t in items:
        df.update(grams(low(t), min(5, len(low(t)))).keys())
    weight = lambda g: round(16 * (1 + math.log((1 + len(items)) / (1 + df[g]))))
    want = {}
    for i, t in rows:
        w = low(t)
        for j, it in items:
            iw = low(it)
            k, m = min(5, len(iw)), min(len(iw), len(w))
            ig = grams(iw, k)
            for s in range(max(len(w) - m, -1) + 1):
                wg = grams(w[s : s + m], k)
                both = sum(min(c, ig[g]) * weight(g) for g, c in wg.items())
                total = sum(c * weight(g) for g, c in wg.items()) + sum(c * weight(g) for g, c in ig.items()) - both
                if total and both / total >= 0.8:
                    want[i, j] = max(want.get((i, j), 0), round(both / total, 6))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(docs, benchmark).collect()}
    assert got == want and len(want) >= 11


def test_decontamination_finds_short_near_copies(spark):
    """One end word of an item changed: similar to 0.8 or more, however far apart the fingerprints are."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))) for i, n in enumerate([14, 16, 18, 20] * 15)]
    rows = [(i, f"{text(rng, 20)} {t.rsplit(' ', 1)[0]} changed {text(rng, 20)}") for i, t in items]
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i, _ in items}


def test_decontamination_of_items_with_shared_wording(spark):
    """Items that share most of their wording: only a document with an item's own part is looked at for it, none is lost."""
    rng = random.Random(8)
    stem = "which of the following statements about the passage above is true and why"
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(9)) for _ in range(60)]
    items = [(i, f"{stem} {o}") for i, o in enumerate(own)] + [(100, stem), (101, stem + " one"), (101, own[0] + " " + own[1])]
    rows = [(i, f"{text(rng, 15)} {stem} {o.rsplit(' ', 1)[0]} changed {text(rng, 15)}") for i, o in enumerate(own[:20])]
    rows += [(i, f"{text(rng, 15)} {stem} {text(rng, 15)}") for i in range(20, 40)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark).collect()}
    assert {p for p in found if p[1] < 100} == {(i, i) for i in range(20)}
    assert {p for p in found if p[1] == 100} == {(i, 100) for i in range(40)}


@pytest.mark.parametrize("seed", range(4))
def test_a_similar_window_has_a_prefix_shingle(spark, seed):
    """Against all windows there are, of items over few shingles with weights and repeats drawn at random."""
    rng = random.Random(seed)
    weights = {g: rng.randrange(1, 60) for g in range(12)}
    bags = [Counter(rng.choices(range(12), k=rng.randrange(1, 10))) for _ in range(40)]
    rows = [(i, 9, g, c, weights[g]) for i, bag in enumerate(bags) for g, c in bag.items()]
    kept = {}
    for r in decontaminate.prefixes(spark.createDataFrame(rows, "item_id int, n_words int, gram int, c long, w long"), 0.8).collect():
        kept.setdefault(r["item_id"], set()).add(r["gram"])
    total = lambda bag: sum(c * weights[g] for g, c in bag.items())
    for window in [*bags, *(Counter(rng.choices(range(12), k=rng.randrange(1, 10))) for _ in range(300)), *(b - Counter([min(b)]) for b in bags)]:
        for i, bag in enumerate(bags):
            both = total(window & bag)
            if both and both >= 0.8 * (total(window) + total(bag) - both):
                assert kept[i] & set(window)
    assert sum(map(len, kept.values())) < len(rows)


def test_decontamination_by_either_way(leaks):
    """Fingerprints alone find the exact copies and some of the others, anchors all; the counts by length say so."""
    items, rows, benchmark, docs = leaks
    pairs = lambda **o: {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark, **o).collect()}
    every, near = pairs(), pairs(ways="fingerprints")
    assert pairs(ways="anchors") == every and near <= every and len(near) >= 0.6 * len(every)
    assert {(i, i % 5) for i in range(10)} <= near  # exact copies in other case
    counts = {r["n_words"]: (r["n_pairs"], r["n_by_fingerprints"]) for r in decontaminate.recall(docs, benchmark).collect()}
    sizes = {i: len(t.split()) for i, t in items}
    want = {n: (sum(sizes[j] == n for _, j in every), sum(sizes[j] == n for _, j in near)) for n in {sizes[j] for _, j in every}}
    assert counts == want
    with pytest.raises(ValueError):
        decontaminate.find(docs, benchmark, ways="none")


def test_recall_searches_once(spark, monkeypatch):
    """what the fingerprints alone find is told by the one search that finds every pair."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b c {text} d e f"), (2, text.replace("w20 ", "x ")), (3, "nothing of it")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    calls, items = [], decontaminate.items
    monkeypatch.setattr(decontaminate, "items", lambda *a: calls.append(1) or items(*a))
    assert [tuple(r) for r in decontaminate.recall(docs, benchmark).collect()] == [(40, 2, len(decontaminate.find(docs, benchmark, ways="fingerprints").collect()))]
    assert len(calls) == 2  # one of them is that of the comparison


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(odd_docs, items).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (8, 1), (6, 4), (7, 4)}
    assert decontaminate.find(no_docs, items).count() == 0
    assert decontaminate.find(odd_docs, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 9, 10]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 60), (60, 55)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in range(41)) and got[55] == got[60] == 50


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("same"))
    assert all(r["v"] == r["rank"] for r in global_rank(df, "same", "v").collect())


def test_tidy_leaves_its_result_only(spark):
    import os

    from sparquill.llm._common import discard, shared_dir, stash, tidy

    held = lambda: {x for x in os.listdir(shared_dir(spark)) if x.startswith("sparquill-")}
    before = held()
    out = tidy(lambda: stash(stash(spark.range(5)).where("id > 1")).where("id > 2"))()
    assert out.count() == 2 and len(held() - before) == 1
    discard(out)
    discard(spark.range(3))
    assert held() == before
    with pytest.raises(ZeroDivisionError):
        tidy(lambda: [stash(spark.range(5)), 1 / 0])()
    assert held() == before
