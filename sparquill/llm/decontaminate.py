"""Benchmark decontamination: SimHash fingerprints of item-sized windows, met within a Hamming radius, then verified.

Shingles are five lower-cased words (an item of fewer words is one shingle). A window that is similar to an item lacks at
most a fifth of the item's weight, so it has one of the item's prefix: its rarest shingles, taken until they weigh more
than that. Only a document with a prefix shingle is looked at for that item, so wording that many items share brings
no document and item together. In such a document, windows are laid for the item wherever one of its shingles stands: of the item's length, placed
as the shingle stands in the item, moved inside the text at its ends. Windows and items get 64-bit SimHash
fingerprints; these are cut into RADIUS + 1 blocks, of which two fingerprints within RADIUS agree in one at least, so
the join on blocks finds every pair within the radius. With four blocks of 16 bits, two unlike fingerprints meet once in
16,000 pairs, so the join stays far below windows x items. Few shingles make fingerprints of similar texts stand further
apart than the radius, so a window's own items, those it was laid for, are candidates at any distance: no similar pair is
missed, as similarity needs a shared shingle. Each candidate pair is verified once by the exact weighted Jaccard
similarity of the shingle multisets; a shingle's weight falls with the number of items that have it.

`ways` says which candidates are verified: "fingerprints" those within the radius, "anchors" a window's own items, "both". A
similarity of 0.8 turns about a seventh of a fingerprint's bits whatever the length of the item, which no radius with selective
blocks reaches, so fingerprints alone find exact and very near copies; `recall` counts what each way finds, by the item's length.

Built-in expressions and joins only. The benchmark travels to every task only below a checked number of bytes.

Defined cases: null and empty texts and items match nothing; a text shorter than an item is one window; repeated rows
are found once per (doc_id, item_id); equal doc_ids with different texts count as one document, a null doc_id as
another; null or equal item_ids likewise; empty tables give no row; other columns of the inputs are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fence, lower_ascii, small, stash, table, tidy, words

N_GRAM = 5
SIMILARITY = 0.8
RADIUS = 3


def _grams(hashes: str, k: int) -> Column:
    """Hashes of the k-word shingles in text order, from the words' hashes."""
    several = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(hashes, i + j) for j in range(1, k)]),
    )
    return several


def _hashed(df: DataFrame, *keep) -> DataFrame:
    return fence(df.select(*keep, F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("_h")))


def items(benchmark: DataFrame, n: int = N_GRAM) -> DataFrame:
    """(item_id, n_words, k, off, gram) of every item with a word; k words make its shingles."""
    base = _hashed(benchmark, "item_id").withColumn("n_words", F.size("_h")).where("n_words > 0")
    parts = [
        base.where(F.col("n_words") >= n if k == n else F.col("n_words") == k).select("item_id", "n_words", F.lit(k).alias("k"), F.posexplode_outer(_grams("_h", k)).alias("off", "gram"))
        for k in range(1, n + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _fingerprint(exploded: DataFrame, *key: str) -> DataFrame:
    """(key, fp, weight): SimHash of the weighted shingles (gram, c, w) of each key, and their total weight."""
    bits = [F.sum(F.col("cw") * (2 * F.shiftright("gram", b).bitwiseAND(F.lit(1)) - 1)) for b in range(64)]
    sums = exploded.withColumn("cw", F.col("c") * F.col("w")).groupBy(*key).agg(F.sum("cw").alias("weight"), *[s.alias(f"b{b}") for b, s in enumerate(bits)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.shiftleft((F.col(f"b{b}") > 0).cast("long"), b))
    return sums.select(*key, "weight", fp.alias("fp"))


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each of the radius + 1 blocks of the fingerprint."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    parts = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    return df.select("*", F.inline(F.array(*parts)))


def prefixes(of_items: DataFrame, similarity: float) -> DataFrame:
    """(item_id, gram): the rarest shingles of each item, of which anything similar to it has one. What lacks them all lacks
    more than 1 - similarity of the item's weight. An item_id with texts of several lengths keeps all its shingles."""
    item = Window.partitionBy("item_id")
    before = item.orderBy(F.desc("w"), "gram").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("c") * F.col("w")
    marked = of_items.select(
        "item_id", "gram", F.coalesce(F.sum(weight).over(before), F.lit(0)).alias("_before"), F.sum(weight).over(item).alias("_all"),
        (F.min("n_words").over(item) != F.max("n_words").over(item)).alias("_several"),
    )
    return marked.where(F.col("_several") | (F.col("_before") <= (1 - similarity + 1e-9) * F.col("_all"))).select("item_id", "gram").distinct()


@tidy
def find(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, radius: int = RADIUS, ways: str = "both") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, n_windows) of every contaminated document: its best window."""
    found = _found(docs, benchmark, n, similarity, radius, ways)
    return found.drop("by_fingerprints")


def _found(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, radius: int = RADIUS, ways: str = "both") -> DataFrame:
    """The rows of `find`, and whether a window's fingerprint leads to the item: what the fingerprints alone would find."""
    if ways not in ("both", "fingerprints", "anchors"):
        raise ValueError(f"no way {ways!r}")
    item_grams = stash(items(benchmark, n).groupBy("item_id", "n_words", "k", "gram").agg(F.count("*").alias("c"), F.collect_list("off").alias("offs")))
    n_items = item_grams.select("item_id").distinct().count()
    # whole-number weights keep the sums exact in any order: 16 for a shingle of every item, more for rarer ones
    most = round(16 * (1 + math.log(1 + n_items)))
    weights = stash(item_grams.groupBy("gram").agg(F.round(16 * (1 + F.log(F.lit(1.0 + n_items) / (1 + F.count("*"))))).cast("long").alias("w")))
    ks = sorted(r["k"] for r in item_grams.select("k").distinct().collect())  # n of them at most
    key = ["doc_id", "text_hash"]
    if not ks:
        ks = [n]

    def doc_grams(rows: DataFrame) -> DataFrame:
        return _hashed(rows, *key).select(*key, F.size("_h").alias("n_doc"), *[_grams("_h", k).alias(f"g{k}") for k in ks])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    def stand(hashed: DataFrame) -> DataFrame:
        placed = None
        for k in ks:
            part = hashed.select(*key, "n_doc", F.posexplode_outer(f"g{k}").alias("pos", "gram"))
            placed = part if placed is None else placed.union(part)
        return placed

    of_items = stash(item_grams.select("item_id", "n_words", "k", "gram", "c").join(weights, "gram"))
    reach = stash(stand(doc_grams(texts)).join(small(stash(prefixes(of_items, similarity))), "gram").select(*key, "item_id").distinct())
    # the shingles of the few documents that an item reaches
    found = stash(reach.select(*key).distinct())
    chosen = texts.join(small(found), key_null_safe(texts, found, key), "left_semi")
    shingles = stash(doc_grams(chosen).dropDuplicates(key))
    i, r = item_grams.select(F.col("item_id").alias("of"), F.col("gram").alias("g"), "k", "n_words", "offs"), reach.alias("r")
    sought = r.join(small(i), F.expr("r.item_id <=> of")).select(F.col("r.doc_id").alias("d"), F.col("r.text_hash").alias("h"), "item_id", "g", "k", "n_words", "offs")
    anchors = stand(shingles).join(sought, F.expr("doc_id <=> d and text_hash = h and gram = g"))
    at = F.explode(F.transform("offs", lambda o: F.col("pos") - o)).alias("start")
    spots = anchors.select(*key, "item_id", "k", "n_doc", F.least("n_words", "n_doc").alias("len"), at)
    laid = stash(
        spots.select(*key, "k", "len", F.greatest(F.lit(0), F.least("start", F.col("n_doc") - F.col("len"))).alias("start"), "item_id").distinct()
    )
    named = stash(laid.select(*key, "k", "len", "start").distinct().withColumn("wid", F.monotonically_increasing_id()))
    pieces = F.expr("case k " + " ".join(f"when {k} then slice(g{k}, start + 1, greatest(len - {k - 1}, 0))" for k in ks) + " end")
    w = named.alias("w")
    s = shingles.alias("s")
    in_windows = (
        w.join(s, F.expr("w.doc_id <=> s.doc_id and w.text_hash = s.text_hash"))
        .select("wid", F.explode(pieces).alias("gram")).groupBy("wid", "gram").agg(F.count("*").alias("c"))
        .join(small(weights), "gram", "left").withColumn("w", F.coalesce("w", F.lit(most)))
    )
    in_windows = stash(in_windows)
    window_fp = stash(_fingerprint(in_windows, "wid"))
    item_fp = stash(_fingerprint(of_items, "item_id"))
    a, b = _blocks(window_fp, radius).alias("a"), small(_blocks(item_fp, radius)).alias("b")
    near = (
        a.join(b, F.expr(f"a.block = b.block and a.value = b.value and bit_count(a.fp ^ b.fp) <= {radius}"))
        .select("wid", "item_id", F.col("a.weight").alias("wa"), F.col("b.weight").alias("wb"))
    )
    l, m = laid.alias("l"), named.alias("m")
    pairs = l.join(m, F.expr("l.doc_id <=> m.doc_id and l.text_hash = m.text_hash and l.k = m.k and l.len = m.len and l.start = m.start")).select("wid", "item_id")
    of_item = item_fp.select(F.col("item_id").alias("of"), F.col("weight").alias("wb"))
    anchored = (
        pairs.join(window_fp.select("wid", F.col("weight").alias("wa")), "wid")
        .join(small(of_item), F.expr("item_id <=> of")).select("wid", "item_id", "wa", "wb")
    )
    near, anchored = (c.withColumn("met", F.lit(met)) for c, met in ((near, True), (anchored, False)))
    candidates = {"fingerprints": near, "anchors": anchored, "both": near.union(anchored)}[ways]
    candidates = stash(candidates.groupBy("wid", "item_id", "wa", "wb").agg(F.max("met").alias("met")))
    shared = (
        candidates.join(in_windows, "wid").alias("x")
        .join(small(of_items.select(F.col("item_id").alias("of"), F.col("gram").alias("g"), F.col("c").alias("ci"))), F.expr("item_id <=> of and gram = g"))
        .groupBy("wid", "item_id", "wa", "wb", "met").agg(F.sum(F.least("c", "ci") * F.col("w")).alias("both"))
        .withColumn("similarity", F.col("both") / (F.col("wa") + F.col("wb") - F.col("both")))
        .where(F.col("similarity") >= similarity)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "len")).alias("b")
    return (
        shared.join(named.select("wid", "doc_id", "start", "len"), "wid")
        .groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_windows"), F.max("met").alias("by_fingerprints"))
        .select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).cast("long").alias("start_word"), F.col("b.len").cast("long").alias("n_words"), "n_windows", "by_fingerprints")
    )


def key_null_safe(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & a[k].eqNullSafe(b[k])
    return on


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found."""
    bad = find(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


@tidy
def recall(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(n_words, n_pairs, n_by_fingerprints): contaminated pairs by the number of the item's words, and how many of them the
    fingerprints alone find."""
    every = stash(_found(docs, benchmark, **options).select("item_id", "by_fingerprints")).alias("e")
    sizes = benchmark.select("item_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).dropDuplicates(["item_id"]).alias("z")
    sized = every.join(sizes, F.expr("e.item_id <=> z.item_id"))
    return sized.groupBy("z.n_words").agg(F.count("*").alias("n_pairs"), F.count_if("by_fingerprints").alias("n_by_fingerprints"))


def decontamination_recall(spark, sf_dir: str) -> DataFrame:
    return recall(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
with it as (
  select item_id, w, len(w) as n_words, least({N_GRAM}, len(w)) as k from (select item_id, {_SQL_WORDS} as w from benchmark) where len(w) > 0
), d as (
  select doc_id, w, len(w) as n_doc from (select doc_id, {_SQL_WORDS} as w from (select distinct doc_id, text from documents)) where len(w) > 0
), io as (
  select item_id, n_words, k, off, array_to_string(w[off + 1:off + k], ' ') as gram from (select *, unnest(range(0, n_words - k + 1)) as off from it)
), ig as (
  select item_id, n_words, k, gram, count(*) as c from io group by all
), n as (
  select count(distinct item_id) as n from it
), wt as (
  select k, gram, round(16 * (1 + ln((1.0 + any_value(n)) / (1 + count(*))))) as w from ig, n group by k, gram
), dg as (
  select doc_id, n_doc, k, pos, array_to_string(w[pos + 1:pos + k], ' ') as gram
  from (select *, unnest(range(0, n_doc - k + 1)) as pos from d, (select distinct k from it))
), laid as (
  select distinct doc_id, item_id, k, least(n_words, n_doc) as size, greatest(0, least(pos - off, n_doc - least(n_words, n_doc))) as start
  from dg join io using (k, gram)
), ww as (
  select l.doc_id, l.k, l.size, l.start, dg.gram, count(*) as c from (select distinct doc_id, k, size, start from laid) l
  join dg on dg.doc_id = l.doc_id and dg.k = l.k and dg.pos between l.start and l.start + l.size - l.k group by all
), wg as (
  select ww.*, coalesce(wt.w, round(16 * (1 + ln(1.0 + n)))) as w from ww cross join n left join wt using (k, gram)
), wa as (
  select doc_id, k, size, start, sum(c * w) as wa from wg group by all
), wb as (
  select item_id, sum(c * w) as wb from ig join wt using (k, gram) group by item_id
), s as (
  select laid.doc_id, laid.item_id, laid.size, laid.start, sum(least(wg.c, ig.c) * wg.w) as common
  from laid join wg using (doc_id, k, size, start) join ig on ig.item_id = laid.item_id and ig.k = laid.k and ig.gram = wg.gram group by all
), m as (
  select s.doc_id, s.item_id, s.start, s.size, common / (wa + wb - common) as similarity from s join it using (item_id) join wa using (doc_id, k, size, start) join wb using (item_id)
)
select doc_id, item_id, round(max(similarity), 6) as similarity, min_by(start, (-similarity, start, -size))::bigint as start_word,
       min_by(size, (-similarity, start, -size))::bigint as n_words, count(*) as n_windows
from m where similarity >= {SIMILARITY} group by doc_id, item_id
"""
