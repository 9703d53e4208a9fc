"""Line deduplication by an exact set-similarity join of lines.

A line's tokens are its five-word shingles, as hashes; a line of one to four words is one token of all its words. Tokens
are ordered by rarity, estimated from the corpus frequency of a shingle's last word, then by hash; lines of similarity t
share a token within their prefixes of that order. Candidates meet on prefix tokens, pass length, positional and bitmap
filters, are made distinct and verified once by the exact Jaccard similarity. A line is removed when an earlier line (by
doc_id, then place in the text) has the same tokens or similar ones.

Lines with equal tokens are a class, named by two hashes of the tokens (where there is but one, of the tokens and of the words),
of which the first stands for all. A class first meets two leaders of each of its tokens, the earliest class and the one where the token stands first;
only classes without an earlier match then meet the other earlier ones. So a group of near copies costs a pair per member
and not its square, and no match is lost. Tables are written before a join on a class or token, so that the join stands
alone in its stage and a hot class or token is split among tasks (adaptive skew join). Tables that grow with the corpus are
joined by a shuffle at every size, so that what is measured on a small corpus holds for a large one.

Built-in expressions and joins only.

Defined cases: null and empty texts and lines without a word have nothing to remove; repeated rows (same doc_id and text)
are one document; equal doc_ids with different texts follow the text's hash; a null doc_id comes first; empty tables give
no row; a document that `dedup` would leave without any word is dropped, as a copy; columns other than doc_id and text
are carried, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, fence, stash, table, tidy

N_GRAM = 5  # `_with_tokens` makes it of two pairs and a word
THRESHOLD = 80  # per cent
#: Bins of the word-frequency table; each holds a class of one byte.
BINS = 1 << 13
#: Longs of a class's bitmap, in which every token sets one bit.
BITMAP = 4


def _spaced(line: Column) -> Column:
    """A line or text with its rarer separators turned into spaces, where there are any."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.when(odd, F.translate(line, "\t\r\x0b\x0c", "    ")).otherwise(line)


def _words(line: Column) -> Column:
    """Words of a line; empty ones are only looked for where spaces meet or stand at an end."""
    spaced = _spaced(line)
    split = F.split(spaced, " ")
    loose = (spaced == "") | F.startswith(spaced, F.lit(" ")) | F.endswith(spaced, F.lit(" ")) | F.contains(spaced, F.lit("  "))
    return F.when(loose, F.array_remove(split, "")).otherwise(split)


def _lines(docs: DataFrame) -> DataFrame:
    # the fence keeps the hash of the whole text below the explosion, once a text and not once a line
    split = fence(docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tk"), F.split("text", "\n").alias("lines")))
    return split.select("doc_id", "tk", F.posexplode_outer("lines").alias("line_no", "line"))


def _bin(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BINS - 1)).cast("int")


def word_classes(docs: DataFrame) -> list[int]:
    """A number for each hash bin of words: 1 to 127, growing with the logarithm of the bin's count over all texts."""
    lines = docs.select(F.explode(F.split(_spaced(F.col("text")), "\n")).alias("line"))
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).where("w != ''")
    found = [1] * BINS
    for r in words.groupBy(_bin(F.xxhash64("w")).alias("bin")).agg(F.count("w").alias("n")).collect():  # BINS rows at most
        found[r["bin"]] = min(127, 1 + int(r["n"]).bit_length() * 3)
    return found


def _with_tokens(lines: DataFrame, classes: list[int]) -> DataFrame:
    """Adds tokens, and k1 and k2, which name the class. Tokens are distinct shingles as longs, rarest first: the rarity
    class is the top byte, a hash the rest. Lines without a word go."""
    worded = fence(lines.withColumn("_w", _words(F.col("line"))).drop("line"))
    hashed = fence(worded.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")).where(F.size("_h") > 0)
    rarity = F.expr(f"array({','.join(f'{c << 56}L' for c in classes)})")
    bits = F.lit((1 << 56) - 1)
    n = F.size("_h")

    def token(four, last):
        found = F.shiftrightunsigned(F.xxhash64(four, last), 8).bitwiseOR(F.get(rarity, _bin(last)))
        return F.coalesce(found, F.lit(0).cast("long"))  # never null, and known to be so: longs without nulls are sorted as they are

    def paired(name: str, by: int) -> Column:
        """Each hash with the one `by` places on; what has none is part of no shingle."""
        return F.zip_with(name, F.slice(name, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))

    # two words, four words, five: a few calls a shingle
    paired_ = fence(hashed.withColumn("_two", paired("_h", 1)))
    paired_ = fence(paired_.withColumn("_four", paired("_two", 2)).drop("_two"))
    count = F.greatest(n - (N_GRAM - 1), F.lit(0))
    shingles = F.sort_array(F.array_distinct(F.zip_with(F.slice("_four", F.lit(1), count), F.slice("_h", F.lit(N_GRAM), count), token)))
    whole = F.array(F.xxhash64(n, "_h").bitwiseAND(bits))
    tokened = fence(paired_.withColumn("tokens", F.when(n >= N_GRAM, shingles).otherwise(whole)).drop("_four"))
    # another hash of the tokens makes an accidental meeting of the first harmless. A token alone stands for the line's first words, whose own
    # hashes also tell apart what meets in its 56 bits
    of_words = F.xxhash64(F.lit(1), F.slice("_h", F.lit(1), F.lit(N_GRAM)))
    k2 = F.when(F.size("tokens") == 1, of_words).otherwise(F.xxhash64(F.lit(1), "tokens"))
    return tokened.withColumn("k1", F.xxhash64("tokens")).withColumn("k2", k2).drop("_h")


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _may_match(x: str, y: str, threshold: int) -> Column:
    """Filters on two rows (n, pos, bits): length, position, and the tokens that only one of the bitmaps shows.

    Sets that would have to be equal are of one class, so they are no pair. The positional filter bounds what can still
    be shared from this token on. A bit of one bitmap that the other lacks is a token that is not shared: the suffix
    filter, over all tokens at once.
    """
    n1, n2, p1, p2 = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (x, y))
    need = F.ceil(threshold * (n1 + n2) / (100 + threshold) - 1e-9)

    def only(a, b):
        return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{i}")))) for i in range(BITMAP)), F.lit(0))

    lengths = (100 * n1 >= threshold * n2) & (100 * n2 >= threshold * n1) & (need < F.greatest(n1, n2))
    return lengths & (F.least(n1 - p1, n2 - p2) >= need) & (only(x, y) <= n1 - need) & (only(y, x) <= n2 - need)


def _facts(sets: DataFrame) -> DataFrame:
    """(id, n, b0, b1, ...): the number of a class's tokens and its bitmap."""
    one = F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.col("t").bitwiseAND(F.lit(63)).cast("int"))
    part = F.shiftright("t", 6).bitwiseAND(F.lit(BITMAP - 1))
    bits = [F.bit_or(F.when(part == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(BITMAP)]
    return sets.select("id", F.explode("tokens").alias("t")).groupBy("id").agg(F.count("*").cast("int").alias("n"), *bits)


def _sets(docs: DataFrame, firsts: DataFrame, classes: list[int], repeated: bool) -> DataFrame:
    """(id, tokens) of the classes in firsts (id, ord), from their first lines; repeated: whether rows of docs repeat."""
    wanted = firsts.groupBy(F.col("ord.doc_id").alias("of"), F.col("ord.tk").alias("of_tk")).agg(F.collect_list(F.struct("id", "ord.line_no")).alias("nos"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tk")).join(wanted.hint("merge"), F.expr("doc_id <=> of and tk = of_tk"))
    split = fence(texts.select("nos", F.split("text", "\n").alias("lines")))
    lines = split.select(F.explode(F.transform("nos", lambda x: F.struct(x["id"].alias("id"), F.get("lines", x["line_no"]).alias("line")))).alias("x")).select("x.*")
    found = _with_tokens(lines, classes).select("id", "tokens")
    return found.dropDuplicates(["id"]) if repeated else found


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a earlier, b) that are similar."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    mine = stash(sets.join(ends.hint("merge"), "id", "left_semi"))
    x, y = mine.select(F.col("id").alias("a"), F.col("tokens").alias("x")), mine.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= threshold * (F.size("x") + F.size("y") - same)).select("a", "b", "ord")


@tidy
def matches(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, tk, line_no, first, is_copy): the lines that go, an earlier line that they match, as (doc_id, tk, line_no),
    and whether an earlier line has the same tokens (`first` is then the earliest of these or an earlier similar one)."""
    classes = word_classes(docs)
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - _ceil_div(n * threshold, 100) + 1)
    # sets of fewer than four tokens are only similar to equal ones (3 of 4 is below the threshold)
    least = -(-threshold // (100 - threshold))
    lines = stash(
        _with_tokens(_lines(docs), classes).select("doc_id", "tk", "line_no", "k1", "k2", F.when(n >= least, prefix).alias("prefix"))
    )
    ord_ = F.struct("doc_id", "tk", "line_no")
    # a class is a number from here on, and its tokens are dealt out once, however many copies it has
    firsts = lines.groupBy("k1", "k2").agg(F.min(F.struct(ord_.alias("ord"), "prefix")).alias("f"), F.count("*").alias("copies"))
    firsts = stash(firsts.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "f.ord", "copies", "f.prefix"))
    whole, lines = lines, stash(lines.select("doc_id", "tk", "line_no", "k1", "k2"))
    discard(whole)
    of_text = lines.groupBy("doc_id", "tk").agg(F.count("*").alias("c"), F.collect_set("line_no").alias("nos"))
    repeated = not of_text.where(F.col("c") > F.size("nos")).isEmpty()
    tokens = firsts.where("prefix is not null").select("id", F.posexplode("prefix").alias("pos", "token"))
    # written, so that what is shuffled for it is gone before all tokens are shuffled once more
    met = stash(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    shared = stash(tokens.join(met.hint("merge"), "token").select("token", "id", "pos"))  # tokens of two classes at least
    in_reach = stash(firsts.join(shared.select("id").distinct(), "id", "left_semi").select("id", "ord"))
    sets = stash(_sets(docs, in_reach, classes, repeated))
    facts = in_reach.join(_facts(sets), "id")
    placed = stash(shared.join(facts, "id"))
    discard(met), discard(shared), discard(in_reach)

    names = ("ord", "id", "n", "pos", *(f"b{i}" for i in range(BITMAP)))
    leaders = placed.groupBy("token").agg(F.min(F.struct(*names)).alias("early"), F.min(F.struct("pos", *[c for c in names if c != "pos"])).alias("front"))
    sides = [F.struct(*[F.col(f"{side}.{c}").alias(c) for c in names]) for side in ("early", "front")]
    leaders = stash(leaders.select("token", F.explode(F.array_distinct(F.array(*sides))).alias("l")).select("token", "l.*"))
    p, l = placed.alias("p"), leaders.alias("l")
    before = F.col("l.ord") < F.col("p.ord")
    first = stash(
        p.join(l, F.col("p.token") == F.col("l.token")).where((F.col("p.id") != F.col("l.id")) & _may_match("p", "l", threshold)).select(
            F.when(before, F.col("l.id")).otherwise(F.col("p.id")).alias("a"), F.when(before, F.col("p.id")).otherwise(F.col("l.id")).alias("b"),
            F.least("p.ord", "l.ord").alias("ord"),
        ).distinct()
    )
    found = stash(_verified(first, sets, threshold))

    # a pair one of which leads a token has met there already; at the first token they share, no other filter hides it
    rest = stash(placed.join(leaders.select("token", "id"), ["token", "id"], "left_anti"))
    discard(placed), discard(leaders)
    open_ = rest.join(found.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    y, x = open_.alias("y"), rest.alias("x")
    second = (
        y.join(x, F.col("x.token") == F.col("y.token")).where((F.col("x.ord") < F.col("y.ord")) & _may_match("x", "y", threshold))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.ord").alias("ord")).distinct()
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    found = found.union(_verified(stash(second), sets, threshold))

    matched = found.groupBy(F.col("b").alias("id")).agg(F.min("ord").alias("match"))
    gone = firsts.join(matched, "id", "left").where((F.col("copies") > 1) | F.col("match").isNotNull())
    gone = stash(gone.select("k1", "k2", "ord", "match"))
    is_copy = ord_ != F.col("ord")
    return (
        lines.select("doc_id", "tk", "line_no", "k1", "k2").join(gone, ["k1", "k2"])
        .where(F.col("match").isNotNull() | is_copy)
        .select("doc_id", "tk", "line_no", F.coalesce("match", "ord").alias("first"), is_copy.alias("is_copy")).distinct()
    )


def dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with the matching lines taken out of their texts; documents left without a word by that are dropped."""
    gone = stash(matches(docs, threshold).groupBy(F.col("doc_id").alias("of"), F.col("tk").alias("of_tk")).agg(F.collect_set("line_no").alias("gone")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("tk"))
    joined = rows.join(gone.hint("merge"), F.expr("id <=> of and tk = of_tk"), "left")
    split = fence(joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split("text", "\n")).alias("lines")))
    # the numbers of the lines that stay come from one pass over a hash set, so a text of many lines costs no more than its length
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    cut = fence(split.select("row", F.when(F.col("gone").isNotNull(), F.transform(stay, lambda i: F.get("lines", i))).alias("kept")))
    more = fence(cut.withColumn("more", F.exists("kept", lambda l: F.size(_words(l)) > 0))).where("more is null or more")
    text = F.coalesce(F.array_join("kept", "\n"), F.col("row")["text"])
    return more.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "is_copy")


ORACLE = f"""
with d as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text is not null
), l as (
  select doc_id, unnest(range(0, len(ls))) as line_no, list_filter(string_split_regex(unnest(ls), '[\\x20\\x09\\x0B-\\x0D]+'), lambda w: w <> '') as w from d
), t as (
  select doc_id, line_no, doc_id * 100000000 + line_no as pos, list_sort(list_distinct(case when len(w) < {N_GRAM} then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - {N_GRAM - 2}), lambda i: array_to_string(w[i:i + {N_GRAM - 1}], ' ')) end)) as s
  from l where len(w) > 0
), c as (
  select s, min(pos) as first, any_value(len(s)) as n from t group by s
), p as (
  select first, n, unnest(s) as g from c
), m as (
  select distinct b from (
    select b.first as b from p a join p b on a.g = b.g and a.first < b.first
    group by a.first, b.first, a.n, b.n having 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*)))
)
select t.doc_id, t.line_no::bigint as line_no, t.pos > c.first as is_copy
from t join c on t.s = c.s left join m on m.b = c.first where t.pos > c.first or m.b is not null
"""
