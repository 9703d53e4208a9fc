"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied to the stored bits.

`ledger` gives each document its measurements and `fail_mask`, where bit i is set when RULES[i] failed; `stored` writes it.
A policy is a mask of rules; `apply_policy` and `ablate` read only the ledger, so over a stored one a new policy or an
ablation never reads a text again.

Defined cases: a null text has no words and counts as empty; an empty text fails `few_words`; repeated rows and equal
doc_ids each keep a row of their own; an empty table gives an empty ledger; columns of the input whose names clash with
the ledger's are not read, apart from doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATOR_CHARS, fence, stash, table, words

SYMBOLS = "#*$%&|<>"

#: (name, condition under which it fails, as SQL over the measurements); the place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 100000"),
    ("short_words", "10 * word_chars < 25 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_letters", "10 * n_letter_words < 8 * n_words"),
    ("shouting", "10 * n_upper > 5 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: a document is kept when none of the policy's rules failed.
POLICIES = {
    "base": BASE,
    "v1": sum(BIT.values()),
    "v1_lenient": sum(BIT.values()) & ~BIT["shouting"] & ~BIT["repeated_lines"],
    "corpus": sum(BIT.values()) & ~BIT["many_words"],  # length alone is no reason to leave a text out
}


def _placed(grams: Column) -> Column:
    """(hash, place) of the windows, sorted; null when no window occurs twice."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), placed)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_mask of every document. One narrow pass of built-in expressions, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("_text"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SEPARATOR_CHARS)) != "")
    bare = F.translate("_text", SEPARATOR_CHARS, "")
    hashed = base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        lines.alias("_l"),
        F.size(F.filter("_w", lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # xxhash64 of three words' hashes stands for the window; 64 bits within one text
    grams = F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)),
    )
    with_grams = hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_letter_words",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        grams.alias("_g"),
    )
    sorted_ = with_grams.withColumn("_s", _placed(F.col("_g"))).drop("_g")
    again = F.sort_array(
        F.transform(
            F.filter(
                "_s",
                lambda x, i: (x["g"] == F.get("_s", i - 1)["g"]) | (x["g"] == F.get("_s", i + 1)["g"]),
            ),
            lambda x: x["i"],
        )
    )
    placed = sorted_.withColumn("_p", F.when(F.col("_s").isNotNull(), again)).drop("_s")
    # each window covers three words, less what the next repeated window covers already
    cover = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    measured = placed.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_p")
    mask = sum((F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return fence(measured.withColumn("fail_mask", mask))  # so that filters on the ledger stay above it


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder."""
    return stash(ledger(docs))


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept under the named policy."""
    return led.withColumn("base_failed", F.col("fail_mask").bitwiseAND(F.lit(BASE)) != 0).withColumn(
        "kept", F.col("fail_mask").bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0
    )


def ablate(led: DataFrame, policy: str = "v1") -> DataFrame:
    """A row per rule of the policy: failed, failed by no other rule, and kept if the rule were left out."""
    mask = POLICIES[policy]
    failed = F.col("fail_mask").bitwiseAND(F.lit(mask))
    rules = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    sums = [F.count(F.when(failed == 0, 1)).alias("kept")]
    for name, bit in rules:
        sums += [F.count(F.when(failed.bitwiseAND(F.lit(bit)) != 0, 1)).alias(f"f_{name}"), F.count(F.when(failed == bit, 1)).alias(f"o_{name}")]
    one = led.agg(*sums)
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), (F.col("kept") + F.col(f"o_{n}")).alias("n_kept_without")) for n, _ in rules])
        ).alias("r")
    ).select("r.*")


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns. Decided per row, so equal doc_ids cannot mix."""
    key = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return _with_row(key, policy).select("_row.*")


def _with_row(key: DataFrame, policy: str) -> DataFrame:
    led = apply_policy(ledger(key.select(F.struct("doc_id", "_row").alias("doc_id"), "text")), policy)
    return fence(led).where("kept").select(F.col("doc_id._row").alias("_row"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask"
    )


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """Every rule of every policy, from one stored ledger."""
    led, out = stored(table(spark, sf_dir, "documents")), None
    for policy in POLICIES:
        part = ablate(led, policy).withColumn("policy", F.lit(policy))
        out = part if out is None else out.union(part)
    return out


_WORDS = "[\\x20\\x09-\\x0D]+"
_LEDGER = f"""
with d as (
  select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '{_WORDS}'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents
), g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
), p as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1
), r as (
  select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from p) group by doc_id
), m as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{_WORDS}', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::bigint as n_letter_words,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r on d.doc_id = r.doc_id
), f as (
  select *, ({" + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))})::bigint as fail_mask from m
)
"""
ORACLE = _LEDGER + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & {BASE}) <> 0 as base_failed,
       (fail_mask & {POLICIES["v1"] | BASE}) = 0 as kept, fail_mask from f
"""
ABLATION = _LEDGER + f"""
, policies as (select * from (values {", ".join(f"('{n}', {m})" for n, m in POLICIES.items())}) as t(policy, mask)
), rules as (select * from (values {", ".join(f"('{n}', {b})" for n, b in BIT.items())}) as t(rule, bit)
)
select policy, rule, count(*) filter ((fail_mask & bit) <> 0) as n_failed, count(*) filter ((fail_mask & mask) = bit) as n_only,
       count(*) filter ((fail_mask & mask & ~bit) = 0) as n_kept_without
from f, policies, rules where (mask & bit) <> 0 group by policy, rule
"""
