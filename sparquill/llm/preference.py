"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (same role, same text) is rendered once as the prompt; what follows in each of the
two is rendered as its completion, with the character spans of the assistant's words, which alone are trained on.

Pairs come from two sources. `opening`: conversations with the same first turn, two and two in the order of conv_id, so a
conversation more or less changes no pair of another opening. `replies`: a conversation that has no partner in its opening
is cut from itself, at its last reply: that reply is chosen and its first different one is rejected, after the same
history. What has neither is chosen `alone`.

Built-in expressions and joins only. Pairs are ranked on narrow rows by a range sort, and the largest opening is split
among tasks like any other.

Defined cases: a null role or text counts as an empty string; a turn with a null conv_id is a conversation of its own;
turns with the same number follow role, then text; repeated turns stay; equal conversations have two empty completions; a
conversation that stands alone has null in the rejected columns; an empty table gives no row; columns of the inputs other
than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fence, global_rank, small, stash, table

TRAINED_ROLE = "assistant"
_PAIR = ("source", "chosen_id", "chosen", "rejected_id", "rejected")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order as an array of (turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return known.union(turns.where("conv_id is null").select("conv_id", F.array(turn)))


def pair_up(convs: DataFrame) -> DataFrame:
    """(source, chosen_id, chosen, rejected_id, rejected); every conversation is chosen once or rejected once."""
    convs = stash(convs.withColumn("row", F.monotonically_increasing_id()))
    opening = F.md5(F.concat(F.element_at("turns", 1)["role"], F.lit("\n"), F.element_at("turns", 1)["text"]).cast("binary"))
    ranked = global_rank(convs.select(opening.alias("opening"), "conv_id", "row"), "opening", "conv_id", "row")
    shared = stash(ranked.groupBy("opening").agg(F.min("rank").alias("lo"), F.count("*").alias("n")).where("n > 1"))
    placed = stash(ranked.join(small(shared), "opening").withColumn("at", F.col("rank") - F.col("lo")).select("row", "lo", "n", "at"))
    side = F.col("at") % 2
    pairs = stash(
        placed.groupBy("lo", F.floor(F.col("at") / 2)).agg(*[F.max(F.when(side == s, F.col("row"))).alias(n) for s, n in ((0, "row"), (1, "other"))])
        .where("other is not null").select("row", "other")
    )
    paired = small(pairs.select(F.explode(F.array("row", "other")).alias("row")))
    named = convs.select(F.col("row").alias("other"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    opened = convs.join(small(pairs), "row").join(named, "other")
    opened = opened.select(F.lit("opening").alias("source"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), "rejected_id", "rejected")
    return opened.union(_from_replies(convs.join(paired, "row", "left_anti")))


def _from_replies(convs: DataFrame) -> DataFrame:
    """Pairs of conversations without a partner: two replies after the same history, where there are two."""
    reply = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i).otherwise(F.lit(-1))))
    found = fence(convs.withColumn("last", reply))
    history = F.slice("turns", F.lit(1), F.greatest("last", F.lit(0)))
    said = F.get("turns", F.greatest("last", F.lit(0)))["text"]
    other = F.get(F.filter(history, lambda t: (t["role"] == TRAINED_ROLE) & (t["text"] != said)), F.lit(0))
    cut = fence(found.withColumn("history", history).withColumn("other", other))
    two = F.col("other").isNotNull()
    return cut.select(
        F.when(two, "replies").otherwise("alone").alias("source"), F.col("conv_id").alias("chosen_id"),
        F.when(two, F.slice("turns", F.lit(1), F.col("last") + 1)).otherwise(F.col("turns")).alias("chosen"),
        F.when(two, F.col("conv_id")).alias("rejected_id"), F.when(two, F.concat("history", F.array("other"))).alias("rejected"),
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """[start, end) in characters of the trained texts within the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, t):
        begin = a["at"] + F.length(_head(t))
        end = begin + F.length(t["text"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED_ROLE, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """source, chosen_id, rejected_id, n_prompt_turns, prompt, and per side the completion and its trained spans."""
    same = F.zip_with("chosen", F.coalesce("rejected", F.slice("chosen", 1, 0)), lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    shared = pairs.withColumn("_same", same).withColumn(
        "n_prompt_turns", F.when(F.array_contains("_same", False), F.array_position("_same", False) - 1).otherwise(F.size("_same")).cast("long")
    )
    n = F.col("n_prompt_turns").cast("int")
    rest = {s: F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))) for s in ("chosen", "rejected")}
    cut = shared.select(
        "source", "chosen_id", "rejected_id", "n_prompt_turns", F.slice("chosen", F.lit(1), n).alias("_p"),
        rest["chosen"].alias("_c"), rest["rejected"].alias("_r"),
    )
    return cut.select(
        "source", "chosen_id", "rejected_id", "n_prompt_turns", _render(F.col("_p")).alias("prompt"),
        _render(F.col("_c")).alias("chosen"), _spans(F.col("_c")).alias("chosen_spans"),
        _render(F.col("_r")).alias("rejected"), _spans(F.col("_r")).alias("rejected_spans"),
    )


def op5_preference_pairs(spark, sf_dir: str) -> DataFrame:
    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    out = format_pairs(pair_up(conversations(table(spark, sf_dir, "conversations"))))
    return out.withColumn("chosen_spans", text("chosen_spans")).withColumn("rejected_spans", text("rejected_spans"))


def _sql_render(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|' || t.r || '|>' || chr(10) || t.t || chr(10)), '')"


def _sql_spans(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length(t.r) + length(t.t) + 6)), 0)"
    start = f"({before} + length({turns}[i].r) + 5)::bigint"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].r = '{TRAINED_ROLE}'), "
        f"lambda i: {start} || '-' || ({start} + length({turns}[i].t))), ',')"
    )


ORACLE = f"""
with c as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id
  union all select conv_id, [{{'r': coalesce(role, ''), 't': coalesce(text, '')}}] from conversations where conv_id is null
), k as (
  select *, md5(turns[1].r || chr(10) || turns[1].t) as op from c
), o as (
  select *, row_number() over (partition by op order by conv_id nulls first) - 1 as rk, count(*) over (partition by op) as n from k
), l as (
  select *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].r = '{TRAINED_ROLE}')) as last from o where rk % 2 = 0 and rk = n - 1
), m as (
  select *, list_filter(turns[1:last - 1], lambda x: x.r = '{TRAINED_ROLE}' and x.t <> turns[last].t)[1] as other from l
), p as (
  select 'opening' as source, a.conv_id as chosen_id, a.turns as c, b.conv_id as rejected_id, b.turns as r
  from o a join o b on a.op = b.op and b.rk = a.rk + 1 where a.rk % 2 = 0
  union all
  select case when other is null then 'alone' else 'replies' end, conv_id, case when other is null then turns else turns[1:last] end,
         case when other is not null then conv_id end, case when other is not null then list_append(turns[1:last - 1], other) end
  from m
), n as (
  select *, coalesce(list_min(list_filter(range(1, greatest(len(c), coalesce(len(r), 0)) + 1), lambda i: not coalesce(c[i].r = r[i].r and c[i].t = r[i].t, false))) - 1, len(c))::bigint as n_prompt_turns from p
), s as (
  select *, c[1:n_prompt_turns] as x, c[n_prompt_turns + 1:] as y, r[n_prompt_turns + 1:] as z from n
)
select source, chosen_id, rejected_id, n_prompt_turns, {_sql_render("x")} as prompt, {_sql_render("y")} as chosen,
       {_sql_spans("y")} as chosen_spans, case when r is not null then {_sql_render("z")} end as rejected,
       case when r is not null then {_sql_spans("z")} end as rejected_spans
from s
"""
