"""Repair of the turns of conversations, as a fold over each conversation's sorted turns. DataFrame functions only.

A conversation in order has the roles `(system? (user assistant)+)?`, told by their first characters. Windows find the faults
of each turn, the first that applies: blank (no character other than white space), duplicate (role and text seen earlier in
the conversation), truncated (the last such character is none of `.!?`). The cheapest edits are then looked for: Keep costs
0, Rerole (to user or assistant) REROLE, Delete DELETE (blank and duplicate turns must go), Insert (an empty turn of user or
assistant, anywhere) INSERT; a truncated turn that stays adds TRUNCATED. The fold carries, for each of the four places
within the order of roles, the least pair of cost and audit (the edits' initials), so ties go to the audit that is least in
ASCII. No audit can be the beginning of another of equal cost over the same turns, as what is inserted more costs more; so
the least audit of a prefix stays least. Roles of reroled and inserted turns follow from their place.

Turns are taken by turn (nulls first), role, text; rows that are equal in all three are so many turns. Null roles and texts
are one space; a null conv_id is a conversation of its own. A role without a first character fits nowhere. A conversation is
one row of the result and its turns meet in one row on the way, as its repaired text does. An empty table gives an empty one;
very long texts are read whole; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTS = ("blank", "duplicate", "truncated")
#: White space, and pairs of initials that may follow one another.
BLANKS, PAIRS = " \t\n\x0b\f\r", ("su", "ua", "au")
#: A cost that no conversation reaches.
NEVER = 1 << 60


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at (from 1), fault (null if there is none), initial, illegal (after the turn before),
    fresh (a turn number not seen before)."""
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", blank("role"), blank("text")).withColumn("initial", F.substring("role", 1, 1))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({
        "at": F.row_number().over(in_order), "pair_": F.concat(F.lag("initial").over(in_order), "initial"),
        "fresh": F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(in_order) == F.col("turn"), F.lit(False)),
    })
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    said = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(said == "", FAULTS[0]).when(seen, FAULTS[1]).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    return rows.select("conv_id", "turn", "role", "text", "at", fault.alias("fault"), "initial", F.coalesce(~F.col("pair_").isin(*PAIRS), F.lit(False)).alias("illegal"), "fresh")


def _edit(state: Column, cost, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _opened(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four least pairs, once any turns are inserted."""
    early = F.least(none, system)
    return F.struct(
        none.alias("none"), system.alias("system"),
        F.least(user, _edit(F.least(early, assistant), INSERT, "I")).alias("user"),
        F.least(assistant, _edit(F.least(user, _edit(early, INSERT, "I")), INSERT, "I")).alias("assistant"),
    )


def cheapest(turns: Column) -> Column:
    """cost, audit of an array of turns (initial, fault) in order."""
    pair = lambda cost, audit: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))
    never = pair(NEVER, "")
    begin = _opened(pair(0, ""), never, never, never)

    def step(best: Column, turn: Column) -> Column:
        free = F.coalesce(turn["fault"] == FAULTS[2], F.lit(True))
        extra = F.when(turn["fault"].isNull(), 0).otherwise(TRUNCATED)
        kept = lambda state, initial: F.when(free & (turn["initial"] == initial), _edit(state, extra, "K"))
        reroled = lambda state: F.when(free, _edit(state, extra + REROLE, "R"))
        gone = {name: _edit(best[name], DELETE, "D") for name in ("none", "system", "user", "assistant")}
        before = F.least(best["none"], best["system"], best["assistant"])
        return _opened(
            gone["none"],
            F.least(gone["system"], kept(best["none"], "s")),
            F.least(gone["user"], kept(before, "u"), reroled(before)),
            F.least(gone["assistant"], kept(best["user"], "a"), reroled(best["user"])),
        )

    return F.aggregate(turns, begin, step, lambda best: F.least(best["none"], best["assistant"]))


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate,
    truncated, illegal (counts), cost, audit, repaired (role, text of its turns)."""
    count = lambda what: F.count(F.when(what, True))
    sorted_ = F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "role", "text")))
    span = F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - count(F.col("fresh"))
    out = faulted(turns).groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *[count(F.col("fault") == x).alias(x) for x in FAULTS], count(F.col("illegal")).alias("illegal"), sorted_.alias("turns_"),
    )
    out = out.withColumn("best_", cheapest(F.col("turns_")))
    letters = F.transform(F.filter(F.split("best_.audit", ""), lambda x: x != ""), lambda x, i: F.struct(i.alias("place"), x.alias("edit")))
    out = out.withColumn("letters_", letters)
    of_turns = F.zip_with(F.filter("letters_", lambda x: x["edit"] != "I"), "turns_", lambda x, t: F.struct(x["place"].alias("place"), x["edit"].alias("edit"), t["role"].alias("role"), t["text"].alias("text")))
    inserted = F.transform(F.filter("letters_", lambda x: x["edit"] == "I"), lambda x: F.struct(x["place"].alias("place"), x["edit"].alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")))
    out = out.withColumn("stay_", F.sort_array(F.concat(F.filter(of_turns, lambda x: x["edit"] != "D"), inserted)))
    first = F.get("stay_", 0)
    out = out.withColumn("system_", F.coalesce((first["edit"] == "K") & first["role"].startswith("s"), F.lit(False)).cast("int"))
    role = lambda x, i: F.when(x["edit"] == "K", x["role"]).when((i + F.col("system_")) % 2 == 0, "user").otherwise("assistant")
    after = F.transform("stay_", lambda x, i: F.struct(role(x, i).alias("role"), x["text"].alias("text")))
    return out.select("conv_id", "gaps", *FAULTS, "illegal", "best_.cost", "best_.audit", after.alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, spoilt by the remainder of crc32(conv_id:turn) by 20: of 0, the row is gone; 1, its text is
    empty; 2, its text loses `.!?`; 3, it is there twice; 4, its role is user. Nulls are one space, but for ids."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), damage.alias("damage_"))
    text = F.when(F.col("damage_") == 1, "").when(F.col("damage_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage_") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage_") == 0, 0).when(F.col("damage_") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), times)).alias("copy_")).drop("copy_")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repair finds and does in each conversation, once its rows are damaged; those without rows left have zeros."""
    turns = table(spark, sf_dir, "conversations")
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    counts = ("gaps", *FAULTS, "illegal", "cost")
    found = repaired(damaged(turns)).select(F.col("conv_id").alias("id_"), *counts, "audit", F.sha2(lines, 256).alias("sha_"))
    ids = turns.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id_")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha_", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB: crc32 by its table, the fold as a recursion over the turns, the repair turn by turn."""
    edit = lambda state, cost, letter: f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}'}}"
    kept = lambda state, initial: f"case when loose and initial = '{initial}' then {edit(state, 'extra', 'K')} end"
    reroled = lambda state: f"case when loose then {edit(state, f'(extra + {REROLE})', 'R')} end"
    insert = lambda state: edit(state, INSERT, "I")
    never, start = f"{{'cost': {NEVER}::bigint, 'audit': ''}}", "{'cost': 0::bigint, 'audit': ''}"
    return f"""
    with recursive bits as (select n::bigint as n, n::bigint as c, 0 as k from range(256) r(n) union all select n, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    crcs as (select list(c order by n) as crc from bits where k = 8),
    named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
    hit as (select conv_id, turn, role, text, xor(list_reduce([4294967295::bigint] || [ascii(x)::bigint for x in string_split(name, '')], lambda c, b: xor(c >> 8, crc[xor(c % 256, b) + 1])), 4294967295) % 20 as damage from named, crcs),
    spoilt as (select conv_id, turn, case damage when 4 then 'user' else role end as role, case damage when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case damage when 0 then 0 when 3 then 2 else 1 end)) as copy from hit),
    placed as (select *, row_number() over w as at_, lag(left(role, 1)) over w || left(role, 1) as pair from spoilt window w as (partition by conv_id order by turn nulls first, role, text, copy)),
    flagged as (select *, left(role, 1) as initial, coalesce(pair not in ('su', 'ua', 'au'), false) as illegal, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as said, row_number() over (partition by conv_id, role, text order by at_) > 1 as seen from placed),
    faults as (select *, case when said = '' then 'blank' when seen then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' end as fault from flagged),
    steps as (select *, fault is null or fault = 'truncated' as loose, case when fault is null then 0 else {TRUNCATED} end as extra from faults),
    fold as (select conv_id, 0::bigint as at_, {start} as c0, {never} as c1, {insert(start)} as c2, {insert(insert(start))} as c3 from (select distinct conv_id from steps)
      union all select conv_id, at_, g0, g1, least(g2, {insert('g013')}), least(g3, {insert('gu')}) from (select *, least(g2, {insert('g01')}) as gu from (select *, least(g0, g1) as g01, least(g0, g1, g3) as g013 from (
        select conv_id, s_at as at_, {edit('c0', DELETE, 'D')} as g0, least({edit('c1', DELETE, 'D')}, {kept('c0', 's')}) as g1, least({edit('c2', DELETE, 'D')}, {kept('c013', 'u')}, {reroled('c013')}) as g2, least({edit('c3', DELETE, 'D')}, {kept('c2', 'a')}, {reroled('c2')}) as g3
        from (select f.*, least(c0, c1, c3) as c013, s.at_ as s_at, initial, loose, extra from fold f join steps s on s.conv_id is not distinct from f.conv_id and s.at_ = f.at_ + 1))))),
    best as (select conv_id, arg_max(least(c0, c3), at_) as b from fold group by 1),
    letters as (select conv_id, unnest(string_split(b.audit, '')) as edit, generate_subscripts(string_split(b.audit, ''), 1) as place from best where b.audit <> ''),
    counted as (select *, sum(case when edit <> 'I' then 1 else 0 end) over w as nth, sum(case when edit <> 'D' then 1 else 0 end) over w as stays from letters window w as (partition by conv_id order by place)),
    joined as (select c.*, s.role as old, s.text, max(case when stays = 1 and edit = 'K' and left(s.role, 1) = 's' then 1 else 0 end) over (partition by c.conv_id) as led from counted c left join steps s on edit <> 'I' and s.conv_id is not distinct from c.conv_id and s.at_ = c.nth),
    told as (select conv_id, string_agg(case when edit = 'K' then old when (stays + led) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by place) as told from joined where edit <> 'D' group by 1),
    facts as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from steps group by 1)
    select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.cost, 0)::bigint as cost, coalesce(b.audit, '') as audit, sha256(coalesce(told, '')) as repaired_sha256
    from (select distinct conv_id from conversations) i left join facts f on f.conv_id is not distinct from i.conv_id left join best b on b.conv_id is not distinct from i.conv_id left join told t on t.conv_id is not distinct from i.conv_id"""


ORACLE_SQL = {"op13_conversation_repair": _sql()}
