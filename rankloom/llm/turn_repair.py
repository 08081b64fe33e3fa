r"""Operator 11: conversation structure repair by a higher-order fold in Spark SQL.

A well formed conversation has role initials `(s?(ua)+)?`. Window functions flag each
turn's first fault: blank (no character but white space), duplicate (role and text stand
earlier in the conversation) or truncated (the last character that is not white space is
none of `.!?`). The turns of a conversation are then collected as sorted structs, and
`aggregate` folds over them with four states, (cost, audit) structs of the cheapest edits that
end with nothing, a system turn, a user turn or an assistant turn. Each turn is kept (0),
gets another role (3) or is deleted (4); blank and duplicate turns must go, a truncated one that
stays costs 3 more; empty user or assistant turns are inserted anywhere (3 each). `least` over
the structs takes the cheapest and, among these, the audit that is first in ASCII order. That
order is safe step by step: an audit tells its cost, so of two of one cost none begins the other.

The audit alone gives the repaired turns: its letters align with the turns one to one but for
inserts, and roles alternate from the first user turn on.

One exchange, by conversation, serves the windows and the fold. A conversation is one array and
its audit one string, so one task holds a whole conversation, as its repaired form is one too.

Cases: a null role or text is one space, thus a blank text or a role that can't stay; turns are
ordered by turn (nulls first), then role and text; rows of a null conversation form one;
repeated rows are duplicates; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound, table

RENAME, REMOVE, INSERT, UNFINISHED = 3, 4, 3, 3
FAR = 1 << 40  # the cost of what can't be
STATES = "esua"  # nothing yet, a system, a user, an assistant turn
NO_SPACE = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = ("su", "ua", "au")


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, text) with faults by a hash of conversation and turn: a twentieth
    each of the rows is dropped, emptied, loses its sentence ends, is repeated, is said by the user."""
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conversation), F.lit(":"), name(turn))) % 20
    own = rows.select(F.col(conversation), F.col(turn), F.when(kind == 4, "user").otherwise(name(role)).alias(role), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name(text), "[.!?]", "")).otherwise(name(text)).alias(text), kind.alias("__kind"))
    times = F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1)
    return own.withColumn("__n", F.explode(F.array_repeat(F.lit(0), times))).drop("__n", "__kind")


def _flagged(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(id, at, turn, role, text, initial, fault, new_turn, illegal) of each row."""
    said = lambda x: F.coalesce(F.col(x), F.lit(" "))
    own = rows.select(F.col(conversation).alias("id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    own = own.withColumn("initial", F.substring("role", 1, 1))
    own = own.withColumns({"at": F.row_number().over(order), "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)), "pair": F.concat(F.lag("initial").over(order), "initial")})
    seen = F.row_number().over(Window.partitionBy("id", "role", "text").orderBy("at")) > 1
    fault = F.when(~F.col("text").rlike(NO_SPACE), "blank").when(seen, "duplicate").when(~F.col("text").rlike(FINISHED), "truncated")
    return own.withColumns({"fault": fault, "illegal": F.coalesce(~F.col("pair").isin(*LEGAL), F.lit(False))})


def _edited(state: Column, cost, letter) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _opened(acc: Column) -> tuple[Column, Column, Column, Column]:
    """The states after the inserts that can pay: one, or two from where no user turn is open."""
    e, s, u, a = (acc[x] for x in STATES)
    return e, s, F.least(u, *(_edited(x, INSERT, "I") for x in (e, s, a))), F.least(a, _edited(u, INSERT, "I"), *(_edited(x, 2 * INSERT, "II") for x in (e, s)))


def _step(acc: Column, m: Column) -> Column:
    e, s, u, a = _opened(acc)
    lost, base = m["fault"].isin("blank", "duplicate"), F.when(m["fault"].isin("blank", "duplicate"), FAR).when(m["fault"] == "truncated", UNFINISHED).otherwise(0)
    gone = lambda x: _edited(x, REMOVE, "D")
    stays = lambda x, own: _edited(x, base + F.when(m["initial"] == own, 0).otherwise(RENAME), F.when(m["initial"] == own, "K").otherwise("R"))
    system = _edited(e, F.when((m["initial"] == "s") & ~F.coalesce(lost, F.lit(False)), base).otherwise(FAR), "K")
    new = gone(e), F.least(gone(s), system), F.least(gone(u), *(stays(x, "u") for x in (e, s, a))), F.least(gone(a), stays(u, "a"))
    return F.struct(*(x.alias(n) for n, x in zip(STATES, new, strict=True)))


def cheapest(turns: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of structs with `initial` and `fault`."""
    begin = [F.struct(F.lit(0 if x == "e" else FAR).cast("long").alias("cost"), F.lit("").alias("audit")).alias(x) for x in STATES]

    def end(acc: Column) -> Column:
        e, _, _, a = _opened(acc)
        return F.least(e, a)

    return F.aggregate(turns, F.struct(*begin), _step, end)


def repaired(turns: Column, audit: Column) -> Column:
    """The turns, as structs of role and text, that the edits of an audit leave."""
    made = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))
    new = made(F.lit(None), F.lit(""))
    none = F.array().cast("array<struct<role: string, text: string>>")

    def edited(m: Column, letters: Column) -> Column:
        own = F.when(letters.endswith("K"), F.array(made(m["role"], m["text"]))).when(letters.endswith("R"), F.array(made(F.lit(None), m["text"]))).otherwise(none)
        return F.concat(F.array_repeat(new, F.length(letters) - 1), own)

    steps = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1)), edited)
    items = F.concat(F.flatten(steps), F.array_repeat(new, F.length(F.regexp_extract(audit, "(I*)$", 1))))

    def named(own: Column, shift: Column) -> Column:
        return F.transform(own, lambda x, n: F.struct(F.coalesce(x["role"], F.when((n - shift) % 2 == 0, "user").otherwise("assistant")).alias("role"), x["text"].alias("text")))

    shift = lambda own: F.when(F.coalesce(F.get(own, 0)["role"], F.lit("")).startswith("s"), 1).otherwise(0)
    return bound(items, lambda own: bound(shift(own), lambda n: named(own, n)))


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps (turn numbers that lack), blank, duplicate and
    truncated (turns by first fault), illegal (adjacent roles), cost, audit, and `turns`, the repaired ones."""
    own = _flagged(rows, conversation, turn, role, text)
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0).cast("long"))
    ms = F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "role", "text"))).alias("ms")
    got = own.groupBy("id").agg(gaps.alias("gaps"), *counts, F.count_if("illegal").alias("illegal"), ms)
    got = got.withColumn("best", cheapest(F.col("ms")))
    return got.select(F.col("id").alias(conversation), "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", repaired(F.col("ms"), F.col("best.audit")).alias("turns"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "__id")
    out = rows.select("conv_id").distinct()
    out = out.join(found, out["conv_id"].eqNullSafe(found["__id"]), "left")
    longs = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(F.array_join(lines, "\n"), F.lit("")), 256).alias("repaired_sha256"))


def _sql() -> str:
    """The same over recursion: one step a turn, all conversations at once."""
    bit = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten([[CAST(ascii(ch) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0] for ch in string_split(k, '')])), lambda c, x: {bit}), CAST(4294967295 AS UBIGINT))"
    edit = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || {letter}}}"
    first = lambda *xs: reduce(lambda p, q: f"least({p}, {q})", xs)
    opened_u = first("f.u", *(edit(f"f.{x}", 3, "'I'") for x in "esa"))
    opened_a = first("f.a", edit("f.u", 3, "'I'"), *(edit(f"f.{x}", 6, "'II'") for x in "es"))
    stay = lambda x, own: edit(x, f"t.base + CASE WHEN t.initial = '{own}' THEN 0 ELSE 3 END", f"CASE WHEN t.initial = '{own}' THEN 'K' ELSE 'R' END")
    gone = lambda x: edit(x, 4, "'D'")
    start = ", ".join(f"{{'c': CAST({0 if x == 'e' else FAR} AS BIGINT), 'a': ''}} AS {x}" for x in STATES)
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial FROM d),
p AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
t AS (SELECT *, CASE fault WHEN 'blank' THEN {FAR} WHEN 'duplicate' THEN {FAR} WHEN 'truncated' THEN 3 ELSE 0 END AS base FROM p),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {start} FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT f.conv_id, t.pos, {gone("f.e")}, {first(gone("f.s"), edit("f.e", f"CASE WHEN t.initial = 's' THEN t.base ELSE {FAR} END", "'K'"))},
{first(gone(opened_u_ := f"({opened_u})"), stay("f.e", "u"), stay("f.s", "u"), stay(f"({opened_a})", "u"))}, {first(gone(f"({opened_a})"), stay(opened_u_, "a"))}
FROM f JOIN t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = f.pos + 1),
b AS (SELECT conv_id, {first("f.e", opened_a)} AS best FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, unnest(range(1, length(best.a) + 1)) AS n FROM b),
m AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY n) AS pos FROM l),
r AS (SELECT m.conv_id, m.n, m.letter, t.role, CASE WHEN m.letter = 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.n) AS i FROM m LEFT JOIN t ON m.letter <> 'I' AND m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.pos = t.pos WHERE m.letter <> 'D'),
q AS (SELECT *, max(CASE WHEN i = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM r),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (i - 1 - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n) AS repaired FROM q GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM b LEFT JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON b.conv_id IS NOT DISTINCT FROM z.conv_id"""


QUERIES = {"op11_turn_repair": op11_turn_repair}
ORACLES = {"op11_turn_repair": _sql()}
