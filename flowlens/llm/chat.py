"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once more:
that speaker is the assistant, the others are users under their names, and the
mask covers what the assistant says.  System turns are context in every one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of one output row; longer dialogues go on in further parts.
PART_TURNS = 256
#: What a name in a header must not hold: white space (Unicode's too), controls, < and the escape.
_UNSAFE, _SAFE = r"[\s\p{Z}\p{C}<%]", r"[^\s\p{Z}\p{C}<%]"
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _trimmed(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), _OUTER, "")


def _name(role: Column) -> Column:
    """The trimmed role, one to one: %, white space, controls and < as the %-codes of
    their UTF-8 bytes.  A role `unknown` gets a code too, as null and empty ones are `unknown`."""
    trimmed = _trimmed(role)
    coded = lambda x: F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
    pieces = F.regexp_extract_all(trimmed, F.lit(f"(?s)({_UNSAFE}|{_SAFE}+)"), 1)
    escaped = F.array_join(F.transform(pieces, lambda x: F.when(F.rlike(x, F.lit(f"^{_SAFE}")), x).otherwise(coded(x))), "")
    named = F.when(F.rlike(trimmed, F.lit(_UNSAFE)), escaped).otherwise(trimmed)
    return F.when(named == "", F.lit("unknown")).when(named == "unknown", F.lit("%75nknown")).otherwise(named)


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, turns, text, spans: a row per participant and part.

    A turn is rendered as `<|im_start|>HEADER`, line feed, text, `<|im_end|>`, line
    feed; HEADER is `assistant`, `system`, or `user name=NAME`.  spans are [start, stop)
    code points of the assistant's texts with their `<|im_end|>`, the only ones a loss
    should see.  Marks `<|` in a text become `< |`, so no text can end its turn.

    A trimmed role is a participant, shown one to one: white space, controls, % and
    < are %-codes, as in URLs.  Null and empty roles are one, `unknown`; `system` is
    none, and a conversation of system turns only has no row.  Null texts are
    empty.  Turns stand in order of (turn, role, text), null turns first; repeated
    rows are said again.  Null conv_ids are one conversation.  part counts from 0,
    turns part_turns * part and up (null turns: part 0), so that a conversation
    with very many turns is many rows and no group is collected whole.  Columns
    other than conv_id, turn, role, text are not looked at.
    """
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(0)) / part_turns).cast("long").alias("part"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.when(F.lower(_trimmed(F.col("role"))) == "system", F.lit(None)).otherwise(_name(F.col("role"))).alias("name"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("m"),
    )
    speakers = said.where("m.name is not null").select(F.col("conv_id").alias("_conv"), F.col("m.name").alias("speaker")).distinct()
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    each = parts.join(speakers, F.expr("conv_id <=> _conv")).drop("_conv")

    def header(m):
        return (
            F.when(m["name"].isNull(), F.lit("system"))
            .when(m["name"] == F.col("speaker"), F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), m["name"]))
        )

    shown = F.transform(
        "ms",
        lambda m: F.struct(
            F.concat(F.lit("<|im_start|>"), header(m), F.lit("\n")).alias("head"),
            F.concat(m["text"], F.lit("<|im_end|>")).alias("body"),
            F.coalesce(m["name"] == F.col("speaker"), F.lit(False)).alias("own"),
        ),
    )
    each = each.withColumn("_shown", shown)
    length = lambda s: F.length(s["head"]) + F.length(s["body"]) + 1
    starts = F.transform("_shown", lambda s, i: F.aggregate(F.slice("_shown", 1, i), F.lit(0), lambda a, t: a + length(t)))
    each = each.withColumn("_starts", starts)
    spans = F.zip_with("_shown", "_starts", lambda s, a: F.struct(s["own"].alias("own"), (a + F.length(s["head"])).alias("start"), (a + length(s) - 1).alias("stop")))
    spans = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"], s["stop"]))
    text = F.array_join(F.transform("_shown", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return each.select("conv_id", "speaker", "part", F.size("ms").cast("long").alias("turns"), text.alias("text"), spans.alias("spans"))


#: DuckDB: the same rendering as one string per perspective, offsets by running sums.
ORACLE_SQL = r"""
with m as (
  select conv_id, coalesce(turn, 0) // 256 as part, turn,
         case when lower(trim(role)) = 'system' then null
              when regexp_replace(coalesce(role, ''), '[^A-Za-z0-9_.-]+', '_', 'g') = '' then 'unknown'
              else regexp_replace(coalesce(role, ''), '[^A-Za-z0-9_.-]+', '_', 'g') end as name,
         replace(coalesce(text, ''), '<|', '< |') as text
  from conversations
), s as (select distinct conv_id, name as speaker from m where name is not null
), r as (
  select m.conv_id, speaker, part, turn, name, text, coalesce(name = speaker, false) as own,
         '<|im_start|>' || case when name is null then 'system' when name = speaker then 'assistant' else 'user name=' || name end || chr(10) as head,
         text || '<|im_end|>' as body
  from m join s on m.conv_id = s.conv_id
), o as (
  select *, row_number() over w as k,
         coalesce(sum(length(head) + length(body) + 1) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from r window w as (partition by conv_id, speaker, part order by turn nulls first, name nulls first, text)
)
select conv_id, speaker, part, count(*) as turns, string_agg(head || body || chr(10), '' order by k) as text,
       string_agg(case when own then cast(start + length(head) as bigint) || '-' || cast(start + length(head) + length(body) as bigint) end, ',' order by k) as spans
from o group by conv_id, speaker, part
"""
