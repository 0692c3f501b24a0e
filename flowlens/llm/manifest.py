"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots,
and a proof for every row (DataFrame functions only).

A level is a table of nodes.  A window by group and parent number collects the
digests of a parent's children in order: their join is the parent's preimage,
and what stands before and behind a child are its siblings.  Each parent goes to
the next level once.  Proofs are then handed down, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import in_order, with_totals_before, written

STEP = "array<struct<before:string,after:string>>"


def leaf_digest(*columns: Column) -> Column:
    """Lower-case hex sha256 of the columns: `-` for null, else number of UTF-8 bytes, `:`, value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _key(group: Column) -> Column:
    """Groups as texts that keep their order, null first."""
    return F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), group.cast("string")))


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds _at, a node's number in its group by `order`, and _n, the nodes of the group.

    Ranges of the whole order are numbered apart, so a group with most of the rows is spread.
    """
    ranged = in_order(nodes, ["_key", *order], "merkle-order")
    sums = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_rows"))  # a row per group and range
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("_key")).alias("_n"))
    own = Window.partitionBy("_key", "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_own", F.row_number().over(own)).join(sums, ["_key", "_range"])
    return numbered.withColumn("_at", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_own", "_before", "_range")


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels from nodes (_key, _at, _n, _digest and more) up to where every group has one node.

    Each has _before and _after, the digests of a node's siblings put together.
    """
    nodes = written(nodes, "merkle-leaves")
    most = nodes.agg(F.max("_n")).first()[0] or 0  # one row
    levels = []
    while True:
        single = most <= 1
        run = Window.partitionBy("_key", F.floor(F.col("_at") / fanout)).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        slot = (F.col("_at") % fanout).cast("int")
        if single:
            level = nodes.withColumns({"_before": F.lit(""), "_after": F.lit(""), "_parent": F.lit(None).cast("string")})
        else:
            level = nodes.withColumn("_run", F.collect_list("_digest").over(run)).withColumns(
                {
                    "_before": F.array_join(F.slice("_run", F.lit(1), slot), ""),
                    "_after": F.array_join(F.slice("_run", slot + 2, F.lit(fanout)), ""),
                    "_parent": F.when((slot == 0) & (F.col("_n") > 1), F.sha2(F.array_join("_run", ""), 256)),
                }
            )
            level = written(level.drop("_run"), "merkle-level")
        levels.append(level)
        if single:
            return levels
        parents = level.where("_parent is not null")  # the first child of each
        nodes = parents.select("_key", F.floor(F.col("_at") / fanout).alias("_at"), F.ceil(F.col("_n") / fanout).alias("_n"), F.col("_parent").alias("_digest"))
        most = -(-most // fanout)


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The top node of each group, with the number of its level."""
    out = None
    for k, level in enumerate(levels):
        top = level.where("_n = 1").select("_key", "_digest", F.lit(k).alias("_level"))
        out = top if out is None else out.unionByName(top)
    return out


def _descend(levels: list[DataFrame], tops: DataFrame, kept: list[str], fanout: int) -> DataFrame:
    """The lowest level's rows with the columns `kept` of their top, and `_proof`: own steps, then the top's.

    tops has _key, _level, the columns kept and _proof.  Joins are by group and
    parent, of which no node has more than fanout children.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.where(F.col("_level") == k).select(F.col("_key").alias("_akey"), F.lit(0).cast("long").alias("_aat"), *kept, "_proof")
        above = here if above is None else here.unionByName(above)
        node = levels[k].drop("_parent")
        found = node.join(above, (F.col("_key") == F.col("_akey")) & (F.floor(F.col("_at") / fanout) == F.col("_aat")))
        own = F.when(F.col("_n") > 1, F.array(F.struct(F.col("_before").alias("before"), F.col("_after").alias("after")))).otherwise(F.array().cast(STEP))
        found = found.withColumn("_proof", F.concat(own, F.col("_proof"))).drop("_akey", "_aat", "_before", "_after", "_n")
        above = found if k == 0 else found.select(F.col("_key").alias("_akey"), F.col("_at").alias("_aat"), *kept, "_proof")
    return above


def merkle_manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf", fanout: int = 3) -> DataFrame:
    """leaves with `subroot` (of their group), `root` (of all) and `proof`.

    Per group, leaves stand in ascending order (nulls first; equal ones by
    digest), and every `fanout` consecutive nodes, at the end fewer or even one,
    become the sha256 of their hex digests put together, while there is more than
    one; a lone leaf is its group's root.  Group roots by group (null is a group
    and comes first, others by their UTF-8 bytes) become the root likewise.
    proof has a step per level, from the leaf through the group's root to the
    root: the digests of the siblings before and after, put together.

    An empty table gives no row.  Repeated rows are leaves each.  A null digest
    is taken as empty.  Columns of leaves named like the three new ones are
    replaced, all others pass through, whatever their names.  Levels are tables
    in the shared folder; the largest group's size decides their number, and is
    all that the driver gets.
    """
    own = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    nodes = leaves.select(row, _key(F.col(group)).alias("_key"), F.col(order).alias("_order"), F.coalesce(F.col(digest), F.lit("")).alias("_digest"))
    placed = _placed(written(nodes, "merkle-rows"), ["_order", "_digest"]).drop("_order")
    levels = _climb(placed, fanout)
    tops = written(_tops(levels), "merkle-groups").withColumnsRenamed({"_key": "_group"})
    ranged = in_order(tops, ["_group"], "merkle-group-order")
    count = tops.agg(F.count(F.lit(1))).first()[0]  # one row
    placed = with_totals_before(ranged, ["_group"], F.lit(1), "_at").withColumns({"_key": F.lit(""), "_n": F.lit(count).cast("long")})
    upper = _climb(placed, fanout)
    top = _tops(upper).select("_key", "_level", F.col("_digest").alias("_root"), F.array().cast(STEP).alias("_proof"))
    placed = upper[0].withColumnsRenamed({"_level": "_low"})
    groups = _descend([placed, *upper[1:]], top, ["_root"], fanout)
    groups = groups.select(F.col("_group").alias("_key"), F.col("_low").alias("_level"), F.col("_digest").alias("_subroot"), "_root", "_proof")
    rows = _descend(levels, written(groups, "merkle-group-proofs"), ["_subroot", "_root"], fanout)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """Every second document by crc32 of its decimal id, without line feeds."""
    hit = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars"])) + f" || {_field(text)})"


#: DuckDB, by recursion over levels; for unique ids.  crc32 is taken byte by byte from a table.
ORACLE_SQL = f"""
with recursive crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) order by i) as t from range(256) r(i)
), summed as (
  select d.*, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 2 as odd from documents d, crc
), changed as (
  select *, case when odd = 0 then replace(text, chr(10), '') else text end as text2 from summed
), leaves as (
  select doc_id, source, {_leaf("text")} as leaf, {_leaf("text2")} as leaf2,
         row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as n from changed
), low as (
  select 0 as k, source, pos, n, leaf as digest from leaves
  union all
  select k + 1, source, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by k, source, pos // 3
), tops as (
  select source, k as tall, digest as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from low where n = 1
), high as (
  select 0 as k, pos, n, subroot as digest from tops
  union all
  select k + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by k, pos // 3
), steps_low as (
  select k, source, pos, array_to_string(list_slice(run, 1, (pos % 3)::int), '') as b, array_to_string(list_slice(run, (pos % 3)::int + 2, 3), '') as a
  from (select *, list(digest) over (partition by k, source, pos // 3 order by pos rows between unbounded preceding and unbounded following) as run from low where n > 1) x
), steps_high as (
  select k, pos, array_to_string(list_slice(run, 1, (pos % 3)::int), '') as b, array_to_string(list_slice(run, (pos % 3)::int + 2, 3), '') as a
  from (select *, list(digest) over (partition by k, pos // 3 order by pos rows between unbounded preceding and unbounded following) as run from high where n > 1) x
), steps as (
  select l.doc_id, s.k, b, a from leaves l join steps_low s on l.source is not distinct from s.source and s.pos = l.pos // (3 ** s.k)::bigint
  union all
  select l.doc_id, 1000 + s.k, b, a from leaves l join tops t on l.source is not distinct from t.source join steps_high s on s.pos = t.pos // (3 ** s.k)::bigint
), proofs as (
  select doc_id, list({{'b': b, 'a': a}} order by k) as p from steps group by doc_id
), fold as (
  select l.doc_id, leaf2 as h, coalesce(p, []) as p from leaves l left join proofs q on l.doc_id = q.doc_id
  union all
  select doc_id, sha256(p[1].b || h || p[1].a), p[2:] from fold where len(p) > 0
)
select l.doc_id, l.leaf, t.subroot, r.digest as root, sha256(coalesce(array_to_string(list_transform(q.p, lambda s: s.b || s.a), ''), '')) as proof_sha256,
       f.h as folded_root, f.h = r.digest as verified
from leaves l join tops t on l.source is not distinct from t.source left join proofs q on l.doc_id = q.doc_id
  join fold f on f.doc_id = l.doc_id and len(f.p) = 0, (select digest from high where n = 1) r
"""
