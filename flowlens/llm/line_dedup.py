"""Line dedup by overlapping three-line windows (DataFrame functions only).

Every three consecutive lines of a text are a window.  A window that stands
earlier, in a document before this one or higher up in this one, is removed: the
lines of its later occurrences are covered, and overlapping covers merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2: the windows, under two independent 64-bit hashes."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    lines = lines.where(F.size("lines") >= size)

    def hashed(i):
        at = [F.get("lines", i + k) for k in range(size)]
        return F.struct(i.alias("pos"), F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit(size), *reversed(at)).alias("h2"))

    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - size), hashed)
    return lines.select("doc_id", "text_hash", F.explode(windows).alias("w")).select("doc_id", "text_hash", "w.*")


def later_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, starts: first lines, ascending, of all later occurrences.

    The first occurrence is a minimum, summed before it is shuffled, so that a
    window in a third of all documents costs one row per task.
    """
    windows = _windows(docs, size)
    place = F.struct("doc_id", "text_hash", "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs with repeated windows of `size` lines taken out of `text`; adds
    line_count and lines_removed after docs' own columns.

    Order is that of (doc_id, hash of the text, line number), null ids first.
    Lines are cut at line feeds and compared as they are, blank ones too.  Texts
    of fewer lines have no window and stay.  Null texts stay null, without
    lines; an empty text is one empty line.  A text all of whose lines go is
    left as an empty text, its row stays.  Rows that repeat an id with the same
    text are one document and keep or lose the same lines.  Other columns pass
    through, but line_count and lines_removed of docs are replaced.
    """
    starts = later_windows(docs, size).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("line_count", "lines_removed")])
    rows = docs.select(whole.alias("_doc"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(starts, F.expr("doc_id <=> _id and text_hash = _hash"), "left")
    lines = _lines(F.col("_doc.text"))
    # What stays lies between the end of one cover and the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform("starts", lambda s: s + size))
    nexts = F.concat("starts", F.array(F.size("_lines")))
    parts = F.zip_with(ends, nexts, lambda a, b: F.slice("_lines", a + 1, F.greatest(b - a, F.lit(0))))
    kept = F.when(F.col("starts").isNull(), F.col("_lines")).otherwise(F.flatten(parts))
    rows = rows.withColumn("_lines", lines).withColumn("_kept", kept)
    text = F.when(F.col("starts").isNull(), F.col("_doc.text")).otherwise(F.array_join("_kept", "\n"))
    count = F.when(F.col("_doc.text").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    removed = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept"))
    out = [text.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("line_count", "lines_removed")]
    return rows.select(*out, count.cast("long").alias("line_count"), removed.cast("long").alias("lines_removed"))


#: DuckDB: the same windows compared as texts, for unique ids.
ORACLE_SQL = """
with l as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) as lines from documents
), e as (
  select doc_id, len(lines) as n, unnest(lines) as line, unnest(range(len(lines))) as pos from l
), w as (
  select doc_id, pos, line || chr(10) || lead(line, 1) over o || chr(10) || lead(line, 2) over o as win,
         n from e window o as (partition by doc_id order by pos)
), r as (
  select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as k from w where pos <= n - 3
), c as (
  select distinct doc_id, pos + d as pos from r, (values (0), (1), (2)) t(d) where k > 1
), k as (
  select e.doc_id, string_agg(e.line, chr(10) order by e.pos) as text, count(*) as n
  from e left join c on e.doc_id = c.doc_id and e.pos = c.pos where c.pos is null group by e.doc_id
)
select l.doc_id, case when l.text is null then 0 else len(lines) end as line_count,
       case when l.text is null then 0 else len(lines) - coalesce(k.n, 0) end as lines_removed,
       case when l.text is null then null else coalesce(k.text, '') end as text
from l left join k on l.doc_id = k.doc_id
"""
