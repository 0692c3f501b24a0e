"""Training, metric, model and streaming queries with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.ml import metrics, models, prep
from flowlens.operators.features import seen_features
from flowlens.plans.oracle import sql
from flowlens.plans.packets import packets
from flowlens.plans.queries import Query, names
from flowlens.schema import FEATURE_COLS, SSH_SMB, TRAIN_FEATURES
from flowlens.sources import tables
from flowlens.sources.shared import shared_path, written
from flowlens.streaming import flows as streaming

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = oracle


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Labelled feature rows, of the columns that models see, in three files of chunks."""
    return labelled(seen_features(packets(spark, d), keep=("k",)))


def labelled(f: DataFrame) -> DataFrame:
    """Feature rows, all their columns or some, with label, file and chunk."""
    k = F.col("k")
    label = F.when(k % 97 == 0, None).when(k % 10 < 2, "malicious").when(k % 10 < 4, " Tainted").when(k % 10 == 4, "weird").otherwise("Normal")
    return f.select(*[c for c in FEATURE_COLS if c in f.columns], label.alias("Label"), (F.col("frame_no") % 3).alias("file"), F.floor(F.col("frame_no") / 600).alias("chunk"), "k")


CORPUS = """corpus as (select *, case when k%97=0 then null when k%10<2 then 'attack' when k%10<4 then 'tampered' when k%10=4 then null else 'benign' end as lab,
 frame_no%3 as file, frame_no//600 as chunk, (frame_no*2654435761+42)%4294967296 as hsh from features), prep as (select * from corpus where lab is not null)"""


def over_corpus(select: str) -> str:
    return sql("#", "features").replace(" #", f", {CORPUS} {select}")


def ready(spark: SparkSession, d: str) -> DataFrame:
    return prep.prepared(corpus(spark, d), keys=("frame_no", "file", "chunk", "k"))


def kept(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """ready(), of it columns if named, written once for queries that read it several times."""
    df = ready(spark, d)
    return written(df.select(*columns) if columns else df, "corpus")




def train_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows of chunks of 600 over CSV files of 2,000 packets, each in order, written and read back by a glob."""
    path, part = shared_path(spark, "training"), F.floor(F.col("frame_no") / 2000).alias("part")
    files = corpus(spark, d).select("frame_no", "len_bytes", "tcp_flags", "Label", part).repartition("part").sortWithinPartitions("part", "frame_no")
    files.write.partitionBy("part").option("header", True).csv(path)
    rows = tables.read_training(spark, f"{path}/part=*/*.csv", 600)
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part")
    return rows.groupBy(part, "chunk").agg(F.count("*").alias("n"), F.min(F.col("frame_no").cast("long")).alias("first"), F.max(F.col("frame_no").cast("long")).alias("last"))


add("train_scan", train_scan, over_corpus("""select part, chunk, count(*) as n, min(frame_no) as first, max(frame_no) as last from
 (select *, (row_number() over (partition by part order by frame_no) - 1)//600 as chunk from (select frame_no, frame_no//2000 as part from corpus) a) b group by part, chunk""").replace("frame_no%3 as file, frame_no//600 as chunk", "frame_no%3 as file"))
add("train_columns", lambda s, d: prep.train_columns(corpus(s, d)).select("len_bytes", "dport", "tcp_flags"), over_corpus("select len_bytes, dport, tcp_flags from corpus"))


def by_label_column(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the corpus by three orders of columns: the wanted one, a candidate, scores where there is none."""
    base = corpus(spark, d)
    score = (F.col("k") * 37 % 101).cast("int")
    parts = {"wanted": base.withColumn("y", F.lit("benign")), "candidate": base.withColumnsRenamed({"Label": "Attack"}), "scores": base.withColumn("risk_score", score).drop("Label")}
    found = [prep.prepared(df, keys=("frame_no",)).select("frame_no", F.lit(how).alias("how"), F.lit(prep.label_column(df.columns)).alias("label_column"), "label") for how, df in parts.items()]
    return prep.union(found)


add("train_label_column", by_label_column, over_corpus("""select frame_no, 'wanted' as how, 'Label' as label_column, lab as label from prep union all select frame_no, 'candidate', 'Attack', lab from prep
 union all select frame_no, 'scores', null, case when k*37%101>=70 then 'attack' when k*37%101>=40 then 'tampered' else 'benign' end from corpus"""))
_SHOWN = ["len_bytes", "vlan_id", "tcp_win", "tcp_flag_SYN", "tcp_flag_ACK", "flow_pkts"]
add("train_prep", lambda s, d: ready(s, d).select("frame_no", "label", *_SHOWN),
    over_corpus("select frame_no, lab as label, cast(len_bytes as double) as len_bytes, coalesce(vlan_id,0)*1.0 as vlan_id, coalesce(tcp_win,0)*1.0 as tcp_win, case when tcp_flags like '%S%' then 1.0 else 0.0 end as tcp_flag_SYN, case when tcp_flags like '%A%' then 1.0 else 0.0 end as tcp_flag_ACK, cast(flow_pkts as double) as flow_pkts from prep"))
add("stratified_sample", lambda s, d: prep.stratified(kept(s, d, "frame_no", "file", "chunk", "label"), ["file", "chunk", "label"], "frame_no").select("frame_no", "label"),
    over_corpus("select frame_no, lab as label from (select *, row_number() over (partition by file, chunk, lab order by hsh, frame_no) as rn, count(*) over (partition by file, chunk, lab) as n from prep) x where rn <= round(n*0.15)"))
add("per_file_cap", lambda s, d: prep.capped(kept(s, d, "frame_no", "file"), "file", "frame_no", 150).select("frame_no", "file"), over_corpus("select frame_no, file from (select *, row_number() over (partition by file order by hsh, frame_no) as rn from prep) x where rn<=150"))
add("global_cap", lambda s, d: prep.total_cap(ready(s, d), ["file", "chunk"], 500).select("frame_no"),
    over_corpus("select frame_no from prep p join (select file, chunk from (select file, chunk, coalesce(sum(n) over (order by file, chunk rows between unbounded preceding and 1 preceding), 0) as b from (select file, chunk, count(*) as n from prep group by file, chunk) y) z where b<500) q on p.file=q.file and p.chunk=q.chunk"))
# The caps at their full size.
add("per_file_cap_full", lambda s, d: prep.capped(kept(s, d, "frame_no", "file"), "file", "frame_no").select("frame_no", "file"), ORACLE_SQL["per_file_cap"].replace("rn<=150", f"rn<={prep.PER_FILE}"))
add("global_cap_full", lambda s, d: prep.total_cap(ready(s, d), ["file", "chunk"]).select("frame_no"), ORACLE_SQL["global_cap"].replace("b<500", f"b<{prep.TOTAL}"))
add("union_by_name", lambda s, d: prep.union([corpus(s, d).where("file = 0").select("frame_no", "dport"), corpus(s, d).where("file = 1").select("ttl_hlim", "frame_no")]),
    over_corpus("select frame_no, dport, null as ttl_hlim from corpus where file=0 union all select frame_no, null, ttl_hlim from corpus where file=1"))
add("train_split", lambda s, d: prep.split(kept(s, d, "frame_no", "label"), "frame_no").select("frame_no", "validation"),
    over_corpus("select frame_no, case when rn <= round(n*0.2) then 1 else 0 end as validation from (select *, row_number() over (partition by lab order by hsh, frame_no) as rn, count(*) over (partition by lab) as n from prep) x"))
add("class_weights", lambda s, d: prep.class_weights(ready(s, d)).select("label", F.round("weight", 9).alias("weight")), over_corpus("select lab as label, round((select count(*) from prep)/(3.0*count(*)), 9) as weight from prep group by lab"))


def guessed(spark: SparkSession, d: str) -> DataFrame:
    """Labels with predictions that are right for most."""
    k = F.col("k")
    return ready(spark, d).withColumn("prediction", F.when(k % 7 == 0, "benign").when(k % 11 == 0, "attack").otherwise(F.col("label")))


_GUESS = "guess as (select lab as y, case when k%7=0 then 'benign' when k%11=0 then 'attack' else lab end as p from prep)"
add("confusion_matrix", lambda s, d: metrics.confusion(guessed(s, d)), over_corpus("select * from (select 1) one").replace("select * from (select 1) one", "").rstrip() + f", {_GUESS} select y as label, " + names(f"count(case when p='{x}' then 1 end) as {x}" for x in ("attack", "benign", "tampered")) + " from guess group by y")
_REPORT = f""", {_GUESS}, cl as (select c as name, sum(case when y=c and p=c then 1 else 0 end) as tp, sum(case when p=c then 1 else 0 end) as found, sum(case when y=c then 1 else 0 end) as support, count(*) as total
 from guess, (select 'attack' as c union all select 'benign' union all select 'tampered') k group by c),
 pr as (select *, case when found>0 then tp*1.0/found else 0.0 end as pc, case when support>0 then tp*1.0/support else 0.0 end as rc from cl),
 f as (select *, case when pc+rc>0 then 2.0*pc*rc/(pc+rc) else 0.0 end as fs from pr)
 select name, round(pc,4) as precision, round(rc,4) as recall, round(fs,4) as f1, cast(support as bigint) as support from f
 union all select 'accuracy', round(sum(tp)*1.0/max(total),4), round(sum(tp)*1.0/max(total),4), round(sum(tp)*1.0/max(total),4), cast(max(total) as bigint) from f
 union all select 'macro avg', round(avg(pc),4), round(avg(rc),4), round(avg(fs),4), cast(max(total) as bigint) from f
 union all select 'weighted avg', round(sum(pc*support)*1.0/sum(support),4), round(sum(rc*support)*1.0/sum(support),4), round(sum(fs*support)*1.0/sum(support),4), cast(max(total) as bigint) from f"""
add("classification_report", lambda s, d: metrics.report(guessed(s, d)), over_corpus("").rstrip() + _REPORT)


def _validated(kind: str, **options) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        parts = written(prep.split(kept(spark, d), "frame_no"), "parts")
        model = models.fit(kind, parts.where("validation = 0"), **options)
        out = models.predicted(model, parts.where("validation = 1"))
        return metrics.report(out.select("label", F.col("prediction_label").alias("prediction")))

    return query


for kind in ("rf", "dt", "svm"):
    add(f"ml_{kind}", _validated(kind))


def ml_knn(spark: SparkSession, d: str) -> DataFrame:
    parts = written(prep.split(kept(spark, d), "frame_no"), "parts")
    train, rows = models.scaled_vectors(parts.where("validation = 0"), parts.where("validation = 1"))
    found = models.knn(train, rows, key="frame_no")
    return metrics.report(rows.select("frame_no", "label").join(found, "frame_no"))


add("ml_knn", ml_knn)


def ml_score(spark: SparkSession, d: str, reload: bool = False) -> DataFrame:
    # Written once, of the columns that models see: the same rows are trained on and scored.
    rows = written(seen_features(packets(spark, d), keep=("k",)), "features")
    model, names_ = models.fit("dt", written(prep.prepared(labelled(rows), keys=("frame_no",)), "corpus")), TRAIN_FEATURES
    if reload:
        path = shared_path(spark, "model-dt")
        models.save(model, path, names_)
        model, facts = models.load(spark, path)
        names_ = facts["features"]
    return models.score(model, rows, names_).select("frame_no", "label", F.round("confidence", 9).alias("confidence"))


add("ml_score", ml_score)
add("model_reload", lambda s, d: ml_score(s, d, reload=True))


STREAMED = [c for c in FEATURE_COLS if c.startswith("flow_")] + SSH_SMB


def stream_features(spark: SparkSession, d: str) -> DataFrame:
    """Running flow state from a stream over packet files, four micro-batches of all that is there, read back from its sink."""
    base, table = shared_path(spark, "stream"), packets(spark, d)
    last = table.agg(F.max("frame_no")).first()[0] or 0
    for k in range(4):  # each start takes the files that came since the last one, however many tasks wrote them
        table.where(F.col("frame_no").between(last * k // 4 + 1, last * (k + 1) // 4)).write.mode("append").parquet(f"{base}/in")
        state = streaming.running_features(spark.readStream.schema(table.schema).parquet(f"{base}/in"))
        state.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("frame_no", *STREAMED)


add("stream_features", stream_features, sql(f"select frame_no, {names(STREAMED)} from rstate", "rstate"))
