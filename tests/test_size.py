"""Plans and tasks that must not grow with the table, or with each use of a value."""

import ipaddress

from pyspark.sql import functions as F

from conftest import SMALL
from flowlens.functions import header
from flowlens.operators.features import with_times
from flowlens.operators.flows import flows
from flowlens.plans import training
from flowlens.plans.packets import packets
from flowlens.sources import log
from flowlens.sources.shared import shared_path
from oracle import expected, rows


def test_ipv4_number_is_read_once(spark):
    edges = set()
    for net, bits in header.NOT_PUBLIC_V4:
        lo = int(ipaddress.ip_address(net))
        hi = lo + 2 ** (32 - bits) - 1
        edges |= {str(ipaddress.IPv4Address(max(0, min(2**32 - 1, x)))) for x in (lo - 1, lo, lo + 1, (lo + hi) // 2, hi, hi + 1)}
    ips = sorted({*edges, *header.PUBLIC_WITHIN_V4, "8.8.8.8", "1.2.3", "1.2.3.4.5", "01.2.3.4", "", "x"})
    df = spark.createDataFrame([(i,) for i in [*ips, None]], "ip string").select("ip", header.public_ipv4(F.col("ip")).alias("p"))
    inside = lambda a: any(a in ipaddress.ip_network(f"{n}/{b}") for n, b in header.NOT_PUBLIC_V4) and str(a) not in header.PUBLIC_WITHIN_V4

    def public(text):
        try:
            return not inside(ipaddress.IPv4Address(text))
        except ValueError:
            return False

    assert {r.ip: r.p for r in df.collect()} == {i: public(i) for i in ips} | {None: False}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_generated_methods_are_compiled(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    packets(spark, SMALL)
    assert int(spark.conf.get(limit)) == 8000
    spark.conf.set(limit, 500)
    packets(spark, SMALL)
    assert int(spark.conf.get(limit)) == 500
    spark.conf.unset(limit)


def test_log_by_small_pieces(spark, tmp_path, monkeypatch):
    p = packets(spark, SMALL).limit(60)
    log.write_log(with_times(p), flows(p), str(tmp_path), None)
    shown = lambda df: sorted(map(repr, df.collect()))
    whole, lines = shown(log.read_packets(spark, str(tmp_path))), shown(log.log_lines(spark, str(tmp_path)))
    monkeypatch.setattr(log, "PIECE_BITS", 2)  # less than a record's lines
    monkeypatch.setattr(log, "PIECES", 8)
    assert shown(log.read_packets(spark, str(tmp_path))) == whole and len(whole) == 60
    assert shown(log.log_lines(spark, str(tmp_path))) == lines
    assert log._lines(spark, str(tmp_path))[0].rdd.getNumPartitions() > 8


def test_stream_files_are_written_by_many_tasks(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(training, "packets", lambda s, d: packets(s, d).repartition(3))
    monkeypatch.setattr(training, "shared_path", lambda s, n: paths.append(shared_path(s, n)) or paths[-1])
    df = training.stream_features(spark, SMALL)
    assert spark.read.parquet(f"{paths[0]}/in").select("_metadata.file_path").distinct().count() == 12
    assert rows(df.collect()) == expected(training.ORACLE_SQL["stream_features"], SMALL, df.columns)


def test_scored_rows_are_computed_once(spark):
    df = training.QUERIES["ml_score"](spark, SMALL)
    assert not [f for f in df.inputFiles() if "events.parquet" in f]
    assert df.select("frame_no").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").count() == df.count()
