"""Queries against the SQL oracle."""

import pytest
from flowlens.plans import catalog

from conftest import SMALL
from oracle import expected, rows

#: One of each kind; tests/all_queries.py runs all of them.
SOME = """features_table flows_table scores_table packet_score reputation_reason mac_ip_spoof ones_complement l4_checksum http_parse tls_sni
flow_ssh flow_smb top_flows protocol_evidence_page export_protocol_evidence protocol_summary_text flow_summary_lines frame_log_lines_all model_feature_matrix train_prep train_label_column
train_scan log_packets log_lines stratified_sample global_cap train_split classification_report stream_features""".split()


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = rows(df.collect())
    assert got == expected(catalog.ORACLE_SQL[name], SMALL, df.columns)


def test_all_oracles_have_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 110


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and df.columns[0] == "flow_src_ip"
