"""Columns, ports, thresholds and points, once for expressions and tests."""

from __future__ import annotations

# They must equal those of the tables and scores to be matched.
FEATURE_COLS = """
frame_no ts_epoch t_rel ts_local len_bytes
eth_src eth_dst eth_type vlan_id vlan_prio
ip_version ip_tos dscp ecn ip_total_len ip_id ip_flags_df ip_flags_mf ip_frag_off ttl_hlim ip_proto
ip_hdr_checksum ipv4_checksum_ok ip_src ip_dst ip_ihl_bytes
src_ip_mac_consistent src_ip_mac_seen_mac_count src_mac_ip_seen_ip_count src_mac_ip_spoof_suspect
l4_proto sport dport tcp_flags tcp_win tcp_hdr_len l4_checksum_ok
flow_pkts flow_bytes flow_iat_min flow_iat_avg flow_iat_max flow_duration
flow_fwd_pkts flow_rev_pkts flow_fwd_bytes flow_rev_bytes
flow_syn_count flow_ack_count flow_fin_count flow_rst_count flow_psh_count
flow_syn_seen flow_synack_seen flow_ack_seen_after_synack
flow_bad_ip_checksum_count flow_bad_l4_checksum_count flow_frag_count flow_low_ttl_count flow_unusual_dscp_count
flow_unique_sports flow_unique_dports flow_protocol_hint
flow_http_seen flow_http_payload_detected flow_http_port_fallback flow_http_detect_source
flow_tls_payload_detected flow_tls_port_fallback flow_tls_detect_source
flow_http_method flow_http_host flow_http_path flow_tls_seen flow_tls_sni
flow_risk_score flow_risk_level flow_risk_reason
""".split()
FLOW_ID = "flow_src_ip flow_dst_ip flow_proto flow_src_port flow_dst_port".split()
FLOW_COLS = [*FLOW_ID, *"""
flow_pkts flow_bytes flow_duration flow_iat_min flow_iat_avg flow_iat_max
flow_fwd_pkts flow_rev_pkts flow_fwd_bytes flow_rev_bytes
flow_syn_count flow_ack_count flow_fin_count flow_rst_count flow_psh_count
flow_bad_ip_checksum_count flow_bad_l4_checksum_count flow_frag_count flow_low_ttl_count flow_unusual_dscp_count
flow_unique_sports flow_unique_dports
flow_http_seen flow_http_payload_detected flow_http_port_fallback flow_http_detect_source flow_http_method flow_http_host flow_http_path
flow_tls_seen flow_tls_payload_detected flow_tls_port_fallback flow_tls_detect_source flow_tls_sni
flow_ssh_seen flow_ssh_payload_detected flow_ssh_port_fallback flow_ssh_detect_source flow_ssh_banner
flow_smb_seen flow_smb_payload_detected flow_smb_port_fallback flow_smb_detect_source flow_smb_version
flow_syn_seen flow_synack_seen flow_ack_seen_after_synack flow_protocol_hint
flow_risk_score flow_risk_level flow_risk_reason
""".split()]
SSH_SMB = [c for c in FLOW_COLS if c.startswith(("flow_ssh", "flow_smb"))]
TOP_FLOW_COLS = [*FLOW_ID, *"""
flow_pkts flow_duration flow_protocol_hint flow_http_detect_source flow_http_method flow_http_host flow_http_path
flow_tls_detect_source flow_tls_sni flow_risk_score flow_risk_level flow_risk_reason
""".split()]
TOP_PACKET_COLS = "frame_no ip_src ip_dst label ip_fraud_score_display risk_level".split()
EVIDENCE_COLS = """
flow_src_ip flow_dst_ip flow_src_port flow_dst_port flow_protocol_hint
flow_http_detect_source flow_http_method flow_http_host flow_http_path flow_tls_detect_source flow_tls_sni
flow_ssh_seen flow_ssh_payload_detected flow_ssh_port_fallback flow_ssh_detect_source flow_ssh_banner
flow_smb_seen flow_smb_payload_detected flow_smb_port_fallback flow_smb_detect_source flow_smb_version
flow_risk_score flow_risk_level
""".split()
EVIDENCE_EXPORT_COLS = [c for c in EVIDENCE_COLS if not c.endswith(("_seen", "_detected", "_fallback"))]
TRAIN_FEATURES = """
len_bytes vlan_id vlan_prio ip_version ip_tos dscp ecn ip_total_len ip_id ip_flags_df ip_flags_mf ip_frag_off ttl_hlim ip_proto
ip_hdr_checksum ipv4_checksum_ok ip_ihl_bytes l4_proto sport dport tcp_win tcp_hdr_len l4_checksum_ok
flow_pkts flow_bytes flow_iat_min flow_iat_avg flow_iat_max
tcp_flag_SYN tcp_flag_ACK tcp_flag_FIN tcp_flag_RST tcp_flag_PSH tcp_flag_URG
""".split()
HTTP_PORTS = (80, 8080, 8000, 8888)
TLS_PORT, SSH_PORT, SMB_PORT = 443, 22, 445
FOCUS_PORTS = (22, 80, 443, 445)
USUAL_DSCP = (0, 8, 16, 24, 32, 46)
LOW_TTL = 20
HTTP_METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS")
HTTP_BUFFER = 4096
FLAG_LETTERS = {"SYN": "S", "ACK": "A", "FIN": "F", "RST": "R", "PSH": "P", "URG": "U"}
FLAG_BITS = {"SYN": 2, "ACK": 16, "FIN": 1, "RST": 4, "PSH": 8, "URG": 32}
SCORE_COLS = ["ip_fraud_score", "ip_fraud_score_display", "risk_level", "risk_score_reason"]
COERCED = ["ipv4_checksum_ok", "l4_checksum_ok", "ip_flags_mf", "ip_frag_off", "ttl_hlim", "dscp", "dport"]
LABEL_CANDIDATES = ["label", "Label", "Labels", "class", "Class", "Attack", "attack", "Category", "Traffic", "target", "y"]
CLASSES = ["attack", "benign", "tampered"]
LABEL_NAMES = {
    "benign": "benign", "normal": "benign", "good": "benign",
    "attack": "attack", "malicious": "attack", "anomaly": "attack", "bad": "attack",
    "tampered": "tampered", "tainted": "tampered",
}
# End of fixed values.
