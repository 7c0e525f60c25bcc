"""Schemas and closed vocabularies of the data model."""

from __future__ import annotations

# fixed values: vocabularies, weights and thresholds
VERSIONS = ["TLS1.0", "TLS1.1", "TLS1.2", "TLS1.3", "unknown"]
STRENGTHS = ["strong", "medium", "weak", "unknown"]
EXCHANGES = ["ECDHE", "RSA", "DHE", "unknown"]
PROTOCOLS = ["smtp", "imap", "pop3"]
MODES = ["upgrade", "implicit", "none", "stripped"]
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]
LEVELS = ["Critical", "High", "Medium", "Low"]
SOURCES = ["synthetic", "live", "lab", "model"]
SEVERITY_WEIGHT = {"Critical": 25, "High": 15, "Medium": 7, "Low": 3, "Info": 1}
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}
LEVEL_FROM = {"Critical": 40, "High": 25, "Medium": 10, "Low": 0}
PROBABILITY_FROM = {"Critical": 0.85, "High": 0.60, "Medium": 0.40, "Low": 0.0}
PROBABILITY_FROM_YOUDEN = {"Critical": 0.85, "High": 0.70, "Medium": 0.45, "Low": 0.0}
WIRE_ACTION = {"allow": "deliver", "flag": "deliver_banner", "quarantine": "quarantine", "block": "hold_incident"}
CATEGORY_CODES = {
    "version": {"TLS1.0": 0, "TLS1.1": 1, "TLS1.2": 2, "TLS1.3": 3, "unknown": 4, "none": 4},
    "cipher_strength": {"strong": 0, "medium": 1, "weak": 2, "unknown": 3},
    "kex": {"ECDHE": 0, "RSA": 1, "DHE": 2, "unknown": 3},
    "starttls_mode": {"upgrade": 0, "implicit": 1, "none": 2, "stripped": 3},
    "port": {"25": 0, "587": 1, "993": 2, "465": 3, "995": 4, "143": 5},
}
CIPHER_NAMES = {
    0x0005: "RC4-SHA", 0x0009: "DES-CBC-SHA", 0x000A: "DES-CBC3-SHA", 0x002F: "AES128-SHA", 0x0035: "RSA-AES256-SHA", 0x003C: "AES128-SHA256",
    0x009E: "DHE-RSA-AES128-GCM-SHA256", 0x009F: "DHE-RSA-AES256-GCM-SHA384", 0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC02B: "ECDHE-ECDSA-AES128-GCM-SHA256", 0xC02C: "ECDHE-ECDSA-AES256-GCM-SHA384", 0xC02F: "ECDHE-RSA-AES128-GCM-SHA256", 0xC030: "ECDHE-RSA-AES256-GCM-SHA384", 0xCCA8: "ECDHE-RSA-CHACHA20-POLY1305", 0xCCA9: "ECDHE-ECDSA-CHACHA20-POLY1305",
}
SERVER_PORTS = [25, 110, 143, 465, 587, 993, 995]

FINDING = "struct<check:string,severity:string,spec:string,evidence:string,remediation:string>"
VERDICT = f"""flow_id string, environment_id string, capture_epoch string, source_id string, coverage_ratio double,
pre_tls_buffer_len int, pre_tls_buffer_injection_possible boolean,
starttls_transcript array<struct<packet_no:int,direction:string,line:string>>, starttls_advertised boolean,
starttls_upgraded_at_packet_no int, app_protocol string, starttls_mode string,
tls struct<version:string,is_deprecated:boolean,cipher_suite:string,cipher_strength:string,is_aead:boolean,kex:string,fs_flag:boolean,
ja4:string,ja4_rarity:double,ja4s:string,early_data_offered:boolean,early_data_accepted:boolean,psk_offered:boolean,ticket_age:int,
ech_outer_present:boolean,handshake_success:boolean,alert_after_starttls:boolean>,
cert struct<leaf_present:boolean,is_tls13_opaque:boolean,not_before:string,not_after:string,days_to_expiry:int,is_expired:boolean,
is_self_signed:boolean,chain_length:int,chain_valid:boolean,san_match:boolean,pubkey_algo:string,pubkey_bits:int,sigalg:string,
sigalg_weak:boolean,keysize_weak:boolean,ocsp_stapled_status:string,ocsp_must_staple:boolean,crl_unknown_reason:boolean>,
assessment struct<findings:array<{FINDING}>,risk_level:string,risk_score:int,anomaly_score:double,anomaly_honest_score:double,
posture_score:int,calibrated_prob:double>,
policy struct<action:string,disposition_reason:string,banner_text:string,quarantine_id:string,siem_severity:string,arf_report_id:string>"""
