"""Schemas of the tables. Every key starts with `target`, the project or run."""

FINDING = "rule_id string, severity string, cwe string, file string, line_start int, line_end int, summary string, evidence string, fix_suggestion string, confidence double"
FILES = "target string, crate string, rel_path string, content string"
MANIFESTS = "target string, dir string, package_name string, is_workspace boolean, members array<string>, exclude array<string>, parse_ok boolean"
CHUNKS = "target string, crate string, rel_path string, start_line int, end_line int, content string, hints array<string>"
FINDINGS = f"target string, crate string, {FINDING}, ord bigint"
VERDICT = "verdict string, new_severity string, reason string, confidence double"
TRUTH = "target string, line_slack int, severity_order array<string>, schema_version int"
ENTRY = "id string, file string, line_start int, line_end int, category string, cwe string, severity string, must_detect boolean, aliases array<string>, notes string"
ENTRIES = f"target string, ord int, {ENTRY}"
DECISION = "struct<kind:string,new_severity:string,reason:string>"
CACHE = f"target string, config_hash string, type string, key string, findings string, decision {DECISION}, input_tokens bigint, output_tokens bigint, seq bigint"

#: Severities from worst to least; a place in the list is a rank.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
