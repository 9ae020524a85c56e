"""Declared column types shared by the jobs (Spark DDL strings)."""

SPAN = "struct<type:string,value:string,start:int,end:int,confidence:double,source:string>"
DETECTIONS = f"array<{SPAN}>"
HINTS = "array<struct<type:string,match:string,reason:string,index:int>>"
WARNINGS = "array<struct<type:string,value:string,reason:string>>"
TOKENS = "array<struct<token:string,value:string,type:string,seq:int>>"

TURNS = "conv_id long, turn long, role string, text string, domain string, ts timestamp"
CUSTOM_RULES = "type string, pattern string, confidence string, ord long"
ALLOWLIST = "domain string"
ENTITIES = "name string, label string"
VAULT = "conv_id long, turn long, seq int, token string, value string"
CLOSED = "conv_id long, ts timestamp"
AUDIT = (
    "id string, ts timestamp, prompt_hash string, prompt_length long, pii_types array<string>, "
    "pii_count int, elapsed_ms long, domain string, day date"
)
