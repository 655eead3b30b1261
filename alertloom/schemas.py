"""DDL of the tables the jobs read and write."""

FINDINGS = """
    finding_id STRING, type STRING, severity DOUBLE, title STRING, region STRING,
    resource_type STRING, access_key_id STRING, principal_id STRING, user_type STRING,
    user_name STRING, instance_id STRING, center_time TIMESTAMP, detector_id STRING,
    ingest_time TIMESTAMP
"""

# request_parameters is JSON text; it becomes a VARIANT when a bundle is assembled.
TRAIL = """
    access_key_id STRING, event_id STRING, event_time TIMESTAMP, event_name STRING,
    event_source STRING, username STRING, source_ip STRING, user_agent STRING,
    aws_region STRING, error_code STRING, error_message STRING, request_parameters STRING
"""

TRAIL_RAW = """
    AccessKeyId STRING, EventId STRING, EventName STRING, EventTime TIMESTAMP,
    Username STRING, CloudTrailEvent STRING
"""

PRINCIPALS = "kind STRING, user_name STRING"
ATTACHED_POLICIES = "kind STRING, user_name STRING, policy_name STRING"
INLINE_POLICIES = "kind STRING, user_name STRING, policy_name STRING, document STRING"
GROUP_MEMBERSHIPS = "user_name STRING, group_name STRING"

BRIEF = """
    STRUCT<summary: STRING, severity: STRING, confidence: STRING,
           attack_techniques: ARRAY<STRUCT<technique_id: STRING, name: STRING, rationale: STRING>>,
           affected_resources: ARRAY<STRING>, recommended_actions: ARRAY<STRING>>
"""

# brief_json is the model's structured output as it arrived; parse_briefs types it.
RESPONSES = """
    finding_id STRING, attempt INT, stop_reason STRING, error_type STRING, brief_json STRING,
    input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT,
    cache_creation_input_tokens BIGINT, request_id STRING, model STRING, processing_ms BIGINT
"""

CLAIMS = "finding_id STRING, expires_at BIGINT"
