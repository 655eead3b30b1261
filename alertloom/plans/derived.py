"""Triage tables derived from the test tables, in SQL that runs unchanged on Spark and DuckDB.

`{events}` and the like stand for the source tables: DataFrames on Spark, view names elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

FINDINGS = """
SELECT concat('f-', cast(event_id AS VARCHAR(20))) AS finding_id,
       CASE event_id % 6 WHEN 0 THEN 'Recon:IAMUser/Enumeration' WHEN 1 THEN 'UnauthorizedAccess:IAMUser/ConsoleLogin'
            WHEN 2 THEN 'Stealth:IAMUser/LoggingDisabled' WHEN 3 THEN 'CryptoCurrency:EC2/BitcoinTool'
            WHEN 4 THEN 'Exfiltration:S3/AnomalousBehavior' ELSE 'Backdoor:EC2/C&CActivity' END AS type,
       cast(event_id % 101 AS DOUBLE) / 10 AS severity,
       concat('finding number ', cast(event_id AS VARCHAR(20))) AS title,
       CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'ap-south-1' END AS region,
       CASE WHEN event_id % 4 = 0 THEN 'Instance' ELSE 'AccessKey' END AS resource_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('AK', cast(user_id AS VARCHAR(20))) END AS access_key_id,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('P', cast(user_id AS VARCHAR(20))) END AS principal_id,
       CASE user_id % 3 WHEN 0 THEN 'IAMUser' WHEN 1 THEN 'AssumedRole' ELSE 'Root' END AS user_type,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('u', cast(user_id AS VARCHAR(20))) END AS user_name,
       CASE WHEN event_id % 4 = 0 THEN concat('i-0', cast(event_id AS VARCHAR(20))) END AS instance_id,
       ts AS center_time,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'd1' END AS detector_id,
       ts + INTERVAL '5' MINUTE AS ingest_time
FROM {events} WHERE event_type = 'error'
"""

TRAIL = """
SELECT concat('AK', cast(user_id AS VARCHAR(20))) AS access_key_id,
       CASE WHEN event_id % 37 <> 5 THEN concat('e-', cast(event_id AS VARCHAR(20))) END AS event_id,
       ts AS event_time,
       CASE WHEN event_id % 31 = 0 THEN '' WHEN event_type = 'error' THEN 'GetSecretValue'
            WHEN event_type = 'signup' THEN 'CreateUser' WHEN event_type = 'purchase' THEN 'RunInstances'
            WHEN event_type = 'click' THEN 'PutBucketPolicy' ELSE 'ListBuckets' END AS event_name,
       concat(event_type, '.amazonaws.com') AS event_source,
       concat('u', cast(user_id AS VARCHAR(20))) AS username,
       concat('10.0.', cast(user_id % 8 AS VARCHAR(20)), '.', cast(event_id % 5 AS VARCHAR(20))) AS source_ip,
       'aws-cli/2.0' AS user_agent,
       CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'ap-south-1' END AS aws_region,
       CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code,
       CASE WHEN event_type = 'error' THEN concat('denied for u', cast(user_id AS VARCHAR(20))) END AS error_message,
       props AS request_parameters
FROM (SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id % 20 = 0) AS copied
"""

# Request parameters with something to scrub: in keys and values, raw and escaped, nested, over the cap.
PARAMETERS = """
SELECT event_id, event_type, user_id,
       concat('{{"k":', cast(event_id AS VARCHAR(20)), ',"big":12345678901234567890.5,"na', chr(92), 'u200bme":["b', chr(92), 'u202eucket u', cast(user_id AS VARCHAR(20)),
         '",1.50,null,{{"de', chr(92), 'u0007ep":"', chr(92), 'b', event_type, chr(92), chr(92), 'u0007', chr(92), 'n', chr(92), '"', chr(127), 'end"}}],"props":', props,
         ',"long":"', repeat('ab', cast(980 + event_id % 40 AS INT)), chr(92), 'u0000"}}') AS request_parameters
FROM {events}
"""

PRINCIPALS = """
SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'role' END AS kind,
       concat('u', cast(user_id AS VARCHAR(20))) AS user_name
FROM {events} WHERE user_id % 10 <> 9
"""

ATTACHED = """
SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'role' END AS kind,
       concat('u', cast(user_id AS VARCHAR(20))) AS user_name,
       CASE user_id % 7 WHEN 0 THEN 'AdministratorAccess' WHEN 1 THEN 'AmazonS3FullAccess' WHEN 2 THEN 'AmazonS3ReadOnlyAccess'
            WHEN 3 THEN 'AmazonSSMManagedInstanceCore' WHEN 4 THEN 'SecurityAudit' ELSE 'AWSKeyManagementServicePowerUser' END AS policy_name
FROM {events} WHERE user_id % 10 <> 9 AND user_id % 7 <> 6
UNION ALL
SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'role' END AS kind,
       concat('u', cast(user_id AS VARCHAR(20))) AS user_name, 'AmazonEC2ReadOnlyAccess' AS policy_name
FROM {events} WHERE user_id % 10 <> 9 AND user_id % 11 = 0
"""

INLINE = """
SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'role' END AS kind,
       concat('u', cast(user_id AS VARCHAR(20))) AS user_name,
       concat('inline-', cast(user_id % 8 AS VARCHAR(20))) AS policy_name,
       CASE user_id % 8
         WHEN 0 THEN '{{"Version":"2012-10-17","Statement":{{"Effect":"Allow","Action":"*","Resource":"*"}}}}'
         WHEN 1 THEN '{{"Statement":[{{"Effect":"Allow","Action":["s3:*"],"Resource":["*"]}}]}}'
         WHEN 2 THEN '{{"Statement":[{{"Effect":"Allow","Action":"s3:GetObject","Resource":"arn:aws:s3:::logs+archive"}}]}}'
         WHEN 3 THEN '{{"Statement":[{{"Effect":"Deny","Action":"*","Resource":"*"}}]}}'
         WHEN 4 THEN '{{"Statement":[{{"Effect":"Allow","Action":["secretsmanager:GetSecretValue"],"Resource":"arn:aws:x"}}]}}'
         WHEN 5 THEN '%7B%22Statement%22%3A%5B%7B%22Effect%22%3A%22Allow%22%2C%22Action%22%3A%22iam%3APassRole%22%7D%5D%7D'
         ELSE 'not json' END AS document
FROM {events} WHERE user_id % 10 <> 9 AND user_id % 8 <> 7
"""

GROUPS = """
SELECT DISTINCT concat('u', cast(user_id AS VARCHAR(20))) AS user_name,
       concat('group-', cast(user_id % 4 AS VARCHAR(20))) AS group_name
FROM {events} WHERE user_id % 3 = 0 AND user_id % 10 <> 9
"""

# Case by event_id % 13: 0 refusal, 1 cut off, 2 API error, 3 no client, 4 no brief, 5 unknown severity,
# 6 an extra field, 7 unknown techniques then a good brief, 8 unknown techniques twice, 9 no techniques,
# the rest good or partly good briefs.
RESPONSES = """
SELECT concat('f-', cast(event_id AS VARCHAR(20))) AS finding_id, attempt,
       CASE WHEN k IN (2, 3) THEN NULL WHEN k = 0 THEN 'refusal' WHEN k = 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
       CASE WHEN k = 2 THEN 'RateLimitError' WHEN k = 3 THEN 'client_init_error' END AS error_type,
       CASE WHEN k < 5 THEN NULL ELSE concat(
         '{{"summary":"Principal u', cast(user_id AS VARCHAR(20)), ' raised finding ', cast(event_id AS VARCHAR(20)),
         '","severity":"', CASE WHEN k = 5 THEN 'SEVERE' WHEN event_id % 4 = 0 THEN 'LOW' WHEN event_id % 4 = 1 THEN 'MEDIUM'
                                WHEN event_id % 4 = 2 THEN 'HIGH' ELSE 'CRITICAL' END,
         '","confidence":"', CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END,
         '","attack_techniques":[',
         CASE WHEN k = 9 THEN '' WHEN k IN (7, 8) AND attempt = 1 OR k = 8 THEN
                '{{"technique_id":"T9999","name":"Made up","rationale":"none"}},{{"technique_id":"T0000","name":"Made up too","rationale":"none"}}'
              WHEN k = 10 THEN
                '{{"technique_id":"T1552.005","name":"Metadata API","rationale":"seen"}},{{"technique_id":"T9999","name":"Made up","rationale":"none"}}'
              ELSE '{{"technique_id":"T1078.004","name":"Cloud Accounts","rationale":"seen"}}' END,
         '],"affected_resources":["AK', cast(user_id AS VARCHAR(20)), '"," u', cast(user_id AS VARCHAR(20)), ' "," ","bucket-',
         cast(event_id AS VARCHAR(20)), '","i-0', cast(event_id AS VARCHAR(20)), '"],"recommended_actions":[',
         CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('"Disable key AK', cast(user_id AS VARCHAR(20)), '","Review the timeline"') END,
         ']', CASE WHEN k = 6 THEN ',"notes":"extra"' ELSE '' END, '}}') END AS brief_json,
       CASE WHEN k IN (2, 3) THEN NULL ELSE 800 + event_id % 400 END AS input_tokens,
       CASE WHEN k IN (2, 3) THEN NULL ELSE 1200 + event_id % 700 END AS output_tokens,
       CASE WHEN k IN (2, 3) THEN NULL ELSE event_id % 7460 END AS cache_read_input_tokens,
       CASE WHEN k IN (2, 3) THEN NULL ELSE cast(0 AS BIGINT) END AS cache_creation_input_tokens,
       CASE WHEN k IN (2, 3) THEN NULL ELSE concat('req-', cast(event_id AS VARCHAR(20)), '-', cast(attempt AS VARCHAR(20))) END AS request_id,
       CASE WHEN k IN (2, 3) THEN NULL ELSE 'model-a' END AS model,
       7000 + (event_id * 37) % 9000 AS processing_ms
FROM (SELECT event_id, user_id, event_id % 13 AS k, 1 AS attempt FROM {events} WHERE event_type = 'error'
      UNION ALL
      SELECT event_id, user_id, event_id % 13 AS k, 2 AS attempt FROM {events}
      WHERE event_type = 'error' AND event_id % 13 IN (7, 8, 11)) AS attempts
WHERE event_id % 37 <> 0
"""

CLAIMS = """
SELECT concat('f-', cast(event_id AS VARCHAR(20))) AS finding_id,
       cast(CASE WHEN event_id % 2 = 0 THEN 1800000000 ELSE 1600000000 END AS BIGINT) AS expires_at
FROM {events} WHERE event_type = 'error' AND event_id % 9 = 0
"""

# Findings as a front end would send them: some twice, some with no id.
ARRIVALS = (
    "SELECT * FROM (" + FINDINGS + ") AS sent UNION ALL SELECT * FROM (" + FINDINGS + ") AS again WHERE severity >= 9.5"
    " UNION ALL SELECT CASE WHEN severity >= 5 THEN '' END AS finding_id, type, severity, title, region, resource_type, access_key_id,"
    " principal_id, user_type, user_name, instance_id, center_time, detector_id, ingest_time FROM (" + FINDINGS + ") AS bare WHERE severity < 0.3 OR severity = 8"
)

# Finding documents in both casings and the three envelopes.
DOCUMENTS = """
SELECT event_id, CASE event_id % 4
  WHEN 0 THEN concat('{{"Id":"f-', cast(event_id AS VARCHAR(20)), '","Type":"Recon:IAMUser/X","Severity":', cast(event_id % 10 AS VARCHAR(20)), '.5,"Region":"us-east-1",',
    '"Resource":{{"ResourceType":"AccessKey","AccessKeyDetails":{{"AccessKeyId":"AK', cast(user_id AS VARCHAR(20)), '","PrincipalId":"P', cast(user_id AS VARCHAR(20)), '","UserType":"Role","UserName":"u', cast(user_id AS VARCHAR(20)), '"}}}},',
    '"Service":{{"EventLastSeen":"2024-01-0', cast(1 + event_id % 9 AS VARCHAR(20)), 'T10:20:30Z","DetectorId":"d1"}},"Title":"t', cast(event_id AS VARCHAR(20)), '"}}')
  WHEN 1 THEN concat('{{"detail":{{"id":"f-', cast(event_id AS VARCHAR(20)), '","type":"Stealth:IAMUser/Y","severity":', cast(event_id % 10 AS VARCHAR(20)), ',"region":"eu-west-1",',
    '"resource":{{"resourceType":"AccessKey","accessKeyDetails":{{"accessKeyId":"AK', cast(user_id AS VARCHAR(20)), '","userName":"u', cast(user_id AS VARCHAR(20)), '"}}}},',
    '"service":{{"eventFirstSeen":"2024-01-02T00:00:00Z"}},"updatedAt":"2024-01-03T04:05:06Z"}}}}')
  WHEN 2 THEN concat('{{"Findings":[{{"Id":"f-', cast(event_id AS VARCHAR(20)), '","Severity":8,"Resource":{{"ResourceType":"Instance","InstanceDetails":{{"InstanceId":"i-', cast(event_id AS VARCHAR(20)), '"}}}},',
    '"CreatedAt":"2024-01-04T00:00:00Z","Service":{{"EventLastSeen":""}}}},{{"Id":"second"}}]}}')
  ELSE CASE WHEN event_id % 8 = 3 THEN '{{}}' ELSE concat('{{"Id":"","id":"f-', cast(event_id AS VARCHAR(20)), '","service":{{"eventLastSeen":',
    CASE event_id % 5 WHEN 0 THEN '"2024"' WHEN 1 THEN '"12:30"' WHEN 2 THEN '1718' ELSE '"not a time"' END, '}}}}') END END AS document
FROM {events} WHERE event_type = 'error'
"""

LOOKUPS = """
SELECT concat('AK', cast(user_id AS VARCHAR(20))) AS AccessKeyId, concat('e-', cast(event_id AS VARCHAR(20))) AS EventId,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS EventName, ts AS EventTime,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('u', cast(user_id AS VARCHAR(20))) END AS Username,
       CASE WHEN event_id % 11 = 0 THEN '{{broken' ELSE concat('{{"eventName":"inner-', event_type, '","eventSource":"s3.amazonaws.com","sourceIPAddress":"10.0.0.',
         cast(event_id % 9 AS VARCHAR(20)), '","userAgent":"cli","awsRegion":"us-east-1"', CASE WHEN event_id % 7 = 0 THEN ',"errorCode":"AccessDenied","errorMessage":"no"' ELSE '' END,
         CASE WHEN event_id % 13 = 0 THEN ',"userIdentity":null' ELSE concat(',"userIdentity":{{"userName":"in-u', cast(user_id AS VARCHAR(20)), '"}}') END,
         ',"requestParameters":', props, '}}') END AS CloudTrailEvent
FROM {events}
"""

# Expected band of a labelled document, and a document treated as a finding of that severity.
LABELS = """
SELECT concat('doc-', cast(l.doc_id AS VARCHAR(20))) AS name, concat('d-', cast(l.doc_id AS VARCHAR(20))) AS finding_id,
       CASE WHEN l.toxic = 1 THEN 'HIGH' WHEN l.quality = 1 THEN 'MEDIUM' ELSE 'LOW' END AS expected_severity
FROM {labels} AS l
"""

LABEL_RESULTS = """
SELECT concat('d-', cast(d.doc_id AS VARCHAR(20))) AS finding_id, d.doc_id % 10 = 3 AS degraded,
       cast(d.n_chars % 101 AS DOUBLE) / 10 AS severity, cast(d.doc_id % 4 AS BIGINT) AS related_count,
       CASE WHEN d.doc_id % 3 = 0 THEN 'HIGH' WHEN d.doc_id % 3 = 1 THEN 'low' ELSE 'MEDIUM' END AS model_severity,
       d.n_chars AS processing_ms
FROM {documents} AS d
"""


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def derive(spark: SparkSession, sql: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """A derived table, with its times as UTC instants."""
    wanted = {t: read(t) for t in ("events", "documents", "labels") if "{" + t + "}" in sql}
    rows = spark.sql(sql, **wanted)
    local = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({name: F.col(name).cast("timestamp") for name in local}) if local else rows
