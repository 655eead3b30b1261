"""The registered queries once more, as SQL for DuckDB over the same tables.

Written from the meaning of each query with plain joins and windows. Only the derivation of the
input tables and the fixed values are shared with the Spark side.
"""

from __future__ import annotations

from ..functions.techniques import TECHNIQUES
from ..operators.rules import PURPOSES, SIGNALS
from . import derived as d


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows) + f") AS v({columns})"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _level(number: str) -> str:
    return f"CASE {number} WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"


def _number(name: str) -> str:
    return f"CASE upper({name}) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def _gate_number(severity: str) -> str:
    return f"CASE WHEN {severity} >= 7 THEN 3 WHEN {severity} >= 4 THEN 2 ELSE 1 END"


def _rescore(severity: str, blast: str, related: str, model: str) -> str:
    top = f"greatest({_gate_number(severity)}, {_number(blast)}, {_number(model)})"
    raised = f"{top} + CASE WHEN {related} >= 3 OR ({related} >= 1 AND {top} < 3) THEN 1 ELSE 0 END"
    return _level(f"(CASE WHEN {_number(blast)} = 4 THEN 4 ELSE least({raised}, 4) END)")


KNOWN = "[" + ", ".join(_q(row[0]) for row in TECHNIQUES) + "]"
_NOW = "1706745600"
_WINDOW = "t.event_time BETWEEN f.center_time - INTERVAL 2 HOUR AND f.center_time + INTERVAL 2 HOUR"

# Named pieces, in an order in which each only needs earlier ones.
PIECES: dict[str, str] = {
    "f": d.FINDINGS,
    "t0": d.TRAIL,
    "p": d.PRINCIPALS,
    "a": d.ATTACHED,
    "i": d.INLINE,
    "g": d.GROUPS,
    "r": d.RESPONSES,
    "c": d.CLAIMS,
    "arr": d.ARRIVALS,
    "docs": d.DOCUMENTS,
    "lk": d.LOOKUPS,
    "lab": d.LABELS,
    "labres": d.LABEL_RESULTS,
}

_PLAIN: dict[str, str] = {
    "dim": _values([row for row in TECHNIQUES], "technique_id, name, description, tactic"),
    "t": "SELECT DISTINCT * FROM t0",
    # Of the events without an id a window has the newest only.
    "pairs": f"""SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY event_time DESC, event_id DESC NULLS LAST) AS rn
        FROM (SELECT f.finding_id, t.*, row_number() OVER (PARTITION BY f.finding_id, t.event_id IS NULL ORDER BY t.event_time DESC) AS of_kind
              FROM f JOIN t ON f.access_key_id = t.access_key_id AND {_WINDOW}) AS met WHERE event_id IS NOT NULL OR of_kind = 1""",
    "capped": "SELECT * FROM pairs WHERE rn <= 200",
    "tl": """SELECT f.finding_id, count(k.access_key_id) AS n_events,
        coalesce(string_agg(k.event_id, ',' ORDER BY k.event_time, k.event_id NULLS FIRST), '') AS event_ids,
        min(k.event_time) AS first_time,
        arg_min(k.request_parameters, (k.event_time, k.event_id)) AS first_params
        FROM f LEFT JOIN capped AS k ON f.finding_id = k.finding_id GROUP BY f.finding_id""",
    "calls": """SELECT finding_id, string_agg(event_name, ', ' ORDER BY event_time, event_id) AS names FROM (
        SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY event_time, event_id) AS nth FROM (
          SELECT *, row_number() OVER (PARTITION BY finding_id, event_name ORDER BY event_time, event_id) AS same FROM capped WHERE event_name <> '') AS x
        WHERE same = 1) AS y WHERE nth <= 10 GROUP BY finding_id""",
    "ips": """SELECT finding_id, string_agg(source_ip, ', ' ORDER BY event_time, event_id) AS ips FROM (
        SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY event_time, event_id) AS nth FROM (
          SELECT *, row_number() OVER (PARTITION BY finding_id, source_ip ORDER BY event_time, event_id) AS same FROM capped WHERE source_ip <> '') AS x
        WHERE same = 1) AS y WHERE nth <= 5 GROUP BY finding_id""",
    "aband": """SELECT *, CASE WHEN policy_name = 'AdministratorAccess' THEN 4
          WHEN policy_name IN ('IAMFullAccess', 'PowerUserAccess', 'SecretsManagerReadWrite', 'AdministratorAccess-Amplify')
            OR policy_name LIKE '%FullAccess' OR policy_name LIKE '%SecretsManager%' OR policy_name LIKE '%KeyManagementService%' THEN 3
          WHEN policy_name LIKE '%ReadOnlyAccess' OR policy_name IN ('SecurityAudit', 'ViewOnlyAccess') THEN 2 ELSE 1 END AS band FROM a""",
    "st": """SELECT kind, user_name, policy_name, unnest(CASE json_type(doc, '$.Statement') WHEN 'ARRAY' THEN json_extract(doc, '$.Statement[*]')
          WHEN 'OBJECT' THEN [json_extract(doc, '$.Statement')] ELSE [] END) AS s
        FROM (SELECT *, try_cast(url_decode(document) AS JSON) AS doc FROM i) AS decoded""",
    "sa": """SELECT *, CASE json_type(s, '$.Action') WHEN 'ARRAY' THEN json_extract_string(s, '$.Action[*]') WHEN 'VARCHAR' THEN [json_extract_string(s, '$.Action')] ELSE [] END AS acts,
          CASE json_type(s, '$.Resource') WHEN 'ARRAY' THEN json_extract_string(s, '$.Resource[*]') WHEN 'VARCHAR' THEN [json_extract_string(s, '$.Resource')] ELSE [] END AS ress FROM st""",
    "iband": """SELECT i.kind, i.user_name, i.policy_name, coalesce(max(CASE
            WHEN json_extract_string(s, '$.Effect') IS DISTINCT FROM 'Allow' THEN 1
            WHEN list_contains(acts, '*') AND list_contains(ress, '*') THEN 4
            WHEN len(list_filter(acts, lambda x: (x LIKE '%:*' AND list_contains(ress, '*')) OR lower(x) LIKE '%secretsmanager%' OR lower(x) LIKE '%iam:%')) > 0 THEN 3
            ELSE 1 END), 1) AS band
        FROM i LEFT JOIN sa ON i.kind = sa.kind AND i.user_name = sa.user_name AND i.policy_name = sa.policy_name GROUP BY i.kind, i.user_name, i.policy_name""",
    "blast": f"""SELECT p.kind, p.user_name, {_level("greatest(coalesce((SELECT max(band) FROM aband WHERE aband.kind = p.kind AND aband.user_name = p.user_name), 1), coalesce((SELECT max(band) FROM iband WHERE iband.kind = p.kind AND iband.user_name = p.user_name), 1))")} AS blast_radius,
        coalesce((SELECT string_agg(policy_name, ',' ORDER BY policy_name) FROM a WHERE a.kind = p.kind AND a.user_name = p.user_name), '') AS attached_policies,
        coalesce((SELECT string_agg(policy_name, ',' ORDER BY policy_name) FROM i WHERE i.kind = p.kind AND i.user_name = p.user_name), '') AS inline_policies,
        coalesce((SELECT string_agg(group_name, ',' ORDER BY group_name) FROM g WHERE p.kind = 'user' AND g.user_name = p.user_name), '') AS groups
        FROM p""",
    "prof": """SELECT f.finding_id, CASE WHEN lower(f.user_type) = 'iamuser' THEN 'user' ELSE 'role' END AS kind, f.user_name,
          coalesce(b.blast_radius, 'UNKNOWN') AS blast_radius, coalesce(b.attached_policies, '') AS attached
        FROM f LEFT JOIN blast AS b ON b.user_name = f.user_name AND b.kind = CASE WHEN lower(f.user_type) = 'iamuser' THEN 'user' ELSE 'role' END""",
    "others": """SELECT f.finding_id, o.finding_id AS other_id, row_number() OVER (PARTITION BY f.finding_id ORDER BY o.center_time DESC, o.finding_id) AS rn
        FROM f JOIN f AS o ON f.principal_id = o.principal_id AND o.finding_id <> f.finding_id WHERE f.detector_id IS NOT NULL""",
    "rel": """SELECT f.finding_id, count(o.other_id) AS related_count, coalesce(string_agg(CASE WHEN o.rn <= 10 THEN o.other_id END, ',' ORDER BY o.rn), '') AS related_ids
        FROM f LEFT JOIN others AS o ON f.finding_id = o.finding_id GROUP BY f.finding_id""",
    "rj": """SELECT *, try_cast(brief_json AS JSON) AS j FROM r""",
    "typed": """SELECT *, j IS NOT NULL AND json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['affected_resources', 'attack_techniques', 'confidence', 'recommended_actions', 'severity', 'summary']
          AND json_extract_string(j, '$.severity') IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') AND json_extract_string(j, '$.confidence') IN ('low', 'medium', 'high') AS good FROM rj""",
    "att": """SELECT *, CASE WHEN error_type = 'client_init_error' THEN 'client_init_error' WHEN error_type IS NOT NULL THEN concat('api_error:', error_type)
          WHEN stop_reason IN ('refusal', 'max_tokens') THEN stop_reason WHEN NOT good THEN 'no_parsed_output' END AS reason,
          CASE WHEN good THEN json_extract_string(j, '$.attack_techniques[*].technique_id') END AS ids,
          CASE WHEN good THEN json_extract_string(j, '$.attack_techniques[*].name') END AS names,
          CASE WHEN good THEN json_extract_string(j, '$.affected_resources[*]') END AS resources,
          CASE WHEN good THEN json_extract_string(j, '$.recommended_actions[*]') END AS actions,
          CASE WHEN good THEN json_extract_string(j, '$.severity') END AS severity,
          CASE WHEN good THEN json_extract_string(j, '$.confidence') END AS confidence,
          CASE WHEN good THEN json_extract_string(j, '$.summary') END AS summary FROM typed""",
    "cited": """SELECT finding_id, attempt, unnest(ids) AS technique_id, unnest(names) AS name FROM att WHERE good""",
    "flags": f"""SELECT a1.*, CASE WHEN good THEN len(ids) = 0 OR len(list_filter(ids, lambda x: list_contains({KNOWN}, x))) > 0 END AS valid FROM att AS a1""",
    "steps": """SELECT x.finding_id, x.reason IS NULL AND NOT x.valid AND y.finding_id IS NOT NULL AS second, x.processing_ms AS ms1, y.processing_ms AS ms2,
          x.input_tokens AS in1, x.output_tokens AS out1, y.input_tokens AS in2, y.output_tokens AS out2
        FROM (SELECT * FROM flags WHERE attempt = 1) AS x LEFT JOIN (SELECT * FROM flags WHERE attempt = 2) AS y ON x.finding_id = y.finding_id""",
    "res": """SELECT v.finding_id, v.attempt AS attempts, CASE WHEN v.reason IS NULL AND NOT v.valid THEN 'validation_failed' ELSE v.reason END AS reason,
          v.good AND v.valid AND v.reason IS NULL AS has_brief, v.ids, v.names, v.resources, v.actions, v.severity AS model_severity, v.confidence, v.summary, v.request_id,
          ms1 + CASE WHEN second THEN ms2 ELSE 0 END AS processing_ms, v.input_tokens, v.output_tokens, v.cache_read_input_tokens,
          coalesce(in1, 0) + CASE WHEN second THEN coalesce(in2, 0) ELSE 0 END AS all_input_tokens,
          coalesce(out1, 0) + CASE WHEN second THEN coalesce(out2, 0) ELSE 0 END AS all_output_tokens
        FROM flags AS v JOIN steps AS s ON v.finding_id = s.finding_id AND v.attempt = CASE WHEN s.second THEN 2 ELSE 1 END""",
    "ev": """SELECT f.finding_id, concat_ws('|', f.finding_id, f.type, f.title, f.region, f.resource_type, f.access_key_id, f.principal_id, f.user_type, f.user_name, f.instance_id,
          prof.attached, rel.related_ids,
          (SELECT string_agg(concat_ws('|', event_name, event_source, username, source_ip, aws_region, error_code, error_message), '|') FROM capped WHERE capped.finding_id = f.finding_id)) AS evidence
        FROM f JOIN prof ON prof.finding_id = f.finding_id JOIN rel ON rel.finding_id = f.finding_id""",
    "dec": f"""SELECT f.finding_id, f.type, f.severity, f.user_name, f.access_key_id, f.instance_id, f.ingest_time, prof.blast_radius, rel.related_count, tl.n_events, ev.evidence,
          CASE WHEN res.finding_id IS NULL THEN 'no_response' ELSE res.reason END AS reason, coalesce(res.has_brief, false) AS has_brief,
          res.ids, res.names, res.resources, res.actions, res.model_severity, res.confidence, res.summary, res.request_id, res.processing_ms, res.input_tokens, res.output_tokens,
          res.all_input_tokens, res.all_output_tokens,
          {_rescore('f.severity', 'prof.blast_radius', 'rel.related_count', "CASE WHEN res.has_brief THEN res.model_severity ELSE 'LOW' END")} AS final_severity
        FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id JOIN tl ON f.finding_id = tl.finding_id
        JOIN ev ON f.finding_id = ev.finding_id LEFT JOIN res ON f.finding_id = res.finding_id""",
    # Outcomes without timelines, for the metrics.
    "lo": f"""SELECT f.finding_id, f.ingest_time AS ts, prof.blast_radius, rel.related_count, res.* EXCLUDE (finding_id, reason, has_brief), coalesce(res.has_brief, false) AS has_brief,
          CASE WHEN res.finding_id IS NULL THEN 'no_response' ELSE res.reason END AS reason, NOT coalesce(res.has_brief, false) AS degraded,
          coalesce(res.input_tokens, 0) * 0.000005 + coalesce(res.output_tokens, 0) * 0.000025 AS cost_usd,
          CASE WHEN res.has_brief THEN len(res.actions) ELSE 0 END AS action_count,
          {_rescore('f.severity', 'prof.blast_radius', 'rel.related_count', "CASE WHEN res.has_brief THEN res.model_severity ELSE 'LOW' END")} AS final_severity
        FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id LEFT JOIN res ON f.finding_id = res.finding_id""",
    "arn": """SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingest_time) AS nth FROM arr WHERE finding_id <> ''""",
    "active": f"SELECT finding_id FROM c WHERE expires_at > {_NOW}",
    # FULL outcome table of the gated arrivals.
    "outc": """SELECT n.finding_id, CASE WHEN n.nth > 1 OR n.finding_id IN (SELECT finding_id FROM active) THEN 'skipped' WHEN dec.has_brief THEN 'analyzed' ELSE 'degraded' END AS status,
          n.ingest_time AS ts FROM arn AS n JOIN dec ON dec.finding_id = n.finding_id WHERE n.severity >= 7""",
}

# The order the pieces above are listed in is the order they are defined in.
PIECES.update(_PLAIN)


def _names_in(sql: str) -> set[str]:
    import re

    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z0-9_]+)", sql))
    return words & PIECES.keys()


def build(final: str) -> str:
    """The final SELECT with every piece it needs in front."""
    needed: set[str] = set()
    waiting = _names_in(final)
    while waiting:
        name = waiting.pop()
        if name not in needed:
            needed.add(name)
            waiting |= _names_in(PIECES[name])
    given = {"events": "events", "documents": "documents", "labels": "labels"}
    raw = set(PIECES) - set(_PLAIN)
    parts = [f"{n} AS MATERIALIZED ({(PIECES[n].format(**given) if n in raw else PIECES[n]).strip()})" for n in PIECES if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final.strip()


_KEPT = f"list_filter(ids, lambda x: list_contains({KNOWN}, x))"
_DROPPED = f"list_filter(ids, lambda x: NOT list_contains({KNOWN}, x))"
_KEPT_RES = "array_to_string(list_filter(resources, lambda x: trim(x) <> '' AND contains(evidence, trim(x))), '|')"
_DROPPED_RES = "array_to_string(list_filter(resources, lambda x: NOT (trim(x) <> '' AND contains(evidence, trim(x)))), '|')"
_NUMBERED = "coalesce(array_to_string(list_transform(range(1, len(actions) + 1), lambda k: concat(k, '. ', actions[k])), chr(10)), '')"
_PAIRED = f"list_filter(list_zip(ids, names), lambda x: list_contains({KNOWN}, x[1]))"


def _periods(columns: str, source: str) -> str:
    return f"SELECT {_text('time_bucket(INTERVAL 5 MINUTE, ts)')} AS window_start, {columns} FROM {source} GROUP BY 1"


# A p90 from a sketch is any value of about the right rank, so it is its rank that is compared.
_HOURS = f"""SELECT {_text('w')} AS window_start, count(*) AS n, round(avg(ms), 6) AS avg_ms, true AS p90_near
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, processing_ms AS ms FROM lo WHERE processing_ms IS NOT NULL) AS x GROUP BY w"""

FINALS: dict[str, str] = {
    "trail_interval_join": f"SELECT f.finding_id, k.event_id, k.event_name, {_text('k.event_time')} AS event_time FROM f LEFT JOIN capped AS k ON f.finding_id = k.finding_id",
    "trail_dedup": "SELECT access_key_id, event_id, event_name, source_ip FROM t",
    "trail_topk": "SELECT finding_id, event_id FROM pairs WHERE rn <= 2 AND event_id IS NOT NULL",
    "timeline_collect": "SELECT finding_id, event_ids FROM tl",
    "trail_table_timeline": "SELECT finding_id, event_id FROM pairs WHERE rn <= 20 AND event_id IS NOT NULL",
    "trail_table_activity": """SELECT access_key_id, epoch_us(event_time) // 3600000000 AS span, count(DISTINCT epoch_us(event_time) // 60000000) AS minutes,
        CAST(sum(CASE WHEN event_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_named, CAST(sum(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unnamed
        FROM t GROUP BY 1, 2""",
    "event_count": "SELECT finding_id, n_events FROM tl",
    "distinct_api_calls": "SELECT f.finding_id, coalesce(replace(names, ', ', ','), '') AS api_calls FROM f LEFT JOIN calls ON f.finding_id = calls.finding_id",
    "distinct_source_ips": "SELECT f.finding_id, coalesce(replace(ips, ', ', ','), '') AS source_ips FROM f LEFT JOIN ips ON f.finding_id = ips.finding_id",
    "related_count": "SELECT finding_id, related_count FROM rel",
    "related_history_count": """SELECT f.finding_id, count(o.finding_id) AS related_count FROM f LEFT JOIN f AS o ON f.principal_id = o.principal_id AND f.finding_id <> o.finding_id
        AND o.severity >= 4 AND f.detector_id IS NOT NULL GROUP BY f.finding_id""",
    "related_topk": "SELECT finding_id, related_ids FROM rel",
    "principal_lookup": "SELECT finding_id, kind, user_name, blast_radius FROM prof",
    "policy_lists": "SELECT kind, user_name, attached_policies, inline_policies, groups FROM blast",
    "managed_policy_band": f"SELECT kind, user_name, policy_name, {_level('band')} AS band FROM aband",
    "policy_document_decode": """SELECT i.kind, i.user_name, count(s) AS n_statements,
        coalesce(string_agg(array_to_string(acts, ','), ',') FILTER (WHERE len(acts) > 0), '') AS actions,
        coalesce(string_agg(array_to_string(ress, ','), ',') FILTER (WHERE len(ress) > 0), '') AS resources
        FROM i LEFT JOIN sa ON i.kind = sa.kind AND i.user_name = sa.user_name AND i.policy_name = sa.policy_name GROUP BY i.kind, i.user_name, i.policy_name""",
    "policy_document_band": f"SELECT kind, user_name, policy_name, {_level('band')} AS band FROM iband",
    "blast_radius": "SELECT kind, user_name, blast_radius FROM blast",
    "enrich_bundle": f"""SELECT f.finding_id, f.type, f.user_name, {_iso('f.center_time')} AS time, prof.blast_radius, prof.attached, rel.related_count,
        CASE WHEN rel.related_count > 10 THEN 10 ELSE rel.related_count END AS n_summaries, tl.n_events, {_iso('tl.first_time')} AS first_event,
        cast(json_extract_string(tl.first_params, '$.k') AS BIGINT) AS first_k, f.access_key_id, f.instance_id
        FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id JOIN tl ON f.finding_id = tl.finding_id""",
    "severity_gate": "SELECT finding_id, severity FROM f WHERE severity >= 7",
    "missing_id_skip": f"SELECT CAST(NULL AS VARCHAR) AS finding_id, 'skipped' AS status, 'no_finding_id' AS reason, {_text('ingest_time')} AS ts FROM arr WHERE finding_id IS NULL OR finding_id = ''",
    "claim_antijoin": """SELECT finding_id, CASE WHEN nth = 1 AND finding_id NOT IN (SELECT finding_id FROM active) THEN 'triaged' ELSE 'skipped' END AS status,
        CASE WHEN nth = 1 AND finding_id NOT IN (SELECT finding_id FROM active) THEN NULL ELSE 'already_triaged' END AS reason FROM arn
        UNION ALL SELECT NULL, 'skipped', 'no_finding_id' FROM arr WHERE finding_id IS NULL OR finding_id = ''""",
    "already_triaged": "SELECT f.finding_id FROM f WHERE f.finding_id IN (SELECT finding_id FROM active)",
    # The last batch up to the ninth whose number the id's last digit and one divides; batches from the sixth on still hold.
    "claim_ledger": f"""SELECT finding_id, cast(CASE WHEN last > 0 THEN 1600000000 + last * 20000000 ELSE old END AS BIGINT) AS expires_at FROM (
        SELECT coalesce(f.finding_id, c.finding_id) AS finding_id, coalesce(9 - 9 % (cast(substring(f.finding_id, 3) AS BIGINT) % 10 + 1), 0) AS last, c.expires_at AS old
        FROM f FULL JOIN c ON f.finding_id = c.finding_id) AS x
        WHERE CASE WHEN last > 0 THEN 1600000000 + last * 20000000 ELSE old END > {_NOW}""",
    "claims_upsert": f"""SELECT finding_id, cast({_NOW} + 604800 AS BIGINT) AS expires_at FROM f WHERE severity >= 7
        UNION ALL SELECT c.finding_id, c.expires_at FROM c WHERE c.expires_at > {_NOW} AND c.finding_id NOT IN (SELECT finding_id FROM f WHERE severity >= 7)""",
    "degraded_reason": "SELECT finding_id, attempt, reason FROM att",
    "brief_contract": "SELECT finding_id, attempt, good AS well_formed, severity, confidence, len(ids) AS n_techniques FROM att",
    "technique_allowlist": f"SELECT finding_id, attempt, array_to_string({_KEPT}, ',') AS kept, array_to_string({_DROPPED}, ',') AS dropped FROM att WHERE good",
    "technique_semi_anti": """SELECT CASE WHEN technique_id IN (SELECT technique_id FROM dim) THEN 'kept' ELSE 'dropped' END AS side, technique_id, count(*) AS n FROM cited GROUP BY 1, 2""",
    "technique_lookup": "SELECT c.finding_id, c.attempt, c.technique_id, c.name, dim.name AS canonical, dim.description, dim.tactic FROM cited AS c LEFT JOIN dim ON c.technique_id = dim.technique_id",
    "evidence_text": """SELECT ev.finding_id, contains(evidence, ev.finding_id) AS names_finding, coalesce(contains(evidence, f.access_key_id), false) AS names_key,
        contains(evidence, 'denied for u') AS names_error, contains(evidence, 'AdministratorAccess') AS names_admin, contains(evidence, 'bucket-') AS names_bucket
        FROM ev JOIN f ON ev.finding_id = f.finding_id""",
    "resource_grounding": f"SELECT finding_id, {_KEPT_RES} AS kept, {_DROPPED_RES} AS dropped FROM dec WHERE has_brief",
    "grounding_theta_join": """SELECT x.finding_id, x.attempt, x.resource, trim(x.resource) <> '' AND contains(ev.evidence, trim(x.resource)) AS grounded
        FROM (SELECT finding_id, attempt, unnest(resources) AS resource FROM att WHERE good) AS x JOIN ev ON x.finding_id = ev.finding_id""",
    "validity_flag": "SELECT finding_id, attempt, valid FROM flags WHERE good",
    "attempt_resolution": "SELECT finding_id, attempts, reason, request_id, processing_ms, input_tokens, all_output_tokens, has_brief FROM res",
    "severity_band": f"SELECT finding_id, {_level(_gate_number('severity'))} AS band, {_gate_number('severity')} AS band_number FROM f",
    "rescore": f"SELECT finding_id, {_rescore('severity', _q('UNKNOWN'), 'related_count', 'model_severity')} AS final_severity FROM labres",
    "triage_hard_signals": f"""SELECT f.finding_id, f.severity, prof.blast_radius, rel.related_count, tl.n_events, {_rescore('f.severity', 'prof.blast_radius', 'rel.related_count', _q('LOW'))} AS final_severity
        FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id JOIN tl ON f.finding_id = tl.finding_id WHERE f.severity >= 7""",
    "triage_outcomes": f"""SELECT o.finding_id, o.status, CASE WHEN o.status = 'skipped' THEN 'already_triaged' ELSE dec.reason END AS reason,
        CASE WHEN o.status <> 'skipped' THEN dec.final_severity END AS final_severity, CASE WHEN o.status <> 'skipped' THEN dec.blast_radius END AS blast_radius,
        CASE WHEN o.status <> 'skipped' THEN dec.related_count END AS related_count,
        CASE WHEN o.status = 'analyzed' THEN len(dec.actions) WHEN o.status = 'degraded' THEN 0 END AS action_count,
        CASE WHEN o.status <> 'skipped' THEN dec.processing_ms END AS processing_ms, CASE WHEN o.status <> 'skipped' THEN dec.request_id END AS request_id,
        CASE WHEN o.status <> 'skipped' THEN round(coalesce(dec.input_tokens, 0) * 0.000005 + coalesce(dec.output_tokens, 0) * 0.000025, 6) END AS cost_usd,
        CASE WHEN o.status <> 'skipped' THEN round(coalesce(dec.all_input_tokens, 0) * 0.000005 + coalesce(dec.all_output_tokens, 0) * 0.000025, 6) END AS total_cost_usd,
        {_text('o.ts')} AS ts FROM outc AS o JOIN dec ON o.finding_id = dec.finding_id
        UNION ALL SELECT NULL, 'skipped', 'no_finding_id', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_text('ingest_time')} FROM arr WHERE (finding_id IS NULL OR finding_id = '') AND severity >= 7""",
    "strip_control_chars": """SELECT doc_id, length(spiked) AS before, length(clean) AS after, md5(clean) AS digest FROM (
        SELECT doc_id, spiked, regexp_replace(spiked, '[' || chr(7) || chr(8203) || chr(8238) || chr(8232) || ']', '', 'g') AS clean FROM (
          SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(7), chr(8203), chr(8238), chr(8232), ' end', chr(9), chr(10)) ELSE text END AS spiked FROM documents) AS x) AS y""",
    "truncate_field": """SELECT page_id, length(cut) AS n_chars, md5(cut) AS digest FROM (
        SELECT page_id, CASE WHEN length(html) > 2000 THEN concat(substring(html, 1, 2000), '...[truncated]') ELSE html END AS cut FROM pages) AS x""",
    "scrub_nested": """SELECT conv_id, turn, role, md5(CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), '...[truncated]') ELSE text END) AS body, turn AS kept_turn, 'x' AS second FROM conversations""",
    "scrub_parameters": """SELECT event_id, event_id AS k, concat('bucket u', user_id) AS bucket, md5(concat(event_type, chr(92), 'u0007', chr(10), '"end')) AS deep,
        md5(CASE WHEN length(long) > 2000 THEN concat(substring(long, 1, 2000), '...[truncated]') ELSE long END) AS long, 4 AS n_items, true AS is_clean
        FROM (SELECT event_id, user_id, event_type, repeat('ab', cast(980 + event_id % 40 AS INT)) AS long FROM events) AS x""",
    "canonical_json": "SELECT doc_id, md5(text) AS text_digest, n_chars, true AS is_ascii, 'Lang' AS first_key FROM documents",
    "fence_block": """SELECT doc_id, md5(concat('<untrusted_data>', chr(10), replace(replace(cut, '<', '\\u003c'), '>', '\\u003e'), chr(10), '</untrusted_data>')) AS digest, length(bare) > 5000 AS truncated,
        1 AS n_open, 1 AS n_close FROM (SELECT *, CASE WHEN length(bare) > 5000 THEN concat(substring(bare, 1, 5000), '...[truncated]') ELSE bare END AS cut FROM (
          SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('<untrusted_data>', text) ELSE text END AS bare FROM documents) AS x) AS y""",
    "prompt_table": """SELECT f.finding_id, f.type, tl.n_events, cast(json_extract_string(tl.first_params, '$.k') AS BIGINT) AS first_k, rel.related_count, false AS truncated, true AS framed
        FROM f JOIN tl ON f.finding_id = tl.finding_id JOIN rel ON f.finding_id = rel.finding_id""",
    "technique_reference": "SELECT dim.technique_id, count(*) AS n, concat('- ', dim.technique_id, ' ', dim.name, ' — ', dim.description) AS line FROM cited AS c JOIN dim ON c.technique_id = dim.technique_id GROUP BY dim.technique_id, dim.name, dim.description",
    "notification_text": f"""SELECT finding_id, substring(concat(CASE final_severity WHEN 'LOW' THEN ':large_blue_circle:' WHEN 'MEDIUM' THEN ':large_yellow_circle:' WHEN 'HIGH' THEN ':large_orange_circle:' ELSE ':red_circle:' END,
          ' ', final_severity, ' — ', type), 1, 150) AS header, summary,
        concat_ws(' / ', concat('*Final severity:*', chr(10), final_severity), concat('*Confidence:*', chr(10), confidence), concat('*IAM blast radius:*', chr(10), blast_radius),
          concat('*GuardDuty severity:*', chr(10), severity), concat('*Principal:*', chr(10), coalesce(user_name, 'unknown')), concat('*Related findings:*', chr(10), related_count)) AS fields,
        coalesce(array_to_string(list_transform({_PAIRED}, lambda x: concat('`', x[1], '` ', x[2])), '  '), '') AS tags, {_NUMBERED} AS actions,
        concat('finding `', finding_id, '` · <https://us-east-1.console.aws.amazon.com/s3/object/reports?region=us-east-1&prefix=reports/', finding_id, '/2024-02-01T00:00:00.000000+00:00.json|full report>') AS context
        FROM dec WHERE has_brief""",
    "degraded_text": """SELECT dec.finding_id, concat('The job could not produce an AI brief (reason: `', reason, '`). Raw enriched context below for manual triage.') AS lead,
        concat_ws(' / ', concat('*Finding:*', chr(10), type), concat('*GuardDuty severity:*', chr(10), severity), concat('*IAM blast radius:*', chr(10), blast_radius), concat('*Related findings:*', chr(10), related_count),
          concat('*CloudTrail events:*', chr(10), n_events), concat('*Principal:*', chr(10), coalesce(user_name, 'unknown'))) AS fields,
        CASE WHEN calls.names IS NOT NULL THEN concat('*Recent API calls:* ', calls.names, chr(10), '*Source IPs:* ', coalesce(ips.ips, 'n/a')) END AS activity
        FROM dec LEFT JOIN calls ON dec.finding_id = calls.finding_id LEFT JOIN ips ON dec.finding_id = ips.finding_id WHERE NOT has_brief""",
    "notification_rows": f"""SELECT dec.finding_id, CASE WHEN has_brief THEN 4 + CASE WHEN len({_KEPT}) > 0 THEN 1 ELSE 0 END + CASE WHEN len(actions) > 0 THEN 1 ELSE 0 END
          ELSE 4 + CASE WHEN calls.names IS NOT NULL THEN 1 ELSE 0 END END AS n_blocks,
        CASE WHEN has_brief THEN concat(CASE final_severity WHEN 'LOW' THEN ':large_blue_circle:' WHEN 'MEDIUM' THEN ':large_yellow_circle:' WHEN 'HIGH' THEN ':large_orange_circle:' ELSE ':red_circle:' END,
          ' ', final_severity, ' — ', type) ELSE ':warning: AI analysis unavailable — manual triage needed' END AS header, 'context' AS last_type
        FROM dec LEFT JOIN calls ON dec.finding_id = calls.finding_id""",
    "brief_view": f"""SELECT f.finding_id, f.type, CASE WHEN att.good AND att.reason IS NULL THEN 'analyzed' ELSE 'degraded' END AS status, CASE WHEN att.finding_id IS NULL THEN 'no_response' ELSE att.reason END AS reason,
        {_rescore('f.severity', 'prof.blast_radius', 'rel.related_count', "coalesce(att.severity, 'LOW')")} AS final_severity, att.confidence, tl.n_events AS event_count, att.summary,
        CASE WHEN att.good THEN array_to_string(list_transform({_PAIRED}, lambda x: concat(x[1], '  ', x[2])), chr(10)) END AS techniques, CASE WHEN att.good THEN {_NUMBERED} END AS actions,
        array_to_string({_DROPPED}, ',') AS dropped_techniques, {_DROPPED_RES} AS dropped_resources, att.request_id
        FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id JOIN tl ON f.finding_id = tl.finding_id JOIN ev ON f.finding_id = ev.finding_id
        LEFT JOIN (SELECT * FROM att WHERE attempt = 1) AS att ON f.finding_id = att.finding_id""",
    "audit_rows": "SELECT finding_id, '2024-02-01T00:00:00.000000+00:00' AS timestamp, final_severity, blast_radius, action_count, processing_ms, degraded, request_id, reason FROM lo",
    "report_rows": """SELECT finding_id, concat('reports/', finding_id, '/2024-02-01T00:00:00.000000+00:00.json') AS key, final_severity, CASE WHEN NOT has_brief THEN true END AS degraded,
        CASE WHEN NOT has_brief THEN reason END AS reason, CASE WHEN has_brief THEN model_severity END AS model_severity, CASE WHEN has_brief THEN output_tokens END AS output_tokens, access_key_id FROM dec""",
    "cost_estimate": "SELECT finding_id, attempt, round(coalesce(input_tokens, 0) * 0.000005 + coalesce(output_tokens, 0) * 0.000025, 6) AS cost_usd FROM r",
    "metrics_long": """SELECT finding_id, metric, round(value, 6) AS value, 'prod' AS stage FROM (
        SELECT finding_id, 'ProcessingTimeMs' AS metric, cast(processing_ms AS DOUBLE) AS value FROM lo UNION ALL SELECT finding_id, 'InputTokens', coalesce(input_tokens, 0) FROM lo
        UNION ALL SELECT finding_id, 'OutputTokens', coalesce(output_tokens, 0) FROM lo UNION ALL SELECT finding_id, 'EstCostUSD', cost_usd FROM lo
        UNION ALL SELECT finding_id, 'Failures', CASE WHEN degraded THEN 1 ELSE 0 END FROM lo) AS x""",
    "latency_5min": _periods("round(avg(processing_ms), 6) AS avg_ms, round(quantile_cont(processing_ms, 0.9), 6) AS p90_ms", "lo"),
    "cost_tokens_5min": _periods("round(sum(cost_usd), 6) AS cost_usd, cast(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, cast(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens", "lo"),
    "outcomes_5min": _periods("count(*) AS invocations, count(*) FILTER (WHERE degraded) AS degraded",
        "(SELECT ts, degraded FROM lo UNION ALL SELECT ingest_time, NULL FROM arn WHERE nth > 1 UNION ALL SELECT ingest_time, NULL FROM arr WHERE finding_id IS NULL OR finding_id = '') AS x"),
    "eval_rows": f"""SELECT lab.name, lab.expected_severity AS expected, CASE WHEN NOT x.degraded THEN x.model_severity END AS model, CASE WHEN x.degraded THEN 'DEGRADED' ELSE x.final_severity END AS final,
        NOT x.degraded AND x.final_severity = lab.expected_severity AS match, x.processing_ms AS ms, x.degraded
        FROM lab JOIN (SELECT *, {_rescore('severity', _q('UNKNOWN'), 'related_count', 'model_severity')} AS final_severity FROM labres) AS x ON lab.finding_id = x.finding_id""",
    "eval_summary": f"""SELECT count(*) AS count, count(*) FILTER (WHERE NOT x.degraded AND x.final_severity = lab.expected_severity) AS matches,
        round(count(*) FILTER (WHERE NOT x.degraded AND x.final_severity = lab.expected_severity) / count(*), 6) AS accuracy, cast(floor(sum(x.processing_ms) / count(*)) AS BIGINT) AS mean_ms
        FROM lab JOIN (SELECT *, {_rescore('severity', _q('UNKNOWN'), 'related_count', 'model_severity')} AS final_severity FROM labres) AS x ON lab.finding_id = x.finding_id""",
    "evaluate_labeled": f"""SELECT concat('case-', y.finding_id) AS name, y.expected, CASE WHEN y.good THEN y.model END AS model, CASE WHEN y.good THEN y.final ELSE 'DEGRADED' END AS final,
        y.good AND y.final = y.expected AS match, y.ms, NOT y.good AS degraded FROM (
          SELECT f.finding_id, {_level(_gate_number('f.severity'))} AS expected, coalesce(att.good AND att.reason IS NULL, false) AS good, att.severity AS model, att.processing_ms AS ms,
            {_rescore('f.severity', 'prof.blast_radius', 'rel.related_count', "coalesce(att.severity, 'LOW')")} AS final
          FROM f JOIN prof ON f.finding_id = prof.finding_id JOIN rel ON f.finding_id = rel.finding_id LEFT JOIN (SELECT * FROM att WHERE attempt = 1) AS att ON f.finding_id = att.finding_id) AS y""",
    "labeled_scan": """SELECT name, expected_severity, finding_id, CASE expected_severity WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.0 ELSE 2.0 END::DOUBLE AS severity, 'Recon:IAMUser/X' AS type,
        '2024-02-01 00:00:00.000000' AS center_time FROM lab""",
    "dimension_check": """SELECT DISTINCT technique_id, 'not in dimension' AS side FROM cited WHERE technique_id NOT IN (SELECT technique_id FROM dim)
        UNION ALL SELECT technique_id, 'never cited' FROM dim WHERE technique_id NOT IN (SELECT technique_id FROM cited)""",
    "finding_envelope": """SELECT event_id, CASE event_id % 4 WHEN 1 THEN json_extract_string(document, '$.detail.id') WHEN 2 THEN json_extract_string(document, '$.Findings[0].Id')
          ELSE coalesce(json_extract_string(document, '$.Id'), json_extract_string(document, '$.id')) END AS id,
        cast(CASE event_id % 4 WHEN 1 THEN json_extract_string(document, '$.detail.severity') WHEN 2 THEN json_extract_string(document, '$.Findings[0].Severity')
          ELSE json_extract_string(document, '$.Severity') END AS DOUBLE) AS severity FROM docs
        UNION ALL SELECT event_id, 'second', NULL FROM docs WHERE event_id % 4 = 2""",
    "finding_envelope_every": """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE json_extract_string(document, '$.Id') END AS pascal_id FROM docs WHERE event_id % 4 <> 2
        UNION ALL SELECT event_id, unnest(json_extract_string(document, '$.Findings[*].Id')) FROM docs WHERE event_id % 4 = 2""",
    "parse_finding": """SELECT event_id, CASE WHEN event_id % 8 = 3 THEN NULL ELSE concat('f-', event_id) END AS finding_id,
        CASE event_id % 4 WHEN 0 THEN 'Recon:IAMUser/X' WHEN 1 THEN 'Stealth:IAMUser/Y' END AS type,
        cast(CASE event_id % 4 WHEN 0 THEN event_id % 10 + 0.5 WHEN 1 THEN event_id % 10 WHEN 2 THEN 8 END AS DOUBLE) AS severity,
        CASE WHEN event_id % 4 = 0 THEN concat('t', event_id) END AS title, CASE event_id % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' END AS region,
        CASE event_id % 4 WHEN 0 THEN 'AccessKey' WHEN 1 THEN 'AccessKey' WHEN 2 THEN 'Instance' END AS resource_type,
        CASE WHEN event_id % 4 < 2 THEN concat('AK', user_id) END AS access_key_id, CASE WHEN event_id % 4 = 0 THEN concat('P', user_id) END AS principal_id,
        CASE WHEN event_id % 4 = 0 THEN 'Role' END AS user_type, CASE WHEN event_id % 4 < 2 THEN concat('u', user_id) END AS user_name,
        CASE WHEN event_id % 4 = 2 THEN concat('i-', event_id) END AS instance_id, CASE WHEN event_id % 4 = 0 THEN 'd1' END AS detector_id
        FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id, 'second', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'error' AND event_id % 4 = 2""",
    "center_time": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('2024-01-0', 1 + event_id % 9, ' 10:20:30.000000') WHEN 1 THEN '2024-01-03 04:05:06.000000'
        WHEN 2 THEN '2024-01-04 00:00:00.000000' ELSE '2024-02-01 00:00:00.000000' END AS center_time FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id, '2024-02-01 00:00:00.000000' FROM events WHERE event_type = 'error' AND event_id % 4 = 2""",
    "trail_flatten": f"""SELECT AccessKeyId AS access_key_id, EventId AS event_id, coalesce(nullif(EventName, ''), json_extract_string(j, '$.eventName')) AS event_name, json_extract_string(j, '$.eventSource') AS event_source,
        coalesce(Username, json_extract_string(j, '$.userIdentity.userName')) AS username, json_extract_string(j, '$.sourceIPAddress') AS source_ip, json_extract_string(j, '$.userAgent') AS user_agent,
        json_extract_string(j, '$.awsRegion') AS aws_region, json_extract_string(j, '$.errorCode') AS error_code, json_extract_string(j, '$.errorMessage') AS error_message,
        {_text('EventTime')} AS event_time, cast(json_extract_string(j, '$.requestParameters.k') AS BIGINT) AS k FROM (SELECT *, try_cast(CloudTrailEvent AS JSON) AS j FROM lk) AS x""",
    "passage_containment": "SELECT DISTINCT d.doc_id, b.item_id FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text) WHERE b.text <> ''",
    "stream_timeline": "SELECT finding_id, event_ids FROM tl",
    "stream_related": "SELECT finding_id, related_count, related_ids FROM rel",
    "latency_hours": _HOURS,
    "stream_latency": _HOURS,
    "stream_claims": f"""SELECT nullif(finding_id, '') AS finding_id, CASE WHEN nth = 1 AND finding_id <> '' THEN 'claimed' ELSE 'skipped' END AS status,
        CASE WHEN coalesce(finding_id, '') = '' THEN 'no_finding_id' WHEN nth > 1 THEN 'already_triaged' END AS reason, {_text('ingest_time')} AS ingest_time
        FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingest_time) AS nth FROM arr) AS numbered""",
    "stream_dedup": "SELECT DISTINCT finding_id FROM arr WHERE finding_id <> ''",
    "stream_triage": """SELECT n.finding_id, CASE WHEN n.nth > 1 THEN 'skipped' WHEN dec.has_brief THEN 'analyzed' ELSE 'degraded' END AS status,
        CASE WHEN n.nth > 1 THEN 'already_triaged' ELSE dec.reason END AS reason, CASE WHEN n.nth = 1 THEN dec.final_severity END AS final_severity,
        CASE WHEN n.nth = 1 THEN dec.related_count END AS related_count, CASE WHEN n.nth = 1 THEN dec.processing_ms END AS processing_ms
        FROM arn AS n JOIN dec ON n.finding_id = dec.finding_id WHERE n.severity >= 7
        UNION ALL SELECT NULL, 'skipped', 'no_finding_id', NULL, NULL, NULL FROM arr WHERE (finding_id IS NULL OR finding_id = '') AND severity >= 7""",
    "stream_interval_join": f"SELECT f.finding_id, t.event_id FROM f JOIN t ON f.access_key_id = t.access_key_id AND {_WINDOW}",
    "stream_metrics": f"""SELECT {_text('w')} AS window_start, round(avg(ms), 6) AS avg_ms, round(quantile_cont(ms, 0.9), 6) AS p90_ms,
        round(coalesce(sum(i * 0.000005 + o * 0.000025), 0), 6) AS cost_usd, cast(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, cast(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, count(*) AS invocations,
        count(*) FILTER (WHERE bad) AS degraded
        FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, CASE WHEN done THEN 7000 + (event_id * 37) % 9000 END AS ms, CASE WHEN done THEN 800 + event_id % 400 END AS i,
                CASE WHEN done THEN 1200 + event_id % 700 END AS o, done AND event_id % 13 < 5 AS bad
              FROM (SELECT *, event_id % 11 <> 0 AS done FROM events WHERE event_type = 'error') AS e) AS x
        GROUP BY w""",
    "stream_audit": """SELECT DISTINCT dec.finding_id, '2024-02-01T00:00:00.000000+00:00' AS timestamp, dec.final_severity, dec.blast_radius,
        cast(CASE WHEN dec.has_brief THEN len(dec.actions) ELSE 0 END AS BIGINT) AS action_count, dec.processing_ms, NOT dec.has_brief AS degraded, dec.request_id, dec.reason
        FROM dec WHERE dec.severity >= 7""",
    # Each id once, with the brief that answers it; only events in the first two forms name a principal.
    "stream_raw_findings": """SELECT concat('f-', e.event_id) AS finding_id, CASE WHEN coalesce(res.has_brief, false) THEN 'analyzed' ELSE 'degraded' END AS status,
        CASE WHEN e.event_id % 4 < 2 THEN coalesce(pb.blast_radius, 'UNKNOWN') ELSE 'UNKNOWN' END AS blast_radius
        FROM events AS e LEFT JOIN res ON res.finding_id = concat('f-', e.event_id)
        LEFT JOIN blast AS pb ON pb.user_name = concat('u', e.user_id) AND pb.kind = 'role'
        WHERE e.event_type = 'error' AND e.event_id % 8 <> 3
        UNION ALL SELECT NULL, 'skipped', NULL FROM events WHERE event_type = 'error' AND event_id % 8 = 3
        UNION ALL SELECT 'second', CASE WHEN row_number() OVER (ORDER BY event_id) = 1 THEN 'degraded' ELSE 'skipped' END,
          CASE WHEN row_number() OVER (ORDER BY event_id) = 1 THEN 'UNKNOWN' END FROM events WHERE event_type = 'error' AND event_id % 4 = 2""",
    "threat_purpose": "SELECT f.finding_id, split_part(f.type, ':', 1) AS purpose, stage, candidates FROM f LEFT JOIN purposes ON purposes.purpose = split_part(f.type, ':', 1)",
    "timeline_signals": "SELECT f.finding_id, "
        + ", ".join(f"coalesce(bool_or(k.event_name IN ({', '.join(_q(c) for c in calls)})), false) AS {name}" for name, calls in SIGNALS.items())
        + " FROM f LEFT JOIN capped AS k ON f.finding_id = k.finding_id GROUP BY f.finding_id",
}

PIECES["purposes"] = _values([(p, s, ",".join(c)) for p, s, c in PURPOSES], "purpose, stage, candidates")
_PLAIN["purposes"] = PIECES["purposes"]


def all_sql() -> dict[str, str]:
    return {name: build(final) for name, final in FINALS.items()}
