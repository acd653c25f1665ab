"""What each query must return, as DuckDB SQL over ``events``.

The answers come from arithmetic on the table, never from message text.
"""

_TEXT = """
    '10.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '.' || (event_id % 256)
        AS source_ipv4,
    10 * 16777216 + ((user_id // 256) % 256) * 65536 + (user_id % 256) * 256 + event_id % 256
        AS source_ip,
    1024 + event_id % 60000 AS source_port,
    (192 + event_id % 8) || '.168.' || (user_id % 256) || '.1' AS dest_ipv4,
    (192 + event_id % 8) * 16777216 + 168 * 65536 + (user_id % 256) * 256 + 1 AS dest_ip,
    [53, 80, 443, 8080][1 + event_id % 4]::BIGINT AS dest_port
"""

# Every event as a flow, before any field is left out.
_ALL = f"SELECT event_id, ts, event_type, {_TEXT} FROM events"

# Every message's fields as they are written, and their numbers where they are addresses.
_FIELDS = f"""
SELECT event_id, ts, event_type, event_id % 97 <> 0 AS readable, event_id % 13 <> 5 AS is_flow,
    CASE WHEN event_id % 20 IN (0, 10) THEN NULL WHEN event_id % 101 = 7 THEN '10.0.0.300'
        ELSE source_ipv4 END AS source_ipv4,
    CASE WHEN event_id % 20 NOT IN (0, 10) AND event_id % 101 <> 7 THEN source_ip END AS source_ip,
    CASE WHEN event_id % 20 <> 10 AND event_id % 109 <> 13 THEN source_port END AS source_port,
    CASE WHEN event_id % 107 = 11 THEN NULL WHEN event_id % 103 = 9 THEN 'fe80::1'
        ELSE dest_ipv4 END AS dest_ipv4,
    CASE WHEN event_id % 107 <> 11 AND event_id % 103 <> 9 THEN dest_ip END AS dest_ip,
    CASE WHEN event_id % 10 <> 1 THEN dest_port END AS dest_port
FROM ({_ALL})
"""

# The messages that are whole flows, and those of type flow that name their source.
_WHOLE = f"""
SELECT * FROM ({_FIELDS}) WHERE readable AND source_ip IS NOT NULL AND source_port IS NOT NULL
    AND dest_ip IS NOT NULL AND dest_port IS NOT NULL
"""
_NAMED = f"""
SELECT event_id, ts, source_ipv4, source_ip, source_port::INTEGER AS source_port, dest_ipv4,
    dest_ip, dest_port::INTEGER AS dest_port
FROM ({_FIELDS})
WHERE readable AND is_flow AND source_ipv4 IS NOT NULL AND source_port IS NOT NULL
"""

_SUBMISSIONS = """
SELECT CASE WHEN event_id % 3 = 0 THEN -event_id - 1 ELSE event_id END AS id,
    unnest(CASE WHEN event_type = 'purchase' THEN ['true', 'false']
        WHEN event_type = 'error' THEN ['true']
        WHEN event_id % 7 = 0 THEN ['True'] ELSE ['false'] END) AS answer
FROM events
"""

_FEATURES = "source_ip, source_port, dest_ip, dest_port"
_CANDIDATE = "source_ipv4, source_ip, source_port, dest_ipv4, dest_ip, dest_port"
_DAY = "ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00'"
_BIT = "CASE WHEN answer = 'true' THEN 1 ELSE 0 END"
_PORT_LABEL = "CASE WHEN dest_port = 53 THEN '1' ELSE '0' END"

_USER_LABELS = f"""
SELECT s.id, {_CANDIDATE}, ({_BIT})::INTEGER AS label
FROM ({_SUBMISSIONS}) s JOIN ({_NAMED}) c ON s.id = c.event_id
"""
_VALIDATED_LABELS = f"""
SELECT s.id, source_ipv4, source_ip, source_port::INTEGER AS source_port, dest_ipv4, dest_ip,
    dest_port::INTEGER AS dest_port, ({_BIT})::INTEGER AS validated_label
FROM ({_SUBMISSIONS}) s JOIN ({_WHOLE}) c ON s.id = c.event_id
"""


_DECODED = f"""
SELECT event_id, CASE WHEN readable THEN source_ipv4 END AS source_ipv4,
    CASE WHEN readable THEN source_port::INTEGER END AS source_port,
    CASE WHEN readable THEN dest_ipv4 END AS dest_ipv4,
    CASE WHEN readable THEN dest_port::INTEGER END AS dest_port
FROM ({_FIELDS})
"""
_REJECTS = f"""
SELECT event_id, reason FROM (
    SELECT event_id, CASE WHEN NOT readable THEN 'undecodable'
        WHEN source_ipv4 IS NULL THEN 'missing source_ip'
        WHEN dest_ipv4 IS NULL THEN 'missing dest_ip'
        WHEN source_port IS NULL THEN 'missing source_port'
        WHEN dest_port IS NULL THEN 'missing dest_port'
        WHEN source_ip IS NULL THEN 'invalid source_ip'
        WHEN dest_ip IS NULL THEN 'invalid dest_ip' END AS reason
    FROM ({_FIELDS})
) WHERE reason IS NOT NULL
"""


def _training(skipped: int) -> str:
    return f"""
SELECT {_FEATURES}, (event_type = 'error')::INTEGER AS label
FROM ({_WHOLE}) WHERE {_DAY} AND event_id % 3 <> {skipped}
"""


def _messages(topic: str) -> str:
    return f"""
SELECT event_id, algo, '{topic}' AS topic, event_id::VARCHAR AS key
FROM ({_WHOLE}), (VALUES ('kmeans'), ('rf')) AS algos (algo)
"""


_PREDICTED = f"SELECT event_id, {_PORT_LABEL} AS \"predictedLabel\" FROM ({_WHOLE})"

ORACLES = {
    "beats_decode": _DECODED,
    "schema_file_decode": _DECODED,
    "ip_to_long": f"""
SELECT event_id, CASE WHEN event_id % 16 >= 11 THEN source_ip END AS source_ip, dest_ip
FROM ({_ALL})
""",
    "inet_aton_to_long": f"""
SELECT event_id, CASE
        WHEN event_id % 16 = 2 OR event_id % 16 >= 11 THEN source_ip
        WHEN event_id % 16 = 4 THEN 10 * 16777216 + (user_id % 256) * 65536 + event_id % 256
        WHEN event_id % 16 = 5 THEN 10 * 16777216 + 1
        WHEN event_id % 16 = 6 THEN source_ip - 2 * 16777216
    END AS source_ip, dest_ip
FROM (SELECT a.*, user_id FROM ({_ALL}) a JOIN events e ON a.event_id = e.event_id)
""",
    "flow_normalize": f"SELECT event_id, {_FEATURES} FROM ({_WHOLE})",
    "flow_normalize_coalesce": f"""
SELECT event_id, source_ip, source_port, dest_ip, dest_port
FROM (
    SELECT event_id, readable, source_port, dest_port,
        CASE WHEN event_id % 20 = 0 THEN 172::BIGINT * 16777216 + 16 * 65536 + event_id % 256
            ELSE source_ip END AS source_ip,
        CASE WHEN event_id % 20 = 0 AND dest_ipv4 IS NULL THEN 8 * 16843009
            ELSE dest_ip END AS dest_ip
    FROM ({_FIELDS})
)
WHERE readable AND source_ip IS NOT NULL AND source_port IS NOT NULL AND dest_ip IS NOT NULL
    AND dest_port IS NOT NULL
""",
    "flow_rejects": _REJECTS,
    "stream_rejects": _REJECTS,
    "feature_vector": f"""
SELECT event_id, source_ip::DOUBLE AS f0, source_port::DOUBLE AS f1, dest_ip::DOUBLE AS f2,
    dest_port::DOUBLE AS f3
FROM ({_WHOLE})
""",
    "live_candidates": f"""
SELECT event_id AS id, {_CANDIDATE} FROM ({_NAMED}) WHERE {_DAY}
ORDER BY ts DESC, event_id::VARCHAR LIMIT 10
""",
    "prediction_candidates": f"""
SELECT event_id AS id, source_ipv4, source_ip, source_port::INTEGER AS source_port, dest_ipv4,
    dest_ip, dest_port::INTEGER AS dest_port, {_PORT_LABEL} AS "predictedLabel"
FROM ({_WHOLE}) WHERE {_DAY}
ORDER BY ts DESC, event_id::VARCHAR LIMIT 10
""",
    "user_labels": _USER_LABELS,
    "validated_labels": _VALIDATED_LABELS,
    "unknown_submissions": f"""
SELECT id FROM ({_SUBMISSIONS}) WHERE id NOT IN (SELECT event_id FROM ({_NAMED}))
""",
    "default_answers": f"""
WITH answers AS ({_SUBMISSIONS} WHERE event_id // 10 % 4 <> 3),
shown AS (SELECT event_id, event_id // 10 AS page FROM ({_NAMED})),
pages AS (
    SELECT page FROM shown WHERE event_id IN (SELECT id FROM answers)
    UNION SELECT event_id // 10 FROM events WHERE event_id // 10 % 8 = 3
)
SELECT id, answer FROM answers
UNION ALL
SELECT event_id, 'false' FROM shown
WHERE event_id NOT IN (SELECT id FROM answers) AND page IN (SELECT page FROM pages)
""",
    "candidate_lookup": f"""
SELECT {_CANDIDATE}, (source_port % 2 = 0)::INTEGER AS label FROM ({_NAMED}) WHERE dest_port = 53
""",
    "stream_answers": f"""
SELECT {_CANDIDATE}, coalesce(dest_port = 53, false)::INTEGER AS label FROM ({_NAMED})
""",
    "label_messages": f"SELECT id, label FROM ({_USER_LABELS})",
    "validated_label_messages": f"SELECT id, validated_label FROM ({_VALIDATED_LABELS})",
    "candidate_parking": f"""
SELECT true AS id_fits, true AS ids_differ, {_CANDIDATE} FROM ({_NAMED})
""",
    "training_set_user": _training(0),
    "training_set_validated": _training(1),
    "label_index": f"""
SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS idx
FROM (
    SELECT (event_type = 'error')::INTEGER::VARCHAR AS label, count(*) AS n
    FROM ({_WHOLE}) GROUP BY 1
)
""",
    "feature_categories": f"""
SELECT feature, value::DOUBLE AS value,
    row_number() OVER (PARTITION BY feature ORDER BY value <> 0, value) - 1 AS idx
FROM (
    SELECT DISTINCT feature, value
    FROM (UNPIVOT (SELECT {_FEATURES} FROM ({_WHOLE})) ON {_FEATURES}
        INTO NAME feature VALUE value)
)
QUALIFY count(*) OVER (PARTITION BY feature) <= 4
""",
    "rf_score": _PREDICTED,
    "rf_probability": f"""
SELECT event_id, true AS sums_to_one, true AS is_largest FROM ({_WHOLE})
""",
    "kmeans_score": f"""
SELECT event_id, min(event_id) OVER (PARTITION BY dest_port = 53) AS group_id FROM ({_WHOLE})
""",
    "kmeans_nearest": f"""
SELECT event_id, true AS is_nearest, 10::BIGINT AS centres_used FROM ({_WHOLE})
""",
    "model_layouts": f"""
SELECT event_id, true AS same_cluster, true AS same_votes FROM ({_WHOLE})
""",
    "model_roundtrip": _PREDICTED,
    "score_envelope": _messages("model_predictions"),
    "message_body": f"""
SELECT event_id, algo, source_ipv4, dest_ipv4, {_FEATURES}, source_ip::DOUBLE AS f0,
    source_port::DOUBLE AS f1, dest_ip::DOUBLE AS f2, dest_port::DOUBLE AS f3,
    CASE WHEN algo = 'rf' THEN {_PORT_LABEL} END AS "predictedLabel",
    CASE WHEN algo = 'rf' THEN (dest_port = 53)::DOUBLE END AS prediction,
    CASE WHEN algo = 'rf' THEN 4 END AS indexed, CASE WHEN algo = 'rf' THEN 2 END AS raw,
    CASE WHEN algo = 'rf' THEN true END AS sums_to_one
FROM ({_WHOLE}), (VALUES ('kmeans'), ('rf')) AS algos (algo)
""",
    "strong_envelope": f"""
SELECT event_id, algo, topic, key, CASE WHEN algo = 'rf' THEN
    CASE WHEN dest_port = 53 THEN '0' ELSE '1' END END AS "predictedLabel"
FROM ({_messages("strong_predictions")}) JOIN (SELECT event_id, dest_port FROM ({_WHOLE}))
    USING (event_id)
""",
    "stream_strong": f"""
SELECT event_id, algo FROM ({_messages('strong_predictions')}) WHERE event_id % 4 >= 2
""",
    "stream_refresh": f"""
SELECT event_id, CASE WHEN (dest_port = 53) = (event_id % 4 < 2) THEN '1' ELSE '0' END
    AS "predictedLabel"
FROM ({_WHOLE})
""",
    "stream_distinct": f"SELECT event_id, algo FROM ({_messages('model_predictions')})",
    "compacted_scores": f"SELECT event_id, algo FROM ({_messages('model_predictions')})",
    "shared_table": f"SELECT event_id, algo FROM ({_messages('model_predictions')})",
    "stream_score": f"SELECT event_id, algo FROM ({_messages('model_predictions')})",
    "active_loop": _PREDICTED,
}
