"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from logmill.functions import classify, extract, normalize, severity
from logmill.sources import synth


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def masked(source: str, column: str, keep: str) -> str:
    """CTEs m0 to m14 that run the masks over ``column``, each gated by the text as it came."""
    out = [f"m0 AS (SELECT {keep}, {column} AS o, {column} AS c FROM {source})"]
    for i, (_, pattern, put) in enumerate(normalize.MASKS):
        out.append(f"m{i + 1} AS (SELECT {keep}, o, CASE WHEN regexp_matches(o, {q(pattern)}) THEN regexp_replace(c, {q(pattern)}, {q(put)}, 'g') ELSE c END AS c FROM m{i})")
    return ", ".join(out)


# The lines of sources/synth.py: one scrambled number k for each event, and what is drawn from it.
K = "((event_id * 48271) % 2147483647)"
WORD, HALF = f"printf('%08x', {K})", f"printf('%04x', {K} % 40961)"
DRAWN = {
    "@pid": f"({K} % 31991 + 300)::VARCHAR",
    "@ip4": f"'192.168.' || ({K} % 251)::VARCHAR || '.' || ({K} % 239 + 1)::VARCHAR",
    "@port": f"({K} % 28001 + 30000)::VARCHAR",
    "@count": f"({K} % 1000003)::VARCHAR",
    "@small": f"({K} % 9)::VARCHAR",
    "@disk": f"substr('bcefg', ({K} // 89 % 5 + 1)::INT, 1)",
    "@job": f"['saffron', 'tundra', 'quartz', 'willow', 'pixel', 'ripple', 'nimbus'][{K} // 97 % 7 + 1]",
    "@long": f"{WORD} || {HALF} || {WORD} || {HALF}",
    "@word": WORD,
    "@half": HALF,
    "@uuid": f"concat_ws('-', {WORD}, {HALF}, {HALF}, {HALF}, {HALF} || {WORD})",
    "@mac": "'02:' || concat_ws(':', " + ", ".join(f"printf('%02x', {K} % {p})" for p in (251, 241, 239, 233, 229)) + ")",
}
_body = f"[{', '.join(q(f'{p}: {m}') for p, m in synth.MESSAGES)}][event_id % {len(synth.MESSAGES)} + 1]"
for _name, _value in DRAWN.items():
    _body = f"replace({_body}, '{_name}', {_value})"
LINES = f"""filled AS (SELECT *, {_body} AS body, 'host' || (user_id % 5)::VARCHAR AS host FROM events),
lines AS (SELECT event_id, ts, user_id, host,
  CASE WHEN event_id % 7 = 3 THEN 'journald' WHEN regexp_matches(body, '^(sshd|CRON)') THEN 'file.auth' ELSE 'file.syslog' END AS source,
  CASE WHEN event_id % 7 = 3 THEN (event_id % 8)::VARCHAR END AS priority,
  CASE WHEN event_id % 7 = 3 THEN regexp_replace(body, '^[^\\s:]+: ', '')
    ELSE strftime(ts, '%b') || ' ' || lpad(day(ts)::VARCHAR, 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') || ' ' || host || ' ' || body END AS raw
  FROM filled)"""
STRIP = q(f"^(?:{normalize.HEADER_BSD}{normalize.TAG}|{normalize.HEADER_ISO}{normalize.TAG})")
PROGRAM = q(f"^(?:{normalize.HEADER_BSD}|{normalize.HEADER_ISO}){normalize.PROGRAM_TAG}")
PRIORITY = "coalesce(try_cast(priority AS INT), 6)"
FROM_PRIORITY = f"CASE WHEN {PRIORITY} <= 2 THEN 'critical' WHEN {PRIORITY} = 3 THEN 'error' WHEN {PRIORITY} = 4 THEN 'warn' ELSE 'info' END"


def contains_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(raw), {q(w)})" for w in words) + ")"


def finalize(initial: str) -> str:
    return f"CASE WHEN {contains_any(severity.CRITICAL)} OR {initial} = 'critical' THEN 'critical' WHEN {contains_any(severity.ERROR)} OR {initial} = 'error' THEN 'error' WHEN {initial} = 'warn' THEN 'warn' ELSE 'info' END"


def category(rules=classify.RULES) -> str:
    whens = []
    for r in rules:
        if not r.pattern:
            break
        test = f"contains(lower(raw), {q(r.pattern.lower())})" if r.literal else f"regexp_matches(raw, {q('(?i)' + r.pattern)})"
        if r.program:
            test += f" AND lower(coalesce(program, '')) = {q(r.program.lower())}"
        whens.append(f"WHEN {test} THEN {q(r.category)}")
    return f"CASE {' '.join(whens)} ELSE 'system.general' END"


STRIPPED = f"stripped AS (SELECT *, regexp_replace(raw, {STRIP}, '') AS message, nullif(regexp_extract(raw, {PROGRAM}, 1), '') AS program, CASE WHEN priority IS NULL THEN 'info' ELSE {FROM_PRIORITY} END AS initial FROM lines WHERE raw <> '')"
_KEEP = "event_id, ts, user_id, host, source, priority, raw, program, initial"
PATTERNS = f"{LINES}, {STRIPPED}, {masked('stripped', 'message', _KEEP)}, patterns AS (SELECT {_KEEP}, c AS template, {finalize('initial')} AS severity, {category()} AS category FROM m14)"


def sessions(gap: int, keys: str = "host, template, severity, source", cycle_s: int | None = None) -> str:
    cycle = f", epoch_us(ts) // {cycle_s * 1_000_000} AS cycle" if cycle_s else ""
    by = keys + (", cycle" if cycle_s else "")
    return f"""keyed AS (SELECT *{cycle} FROM patterns),
marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {gap * 1_000_000} THEN 1 ELSE 0 END AS s FROM keyed WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id)),
placed AS (SELECT *, sum(s) OVER (PARTITION BY {by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked),
groups AS (SELECT {by}, session, count(*) AS n, min(ts) AS ts_first, max(ts) AS ts_last, arg_min(category, (ts, event_id)) AS category, arg_min(raw, (ts, event_id)) AS first_raw, min(event_id) AS event_id,
  array_to_string(list_slice(list(raw ORDER BY ts, event_id), 1, 3), chr(10)) AS samples FROM placed GROUP BY {by}, session)"""


CYCLES = f"{PATTERNS}, {sessions(14400, cycle_s=1800)}"
RECORDS = f"""{CYCLES}, per_cycle AS (SELECT host, cycle, count(*) AS n_events, sum(n)::BIGINT AS n_lines, sum(CASE WHEN severity = 'critical' THEN n ELSE 0 END)::BIGINT AS critical, sum(CASE WHEN severity = 'error' THEN n ELSE 0 END)::BIGINT AS error, sum(CASE WHEN severity = 'warn' THEN n ELSE 0 END)::BIGINT AS warn, sum(CASE WHEN severity = 'info' THEN n ELSE 0 END)::BIGINT AS info FROM groups GROUP BY host, cycle),
records AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY cycle) AS seq, make_timestamp((cycle + 1) * 1800000000) AS received_at, 'boot' || (cycle // 700)::VARCHAR AS boot_id FROM per_cycle)"""
LEDGER = """ledger AS (SELECT event_id, 'host' || (user_id % 5)::VARCHAR AS host, ts AS queued_at, lpad(event_id::VARCHAR, 12, '0') AS name, (event_id * 7919) % 90000 + 1000 AS bytes, CASE WHEN event_id % 3 = 0 THEN 'sent' WHEN event_id % 17 = 5 THEN 'failed' ELSE 'queued' END AS state FROM events)"""
SAMPLES = "samples AS (SELECT 'host' || (user_id % 5)::VARCHAR AS host, event_type AS dev, event_id, ts, event_id * 13 AS counter FROM events)"
PLAYBOOK = "playbook(category, remedy) AS (VALUES ('kernel.oom', 'add memory'), ('container.oom', 'raise the container''s memory limit'), ('kernel.bug', 'update the kernel'), ('kernel.panic', 'collect the crash dump and reboot'), ('process.crash', 'read the core dump'), ('fs.error', 'check the file system'), ('fs.readonly', 'check the disk, then remount'), ('hw.mce', 'test memory and processor'), ('disk.smart_error', 'back up and replace disk'), ('disk.io_error', 'replace disk'), ('disk.link_error', 'check the cable and controller'), ('net.error', 'raise the connection limits'), ('net.watchdog', 'update the driver or replace the card'), ('systemd.unit_failure', 'read the unit''s journal'), ('systemd.restart_loop', 'fix the unit''s start, then reset it'), ('auth.bruteforce', 'block address'), ('auth.failure', 'check the account'), ('auth.event', 'confirm that the login was expected'), ('session.activity', 'none needed'), ('ntp.drift', 'check the time source'), ('selinux.denial', 'review the policy'))"


def extracted(key: str) -> str:
    out = []
    for pattern, name, numeric in extract.EXTRACTORS:
        if name == key:
            got = f"CASE WHEN regexp_matches(message, {q(pattern)}) THEN regexp_extract(message, {q(pattern)}, 1) END"
            out.append(f"try_cast({got} AS BIGINT)::VARCHAR" if numeric else got)
    return f"coalesce({', '.join(out)})"


LOGFMT = f"""pairs AS (SELECT event_id, unnest(regexp_extract_all(message, {q(extract.LOGFMT)}, 1)) AS k, unnest(regexp_extract_all(message, {q(extract.LOGFMT)}, 2)) AS quoted, unnest(regexp_extract_all(message, {q(extract.LOGFMT)}, 3)) AS plain, generate_subscripts(regexp_extract_all(message, {q(extract.LOGFMT)}, 1), 1) AS i FROM stripped WHERE contains(message, '=')),
firsts AS (SELECT event_id, k, CASE WHEN plain <> '' THEN plain ELSE quoted END AS v FROM pairs WHERE k IN ({', '.join(q(a) for a in extract.ALLOW)}) QUALIFY row_number() OVER (PARTITION BY event_id, k ORDER BY i) = 1)"""
BYTES = "CASE WHEN bytes >= 1048576 THEN printf('%.1fMB', round(bytes / 1048576.0, 1)) WHEN bytes >= 1024 THEN printf('%.1fKB', round(bytes / 1024.0, 1)) ELSE bytes::VARCHAR || 'B' END"
CONT = "numbered AS (SELECT 'f' || (event_id % 4)::VARCHAR AS file, event_id AS line_no, CASE WHEN event_id % 5 IN (1, 2) THEN '  at frame ' || event_id::VARCHAR ELSE raw END AS raw FROM lines)"
STARTS = q(r"^(?:<\d{1,3}>\d?\s+)?(?:\d{4}-\d{2}-\d{2}T|[A-Za-z]{3}\s+\d{1,2}\s)")
CROCK = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_ULID = " || ".join(f"substr('{CROCK}', (((epoch_us(ts) // 1000) >> {45 - 5 * i}) & 31)::INT + 1, 1)" for i in range(10))

STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
BATCH = f"""{CYCLES}, numbers AS (SELECT host, cycle, row_number() OVER (PARTITION BY host ORDER BY cycle) - 1 AS seq FROM (SELECT DISTINCT host, cycle FROM groups)),
batch AS (SELECT g.* EXCLUDE (ts_first, ts_last), {STAMP.format('g.ts_first')} AS ts_first, {STAMP.format('g.ts_last')} AS ts_last, least(g.n, 3) AS n_samples, numbers.seq FROM groups g JOIN numbers USING (host, cycle))"""
OOM = "template = 'Memory cgroup out of memory: Killed process <NUM> inside tundra' AND severity = 'critical' AND source = 'file.syslog'"
POSTED = "posted AS (SELECT event_id, ts, ['log_batch', 'stat_snapshot', 'sos_snapshot', 'other'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS b, CASE WHEN event_id % 7 <> 0 THEN 'h' || (event_id % 50)::VARCHAR END AS host_id FROM events)"

#: The numbers of catalogue.host_texts and what its files say of them; a and b are the events counted in the two samples.
HOSTS = "hosts AS (SELECT 'host' || (user_id % 5)::VARCHAR AS host, count(*) FILTER (event_id % 2 = 0) AS a, count(*) AS b, max(ts) AS last_at FROM events GROUP BY 1)"

ORACLES: dict[str, str] = {f"mask_{name}": f"WITH {LINES} SELECT event_id, regexp_replace(raw, {q(p)}, {q(m)}, 'g') AS masked FROM lines WHERE regexp_matches(raw, {q(p)})" for name, p, m in normalize.MASKS}
ORACLES |= {
    "event_patterns": f"WITH {PATTERNS} SELECT template, severity, category, count(*) AS n FROM patterns GROUP BY ALL",
    "normalize_documents": f"WITH {masked('documents', 'text', 'doc_id')} SELECT doc_id, md5(c) AS template_md5, length(c) AS template_chars FROM m14",
    "normalize_pages": f"WITH {masked('pages', 'html', 'page_id')} SELECT page_id, md5(c) AS template_md5, length(c) AS template_chars FROM m14",
    "strip_prefix": f"WITH {LINES} SELECT event_id, regexp_replace(raw, {STRIP}, '') AS message FROM lines",
    "syslog_program": f"WITH {LINES} SELECT event_id, nullif(regexp_extract(raw, {PROGRAM}, 1), '') AS program FROM lines",
    "severity_finalize": f"WITH {LINES}, {STRIPPED} SELECT event_id, initial, {finalize('initial')} AS severity FROM stripped",
    "priority_to_severity": f"WITH {LINES} SELECT event_id, {FROM_PRIORITY} AS severity FROM lines",
    "drop_noise": f"WITH {LINES} SELECT event_id, raw FROM lines WHERE {PRIORITY} < 7",
    "route_by_severity": f"WITH {PATTERNS} SELECT CASE WHEN severity = 'critical' THEN 'critical' ELSE 'normal' END AS route, source, count(*) AS n FROM patterns GROUP BY ALL",
    "categorize": f"WITH {PATTERNS} SELECT event_id, category FROM patterns",
    "categorize_program_gate": f"WITH {PATTERNS} SELECT program, category, count(*) AS n FROM patterns WHERE regexp_matches(raw, 'Accepted|pam_unix') GROUP BY ALL",
    "pattern_id": f"WITH {PATTERNS} SELECT event_id, substr(md5(template || '|' || severity || '|' || source), 1, 16) AS pattern_id FROM patterns",
    "fields_regex": f"WITH {LINES}, {STRIPPED} SELECT event_id, {extracted('pid')} AS pid, {extracted('user')} AS user_name, {extracted('dev')} AS dev, {extracted('unit')} AS unit FROM stripped",
    "fields_logfmt": f"WITH {LINES}, {STRIPPED}, {LOGFMT} SELECT event_id, k AS field, v AS value FROM firsts",
    "fields_json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "fields_backfilled": f"WITH {PATTERNS}, {sessions(14400)}, s AS (SELECT event_id, host, source, regexp_replace(first_raw, {STRIP}, '') AS message, CASE WHEN source = 'journald' THEN (event_id % 8)::VARCHAR END AS priority FROM groups) SELECT event_id, coalesce({extracted('pid')}, '\"' || (event_id % 500)::VARCHAR || '\"') AS pid, coalesce('\"' || {extracted('unit')} || '\"', '\"u' || priority || '.service\"') AS unit, '\"' || priority || '\"' AS priority, '\"' || host || '\"' AS source_host FROM s",
    "dedup_session_30s": f"WITH {PATTERNS}, {sessions(30)} SELECT host, template, severity, source, session::BIGINT AS session, n, ts_first, ts_last, category, first_raw FROM groups",
    "dedup_session_4h": f"WITH {PATTERNS}, {sessions(14400)} SELECT host, template, severity, source, session::BIGINT AS session, n, ts_first, ts_last, category, first_raw FROM groups",
    "sample_raws_top3": f"WITH {PATTERNS}, {sessions(14400)} SELECT host, template, severity, source, session::BIGINT AS session, samples FROM groups",
    "cycle_window_30m": f"WITH {CYCLES} SELECT host, cycle, count(*) AS n_events, sum(n)::BIGINT AS n_lines FROM groups GROUP BY ALL",
    "cycle_counts_by_severity": f"WITH {RECORDS} SELECT host, cycle, critical, error, warn, info FROM records",
    "cycle_counts_by_category": f"WITH {CYCLES} SELECT host, cycle, category, sum(n)::BIGINT AS n FROM groups GROUP BY ALL",
    "severity_category_rollup": f"WITH {PATTERNS} SELECT coalesce(severity, '*') AS severity, coalesce(category, '*') AS category, count(*) AS n FROM patterns GROUP BY ROLLUP (severity, category)",
    "recv_logs_filter_limit": f"WITH {CYCLES} SELECT host, template, ts_first, event_id, n FROM groups WHERE severity = 'critical' AND category = 'kernel.oom' ORDER BY ts_first DESC, event_id LIMIT 100",
    "recv_hosts": f"WITH {RECORDS} SELECT host, count(*) AS envelopes, min(received_at) AS first_seen, max(received_at) AS last_seen, sum(critical)::BIGINT AS critical, sum(error)::BIGINT AS error, sum(warn)::BIGINT AS warn, sum(info)::BIGINT AS info, arg_max(seq, received_at) AS last_seq, max(seq) AS max_seq FROM records GROUP BY host",
    "recv_compare_fp": f"""WITH {BATCH}, own AS (SELECT *, coalesce(sum(n_samples) OVER (PARTITION BY host ORDER BY cycle, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM batch WHERE {OOM}),
one AS (SELECT host, sum(n)::BIGINT AS n, count(*) AS cycles_seen, min(ts_first) AS ts_first, max(ts_last) AS ts_last, 'critical' AS severity, 'container.oom' AS category, min(template) AS template, string_agg(samples, chr(10) ORDER BY cycle, event_id) FILTER (taken < 3) AS sample_raws FROM own GROUP BY host)
SELECT one.*, sum(n) OVER ()::BIGINT AS total_count, count(*) OVER () AS affected_hosts FROM one""",
    "gold_uid_match": f"WITH {BATCH} SELECT host, ts_first, event_id AS label, n FROM batch WHERE {OOM}",
    "envelope_headers": f"WITH {RECORDS} SELECT 'log_batch' AS event_kind, host, md5(host) AS host_id, boot_id, {STAMP.format('make_timestamp(cycle * 1800000000)')} AS ts, {STAMP.format('make_timestamp(cycle * 1800000000)')} || '/' || {STAMP.format('make_timestamp((cycle + 1) * 1800000000)')} AS \"window\", seq - 1 AS seq, 1 AS total_sections, 1800000 AS duration_ms, critical, error, warn, info FROM records",
    "envelope_events": f"WITH {BATCH}, s AS (SELECT *, regexp_replace(first_raw, {STRIP}, '') AS message FROM batch) SELECT host, seq, 'logs' AS section, template, severity, source, category, n, ts_first, ts_last, samples, {extracted('user')} AS user_name FROM s",
    "recv_failed_users": f"WITH {BATCH}, s AS (SELECT *, regexp_replace(first_raw, {STRIP}, '') AS message FROM batch WHERE category = 'auth.failure') SELECT {extracted('user')} AS user_name, sum(n)::BIGINT AS n FROM s WHERE {extracted('user')} IS NOT NULL GROUP BY 1",
    "recv_idempotent": f"WITH {RECORDS}, twice AS (SELECT host, seq, received_at, 0 AS copy FROM records UNION ALL SELECT host, seq, received_at, 1 FROM records WHERE seq % 5 = 0) SELECT host, seq, received_at, copy FROM twice QUALIFY row_number() OVER (PARTITION BY host, seq ORDER BY received_at, copy) = 1",
    "recv_analyze": f"WITH {POSTED} SELECT kind, count(*) AS received, max(ts) AS latest, CASE max(CASE WHEN b = 0 THEN 0 ELSE b END) WHEN 0 THEN '' ELSE concat_ws(',', CASE WHEN bool_or(b = 1) THEN 'logs' END, CASE WHEN bool_or(b = 2) THEN 'metrics,network' END) END AS section_names, CASE kind WHEN 'log_batch' THEN 'ingest' WHEN 'stat_snapshot' THEN 'stat' WHEN 'sos_snapshot' THEN 'sos' END AS store FROM posted GROUP BY kind",
    "bind_by_host_id": f"WITH {POSTED} SELECT host_id, arg_max(CASE WHEN host_id IS NOT NULL THEN event_id END, ts) FILTER (kind = 'log_batch') AS log_batch_seq, arg_max(CASE WHEN host_id IS NOT NULL THEN event_id END, ts) FILTER (kind = 'stat_snapshot') AS stat_snapshot_seq, arg_max(CASE WHEN host_id IS NOT NULL THEN event_id END, ts) FILTER (kind = 'sos_snapshot') AS sos_snapshot_seq FROM posted GROUP BY host_id",
    "stat_snapshot_values": f"WITH {HOSTS} SELECT host, b * 2048 // 1024 AS total_mb, greatest(b * 2048 // 1024 - (a * 1024 // 1024 + 1 + 2), 0) AS used_mb, round((4 * (b - a) + a % 10) * 100.0 / (10 * (b - a) + a % 10), 2) AS usage_pct, b % 7 + 0.25::DOUBLE AS load_1m, round((b - a) / 10.0, 2) AS reads_per_sec, round((b - a) * 10.0, 2) AS rx_bytes_per_sec, b % 5 AS established, (b % 100)::VARCHAR AS swappiness, host || chr(10) AS hostname, 1 + b % 3 AS n_units FROM hosts",
    "stat_snapshot_sections": f"WITH {HOSTS} SELECT host, 'stat_snapshot' AS event_kind, {STAMP.format('last_at')} AS ts, NULL::BIGINT AS seq, 7 AS total_sections, 10000 AS duration_ms, 'metrics,processes,network,systemd,static_state,config,hardware' AS sections FROM hosts",
    "snapshot_bind": f"WITH {RECORDS}, {HOSTS} SELECT md5(host) AS host_id, max(seq) - 1 AS seq, any_value(b * 2048 // 1024) AS total_mb, true AS no_sos FROM records JOIN hosts USING (host) GROUP BY host",
    "seen_anti_join": "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id = e.event_id AND s.event_id % 3 = 0)",
    "seq_gaps": f"WITH {RECORDS}, kept AS (SELECT host, seq FROM records WHERE seq % 9 <> 4), nexts AS (SELECT host, seq + 1 AS gap_from, lead(seq) OVER (PARTITION BY host ORDER BY seq) - 1 AS gap_to FROM kept) SELECT * FROM nexts WHERE gap_to >= gap_from",
    "host_silence_35m": f"WITH {RECORDS}, gaps AS (SELECT host, lag(received_at) OVER (PARTITION BY host ORDER BY received_at) AS silent_from, received_at AS silent_to FROM records) SELECT host, silent_from, silent_to, (epoch_us(silent_to) - epoch_us(silent_from)) / 60000000.0 AS minutes FROM gaps WHERE epoch_us(silent_to) - epoch_us(silent_from) > 35 * 60000000",
    "alert_rules": f"WITH {CYCLES}, a AS (SELECT host, cycle, category, n, CASE WHEN category IN ('kernel.panic', 'kernel.oom', 'container.oom', 'hw.mce', 'fs.readonly') THEN 'category' WHEN category = 'auth.bruteforce' OR n >= 10 THEN 'burst' END AS reason FROM groups) SELECT host, cycle, category, reason, count(*) AS events, sum(n)::BIGINT AS n FROM a WHERE reason IS NOT NULL GROUP BY ALL",
    "error_surge": f"WITH {RECORDS}, b AS (SELECT host, cycle, error, lag(error) OVER (PARTITION BY host ORDER BY cycle) AS before FROM records) SELECT host, cycle, error, before FROM b WHERE before > 0 AND error >= 10 * before",
    "error_surge_x2": f"WITH {RECORDS}, b AS (SELECT host, cycle, error, lag(error) OVER (PARTITION BY host ORDER BY cycle) AS before FROM records) SELECT host, cycle, error, before FROM b WHERE before > 0 AND error >= 2 * before",
    "recent_events_sos": f"WITH {PATTERNS}, timed AS (SELECT event_id, raw, template, category, CASE WHEN source = 'file.auth' THEN 'file.auth' ELSE 'file.syslog' END AS source, CASE WHEN {contains_any(severity.CRITICAL)} THEN 'critical' WHEN {contains_any(severity.ERROR)} THEN 'error' ELSE 'info' END AS severity, date_trunc('second', ts) AS ts, CASE WHEN source = 'file.auth' THEN 'auth' ELSE 'sys' END || CASE WHEN event_id % 3 = 0 THEN '1' ELSE '' END AS f FROM patterns WHERE event_id % 7 <> 3), fresh AS (SELECT * FROM timed WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 480 HOUR AND ts <= TIMESTAMP '2024-01-21 00:00:00'), marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 14400000000 THEN 1 ELSE 0 END AS s FROM fresh WINDOW w AS (PARTITION BY template, severity, source ORDER BY ts, f, event_id)), placed AS (SELECT *, sum(s) OVER (PARTITION BY template, severity, source ORDER BY ts, f, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked) SELECT template, severity, source, arg_min(category, (ts, f, event_id)) AS category, count(*) AS n, min(ts) AS ts_first FROM placed GROUP BY template, severity, source, session ORDER BY ts_first DESC, source, template LIMIT 500",
    "raw_scan_bytes": f"WITH {LINES}, timed AS (SELECT event_id, raw, CASE WHEN source = 'file.auth' THEN 'file.auth' ELSE 'file.syslog' END AS source, CASE WHEN source = 'file.auth' THEN '/var/log/auth.log' ELSE '/var/log/syslog' END AS base, event_id % 3 = 0 AS old, CASE WHEN event_id % 7 <> 3 THEN date_trunc('second', ts) END AS told FROM lines), kept AS (SELECT *, base || CASE WHEN old THEN '.1' ELSE '' END AS file FROM timed WHERE told IS NULL OR told BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 23:00:00'), sized AS (SELECT *, strlen(raw) + 1 + CASE WHEN row_number() OVER (PARTITION BY base ORDER BY old DESC, event_id) = 1 THEN strlen('==> ' || source || ' (' || base || ') <==') + 1 ELSE 0 END AS b FROM kept), run AS (SELECT source, file, event_id AS line_no, sum(b) OVER (ORDER BY source DESC, old DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used_bytes, sum(b) OVER () > 60000 AS truncated FROM sized) SELECT * FROM run WHERE used_bytes <= 60000",
    "boot_changes": f"WITH {RECORDS}, b AS (SELECT host, seq, boot_id, lag(boot_id) OVER (PARTITION BY host ORDER BY received_at) AS boot_before FROM records) SELECT * FROM b WHERE boot_before <> boot_id",
    "restart_loop_having": f"WITH {LINES}, {STRIPPED}, u AS (SELECT host, {extracted('unit')} AS unit FROM stripped) SELECT host, unit, count(*) AS n FROM u WHERE unit IS NOT NULL GROUP BY ALL HAVING count(*) >= 3",
    "raw_byte_budget": f"WITH {LINES}, b AS (SELECT host, event_id, sum(strlen(raw) + 1) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used_bytes FROM lines) SELECT * FROM b WHERE used_bytes <= 20000",
    "raw_time_window": f"WITH {LINES} SELECT event_id, raw FROM lines WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00' AND source IN ('file.auth', 'file.syslog')",
    "parse_since": "SELECT event_id, CASE WHEN event_id % 6 = 4 THEN NULL ELSE (event_id % 50) * CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END END AS seconds FROM events",
    "parse_syslog_ts": f"WITH {LINES} SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE CASE WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-16 00:00:00' THEN date_trunc('second', ts) - INTERVAL 1 YEAR ELSE date_trunc('second', ts) END END AS parsed FROM lines",
    "multiline_merge": f"WITH {LINES}, {CONT}, marked AS (SELECT *, sum(CASE WHEN regexp_matches(raw, {STARTS}) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS e FROM numbered) SELECT file, min(line_no) AS line_no, string_agg(raw, chr(10) ORDER BY line_no) AS raw, count(*) AS n_lines FROM marked GROUP BY file, e",
    "retry_ttl_cap": f"WITH {LEDGER}, k AS (SELECT *, sum(bytes) OVER (PARTITION BY host ORDER BY queued_at DESC, name DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS newer_bytes FROM ledger WHERE queued_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 168 HOUR) SELECT host, name, bytes, newer_bytes FROM k WHERE newer_bytes <= 2000000",
    "drain_window": f"WITH {LEDGER}, u AS (SELECT event_id, ({_ULID}) || lpad(event_id::VARCHAR, 16, '0') || '.json' AS name, epoch_us(queued_at) // 1000 AS ms FROM (SELECT *, queued_at AS ts FROM ledger)) SELECT event_id, name, ms FROM u WHERE ms >= 1704412800000 AND ms < 1704844800000",
    "drain_status": f"WITH {LEDGER} SELECT host, count(*) AS queued, count(*) FILTER (state = 'queued') AS remaining, count(*) FILTER (state = 'sent') AS succeeded, count(*) FILTER (state = 'failed') AS failed, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*) FILTER (state = 'queued') = 0 THEN 'completed' WHEN count(*) FILTER (state = 'queued') = count(*) THEN 'idle' ELSE 'in_progress' END AS status FROM ledger GROUP BY host",
    "topk_by_size": f"WITH {LEDGER}, r AS (SELECT host, name, bytes, row_number() OVER (PARTITION BY host ORDER BY bytes DESC, name) AS rank FROM ledger) SELECT * FROM r WHERE rank <= 20",
    "uid_lookup_join": "SELECT e.event_id, coalesce(c.c_name, e.user_id::VARCHAR) AS user_name FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = e.user_id",
    "playbook_join": f"WITH {PATTERNS}, {PLAYBOOK} SELECT p.event_id, p.category, b.remedy FROM patterns p LEFT JOIN playbook b USING (category)",
    "incident_window": f"WITH {LINES}, hot AS (SELECT event_id AS incident, host, ts FROM lines WHERE {contains_any(severity.CRITICAL)}) SELECT h.incident, count(*) AS near FROM hot h JOIN lines l ON l.host = h.host AND l.ts BETWEEN h.ts - INTERVAL 30 MINUTE AND h.ts + INTERVAL 30 MINUTE GROUP BY h.incident",
    "sample_delta_rate": f"WITH {SAMPLES}, d AS (SELECT host, dev, event_id, counter - lag(counter) OVER w AS moved, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM samples WINDOW w AS (PARTITION BY host, dev ORDER BY ts, event_id)) SELECT host, dev, event_id, CASE WHEN us > 0 THEN round(greatest(moved, 0) * 1000000.0 / us, 2) END AS rate FROM d WHERE moved IS NOT NULL",
    "parse_memory": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 900) * 1048576 WHEN 1 THEN (event_id % 900) * 1073741824 ELSE NULL END AS bytes FROM events",
    "human_bytes": f"WITH {LEDGER} SELECT event_id, {BYTES} AS size FROM ledger",
    "backoff": "SELECT event_id, least(5.0 * pow(2.0, event_id % 12), 300.0) AS wait FROM events",
    "is_partition": "SELECT event_id, ['sda', 'sda1', 'nvme0n1', 'nvme0n1p2', 'loop3', 'vdb2', 'dm-0'][event_id % 7 + 1] AS dev, [false, true, false, true, false, true, true][event_id % 7 + 1] AS partition FROM events",
    "dedup_ratio": f"WITH {PATTERNS} SELECT count(*) AS lines, count(DISTINCT template) AS templates, count(*) * 1.0 / count(DISTINCT template) AS ratio FROM patterns",
    "dedup_ratio_by_day": f"WITH {PATTERNS} SELECT host, epoch_us(ts) // 86400000000 AS day, count(*) AS lines, count(DISTINCT template) AS templates, count(*) * 1.0 / count(DISTINCT template) AS ratio FROM patterns GROUP BY ALL",
    "fresh_templates": f"WITH {PATTERNS}, own AS (SELECT DISTINCT host, epoch_us(ts) // 1800000000 AS cycle, template FROM patterns), c AS (SELECT host, cycle, lag(cycle) OVER (PARTITION BY host ORDER BY cycle) AS before FROM (SELECT DISTINCT host, cycle FROM own)) SELECT c.host, (count(*) FILTER (own.template IS NOT NULL AND old.template IS NULL))::BIGINT AS fresh, count(DISTINCT c.cycle) AS cycles FROM c JOIN own ON own.host = c.host AND own.cycle = c.cycle LEFT JOIN own old ON old.host = c.host AND old.cycle = c.before AND old.template = own.template GROUP BY c.host",
    "set_intersect": "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'",
    "envelope_counts_json": f"WITH {CYCLES}, c AS (SELECT host, cycle, category, sum(n)::BIGINT AS n FROM groups GROUP BY ALL) SELECT host, cycle, '{{' || string_agg('\"' || category || '\":' || n::VARCHAR, ',' ORDER BY category) || '}}' AS by_category FROM c GROUP BY host, cycle",
    "rfc3339_window": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at, strftime(make_timestamp(epoch_us(ts) // 1800000000 * 1800000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00/' || strftime(make_timestamp((epoch_us(ts) // 1800000000 + 1) * 1800000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS \"window\" FROM events",
    "crash_rate_6h": f"WITH {LINES} SELECT host, ts, event_id, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM lines WHERE contains(raw, 'segfault at')",
    "size_guard": f"WITH {CYCLES}, c AS (SELECT host, cycle, category, sum(n)::BIGINT AS n FROM groups GROUP BY ALL) SELECT host, cycle, strlen('{{' || string_agg('\"' || category || '\":' || n::VARCHAR, ',' ORDER BY category) || '}}') > 60 AS too_large FROM c GROUP BY host, cycle",
    "envelope_list": f"WITH {RECORDS} SELECT host AS source, received_at, seq AS number FROM records",
    "quarantine": "SELECT event_id, 'host' || (user_id % 5)::VARCHAR AS host, (4 * count(*) OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS newer_bytes FROM events WHERE event_id % 9 = 4",
}
