"""The same queries in SQL for another engine, used only to check results."""

from __future__ import annotations

from tracelode.functions.text import STOP_WORDS
from tracelode.operators.calls import PARAMETERS
from tracelode.operators.logs import EXPORT_ERRORS
from tracelode.operators.matching import COMMANDS
from tracelode.plans.sql import TEXTS


def _quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return "values " + ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)


_STOP = ", ".join(_quoted(w) for w in STOP_WORDS)


def _tokens(text: str) -> str:
    return (rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{Nd}}]+'), "
            f"lambda w: strlen(w) > 1 and w not in ({_STOP}))")


# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "ev": ([], "select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events"),
    "logs": (["ev"], """select event_id as log_id, ts, user_id,
  case when user_id % 5 = 0 then null else concat('svc-', cast(user_id % 5 as varchar(10))) end as container_name,
  case k % 8 when 0 then 'error' when 1 then 'WARNING' when 2 then 'critical' when 3 then 'info'
             when 4 then 'trace' when 5 then 'notice' else null end as level,
  case event_type
    when 'error' then case when k % 2 = 0 then 'Request failed: connection refused' else 'Fatal: no such host' end
    when 'signup' then 'Deprecated API used'
    when 'purchase' then 'CRITICAL stock level'
    when 'view' then '{"level":"warn","msg":"slow page"}'
    else null end as log
from ev"""),
    "levels": (["logs"], """select *, case severity_text when 'DEBUG' then 5 when 'INFO' then 9 when 'WARN' then 13
  when 'ERROR' then 17 else 21 end as severity_number from (
select *, case
  when lower(coalesce(level, '')) in ('error', 'err') then 'ERROR'
  when lower(coalesce(level, '')) in ('warn', 'warning') then 'WARN'
  when lower(coalesce(level, '')) in ('fatal', 'critical') then 'FATAL'
  when lower(coalesce(level, '')) = 'info' then 'INFO'
  when lower(coalesce(level, '')) in ('debug', 'trace') then 'DEBUG'
  when regexp_matches(lower(coalesce(log, '')), 'error|exception|failed|failure|panic') then 'ERROR'
  when regexp_matches(lower(coalesce(log, '')), 'warn|deprecated') then 'WARN'
  when regexp_matches(lower(coalesce(log, '')), 'fatal|critical') then 'FATAL'
  else 'INFO' end as severity_text
from logs) l"""),
    "spans": (["ev"], """select concat('t', cast(user_id as varchar(20)), '-', cast(day(ts) as varchar(4))) as trace_id,
  event_id as span_id,
  lag(event_id) over (partition by user_id, day(ts) order by ts, event_id) as parent_span_id,
  concat('svc-', cast(user_id % 5 as varchar(10))) as service_name,
  event_type as operation, ts as start_ts,
  cast(round(value * 1000) as bigint) as duration_us,
  case when event_type = 'error' then 'Error' else 'Ok' end as status, user_id, k
from ev"""),
    "span_tags": (["spans"], """select trace_id, span_id, 'user.id' as tag_key, cast(user_id as varchar(20)) as tag_value from spans
union all select trace_id, span_id, 'session.id', trace_id from spans
union all select trace_id, span_id, 'request.id', cast(span_id as varchar(20)) from spans"""),
    "event_samples": (["ev"], """select event_id, ts, event_type as event_name, false as is_error,
  cast(round(value * 1000000) as bigint) as latency_ns from ev where event_type <> 'error'"""),
    "event_outcomes": (["ev"], """select event_id, ts, concat('user.', cast(user_id as varchar(20))) as event_name,
  event_type = 'error' as is_error, cast(round(value * 1000000) as bigint) as latency_ns from ev"""),
    "kind_outcomes": (["ev"], """select event_id, ts, event_type as event_name, k < 10 as is_error,
  cast(round(value * 1000000) as bigint) as latency_ns from ev"""),
    "connections": (["ev"], """select event_id, ts, case event_type when 'signup' then 1 else -1 end as delta from ev
where event_type in ('signup', 'purchase')"""),
    "metric_samples": (["ev"], """select event_type as job, concat('host-', cast(user_id % 3 as varchar(4))) as instance,
  ts, event_id, value from ev"""),
    "text_payload_lines": (["metric_samples"], """select event_id * 3 + n as line_no,
  case n when 0 then concat('# TYPE ws_', job, ' gauge') when 1 then concat('ws_', job, ' ', cast(event_id as varchar(20)))
  else case when event_id % 2 = 0 then '' else ' ' end end as line
from metric_samples cross join (select 0 as n union all select 1 union all select 2) z"""),
    "progress": (["ev"], """select event_id, user_id, cast(k % 50 as bigint) as question_id, event_type = 'purchase' as correct,
  cast(1 + k % 5 as int) as difficulty, ts as answered_at
from ev where event_type in ('purchase', 'click')"""),
    "question_concepts": ([], """select doc_id as question_id, cast(1 + doc_id % 5 as int) as difficulty, source as concept from documents
union all select doc_id, cast(1 + doc_id % 5 as int), lang from documents"""),
    "questions": ([], """select doc_id as question_id, cast(1 + doc_id % 5 as int) as difficulty,
  [source, lang] as concepts from documents"""),
    "status_snapshots": (["ev"], """select event_id, ts, cast(ts as date) as day,
  concat('svc-', cast(user_id % 5 as varchar(10))) as service,
  case when event_type = 'error' then 'exited' else 'running' end as state,
  case k % 4 when 0 then 'none' when 1 then 'healthy' when 2 then 'starting' else 'unhealthy' end as health
from ev"""),
    "invocation_params": (["ev"], """select event_id as invocation_id,
  case k % 5 when 0 then 'db.query' when 1 then 'infra.logs' when 2 then 'infra.start' when 3 then 'obs.metrics'
             else 'no.such' end as command,
  case event_type when 'click' then 'sql' when 'view' then 'service' when 'signup' then 'timeout' else null end as param,
  cast(k as varchar(10)) as param_value
from ev"""),
    "session_messages": (["ev"], """select event_id, ts, concat('s', cast(user_id as varchar(20)), '-', cast(day(ts) as varchar(4))) as session_id,
  case event_type when 'signup' then 'client.connect' when 'view' then 'kc.request.next'
    when 'click' then 'kc.answer.submit' when 'purchase' then 'kc.answer.result' else 'kc.adaptive.update' end as event,
  concat('{"event":"', event_type, '","data":', props, ',"meta":{"user_id":"', cast(user_id as varchar(20)), '"',
    case when k % 7 = 0 then '' else '}}' end) as raw, k, user_id, event_type
from ev"""),
    "app_errors": (["ev"], """select event_id, ts, user_id,
  case k % 9 when 0 then 'protocol.invalid_envelope' when 1 then 'protocol.unknown_event' when 2 then 'protocol.invalid_payload'
    when 3 then 'auth.token_expired' when 4 then 'auth.unauthorized' when 5 then 'db.query_failed' when 6 then 'db.not_found'
    when 7 then 'rate_limit.exceeded' else 'internal.error' end as code,
  concat('message ', cast(k as varchar(10))) as message,
  case when k % 2 = 0 then concat('cause ', cast(k as varchar(10))) else null end as cause,
  case when k % 4 = 0 then '' else concat('req-', cast(event_id as varchar(20))) end as request_id,
  concat('t', cast(user_id as varchar(20)), '-', cast(day(ts) as varchar(4))) as trace_id
from ev where event_type = 'error'"""),
    "utterances": (["ev"], """select event_id, concat(
  case event_type when 'click' then 'please show the' when 'view' then 'Start my' when 'purchase' then 'stop'
    when 'signup' then 'run' else 'zzz' end, ' ',
  case k % 8 when 0 then 'Postgres logs' when 1 then 'Jaeger services' when 2 then 'database migrations'
    when 3 then 'prometheus METRICS' when 4 then 'infrastructure' when 5 then 'sql query'
    when 6 then 'otel-collector logs' else 'é e quux' end, ' ',
  case k % 3 when 0 then 'in background' when 1 then 'and remove volume' else 'now' end) as text from ev"""),
    "commands": ([], "select * from (" + _values(
        (n, " ".join([n, d, *e])) for n, d, e in COMMANDS) + ") t(entry, text)"),
    "spec": ([], "select * from (" + _values(
        [(n, None, None, False, None) for n, _, _ in COMMANDS] + PARAMETERS)
        + ") t(command, param, type, required, default_value)"),
    "label_means": ([], """select query_id, list(m order by i) as q from (
  select cast(label as bigint) as query_id, i, avg(cast(embedding[i] as double)) as m
  from embeddings, unnest(generate_series(1, 64)) as g(i) group by all) t group by query_id"""),
}


def _matches(texts: str, key: str, catalogue: str, entry: str) -> dict[str, tuple[list[str], str]]:
    """Views of the matching steps for one pair of texts and catalogue."""
    used = [v for v in (texts, catalogue) if v in VIEWS]
    return {
        "cat": (used, f"select {entry} as entry, token, count(*) as n from (select {entry}, unnest({_tokens('text')}) as token "
                      f"from {catalogue}) t group by all"),
        "cat_norm": (["cat"], "select entry, sum(n * n) as norm2 from cat group by entry"),
        "tok": (["cat"], f"select {key}, token, count(*) as n from (select {key}, unnest({_tokens('text')}) as token "
                         f"from {texts}) t where token in (select token from cat) group by all"),
        "tok_norm": (["tok"], f"select {key}, sum(n * n) as norm2 from tok group by {key}"),
        "pairs": (["tok_norm", "cat_norm"], f"""select tok.{key}, cat.entry,
  sum(tok.n * cat.n) / sqrt(cast(any_value(tok_norm.norm2) as double) * cast(any_value(cat_norm.norm2) as double)) as score
  from tok join cat using (token) join tok_norm using ({key}) join cat_norm on cat_norm.entry = cat.entry
  group by tok.{key}, cat.entry"""),
        "best": (["pairs"], f"""select t.{key}, p.entry, coalesce(p.score, 0.0) as confidence from {texts} t left join (
  select *, row_number() over (partition by {key} order by score desc, entry) as rn from pairs) p
  on p.{key} = t.{key} and p.rn = 1"""),
    }


_DOCS = _matches("documents", "doc_id", "benchmark", "item_id")
_SAYS = _matches("utterances", "event_id", "commands", "entry")
_KNN = """select query_id, rank, vec_id, round(distance, 6) as distance from (
select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from (
select query_id, vec_id, {distance} as distance from label_means, embeddings) d) r where rank <= {k}"""
_COSINE = _KNN.format(distance="1 - list_cosine_similarity(q, cast(embedding as double[]))", k=10)
_IVF_ROWS = """with c as (select query_id as list_id, q as centre from label_means),
 asked as (select vec_id as query_id, cast(embedding as double[]) as q from embeddings where vec_id % 20 = 0 and embedding is not null),
 a as (select vec_id, embedding, list_id from (select vec_id, embedding, list_id, row_number() over (partition by vec_id
   order by round(list_distance(centre, cast(embedding as double[])), 9), list_id) as rn from embeddings, c where embedding is not null) t where rn = 1),
 p as (select query_id, q, list_id from (select query_id, q, list_id, row_number() over (partition by query_id
   order by round(list_distance(q, centre), 9), list_id) as rn from asked, c) t where rn <= 8),
 near as (select query_id, rank, vec_id, distance from (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank
   from (select query_id, vec_id, list_distance(q, cast(embedding as double[])) as distance from p join a using (list_id)) d) r where rank <= 10)"""

_L2 = _KNN.format(distance="list_distance(q, cast(embedding as double[]))", k=10)
_IN_TIME = """exists(select 1 from session_messages r where r.session_id = a.session_id and r.event = '{event}'
    and r.ts between a.ts and a.ts + interval 8 hours)"""
_DEADLINE = f"""select *, case when result_in_time and update_in_time then 'complete' else 'late_or_absent' end as status from (
select a.event_id as answer_id, a.session_id, a.ts as answered_at,
  {_IN_TIME.format(event='kc.answer.result')} as result_in_time,
  {_IN_TIME.format(event='kc.adaptive.update')} as update_in_time
from session_messages a where a.event = 'kc.answer.submit') t"""
_STATS = """select c.event_name, c.count, c.errors, cast(r.total // r.latency_samples as bigint) as avg_latency_ns, r.latency_samples
from (select event_name, count(*) filter (not is_error) as count, count(*) filter (is_error) as errors from {v} group by 1) c
join (select event_name, sum(latency_ns) as total, count(*) as latency_samples from (
  select *, row_number() over (partition by event_name order by ts desc, event_id desc) as rn from {v} where not is_error) x
  where rn <= 100 group by 1) r using (event_name) where c.count > 0"""
_RAW_LINES = """select event_id, user_id, ts, part, case when event_id % 3 <> 0 then msg when part = 0 then substr(msg, 1, 8)
    else substr(msg, 9) end || case when event_id % 3 = 0 and part = 0 then '' else chr(10) end as log
from (select log_id as event_id, user_id, ts, coalesce(log, 'no message at all') as msg from logs) l
cross join (select 0 as part union all select 1) p where part = 0 or event_id % 3 = 0"""
_WHOLE = """select concat('c', cast(user_id % 16 as varchar)) as container_id, ts, coalesce(log, 'no message at all') || chr(10) as log
from logs"""
_GAUGE = "select event_id, ts, cast(sum(delta) over (order by ts, event_id) as bigint) as active from connections"
_TOTALS = "select count(*) filter (delta > 0) as total, cast(coalesce(sum(delta), 0) as bigint) as active from connections"
_SCRAPE = """select job, instance, step_start, step_start + interval 15 seconds as step_end, value from (
select *, row_number() over (partition by job, instance, step_start order by ts desc, event_id desc) as rn from (
select *, time_bucket(interval 15 seconds, ts, timestamp '1970-01-01') as step_start from metric_samples) b) r where rn = 1"""
_SEVERE = """select coalesce(container_name, 'unknown-service') as service_name, severity_text,
  concat('log.', severity_text) as operation from (
  select container_name, case severity_text when 'DEBUG' then 5 when 'INFO' then 9 when 'WARN' then 13
    when 'ERROR' then 17 else 21 end as n, severity_text, log_id, ts from (
  select *, case
    when lower(lv) in ('error', 'err') then 'ERROR' when lower(lv) in ('warn', 'warning') then 'WARN'
    when lower(lv) in ('fatal', 'critical') then 'FATAL' when lower(lv) = 'info' then 'INFO'
    when lower(lv) in ('debug', 'trace') then 'DEBUG'
    when regexp_matches(lower(coalesce(log, '')), 'error|exception|failed|failure|panic') then 'ERROR'
    when regexp_matches(lower(coalesce(log, '')), 'warn|deprecated') then 'WARN'
    when regexp_matches(lower(coalesce(log, '')), 'fatal|critical') then 'FATAL' else 'INFO' end as severity_text
  from (select *, coalesce(case when log like '{%' then log ->> '$.level' end, level, '') as lv from logs) p) q) r where n >= 13"""

# name -> (views it reads, SQL, own views)
ORACLES: dict[str, tuple] = {
    "log_tail_load": (["logs"], f"""select concat('c', cast(user_id % 16 as varchar)) as container_id, log, 'stdout' as stream,
  'docker' as source, ts + to_microseconds(part) as ts from ({_RAW_LINES}) t"""),
    "trace_json_load": (["spans"], """select trace_id, cast(span_id as varchar) as span_id,
  cast(parent_span_id as varchar) as parent_span_id, operation, start_ts, duration_us, 3 as tag_count,
  cast(user_id as varchar) as user_tag, cast(span_id as varchar) as request_tag from spans"""),
    "metric_json_load": (["metric_samples"], """select event_id, job, instance, 'up' as name,
  cast(1700000000 + event_id as double) as ts, case when job = 'error' then 0.0::double else 1.0::double end as value
from metric_samples"""),
    "exposition_load": (["text_payload_lines"], """select line_no, split_part(line, ' ', 1) as name,
  cast(split_part(line, ' ', 2) as double) as value from text_payload_lines where line like 'ws%'"""),
    "union_receivers": (["logs", "app_errors"], """select ts, container_name, level, log as body, null::varchar as severity_text,
  null::varchar as request_id from logs
union all select ts, null, null, message, 'ERROR', request_id from app_errors"""),
    "render_exposition": (["event_samples", "connections"], f"""with st as ({_STATS.format(v='event_samples')}), c as ({_TOTALS}),
  t as (select coalesce(sum(count), 0) as n, coalesce(max(case when event_name = 'purchase' then avg_latency_ns end), 0) as ns from st)
select 1 as line_no, '# TYPE ws_connections gauge' as line
union all select 2, 'ws_connections ' || active from c
union all select 3, '# TYPE ws_events_total counter'
union all select 4, 'ws_events_total ' || cast(n as bigint) from t
union all select 5, '# TYPE ws_purchase_latency_seconds gauge'
union all select 6, 'ws_purchase_latency_seconds ' || printf('%.6f', ns / 1e9) from t"""),
    "write_signals": (["logs", "spans", "metric_samples"], f"""select 'traces' as signal, cast(cast(start_ts as date) as varchar) as day,
  'development' as environment, case when status = 'Ok' then service_name else 'unknown-service' end as name, count(*) as n from spans group by all
union all select 'metrics', cast(cast(ts as date) as varchar), 'development', 'agent_' || job, count(*) from metric_samples group by all
union all select 'logs', cast(cast(ts as date) as varchar), 'development', service_name, count(*) from (
  {_SEVERE.replace("select coalesce(container_name, 'unknown-service') as service_name", "select ts, coalesce(container_name, 'unknown-service') as service_name")}) s group by all"""),
    "sql_query_rows_affected": (["questions"], "select count(*) as rows_affected from questions where difficulty = 3"),
    "detect_level": (["levels"], "select log_id, severity_text, severity_number from levels"),
    "merge_json_log": (["logs"], """select log_id, coalesce(case when log like '{%' then log ->> '$.level' end, level) as level,
  case when log like '{%' then log ->> '$.msg' end as msg, log from logs"""),
    "extract_level_word": (["logs"], """select log_id, nullif(regexp_extract(log,
  '(ERROR|WARN|WARNING|INFO|DEBUG|FATAL|error|warn|warning|info|debug|fatal)', 1), '') as level_word from logs"""),
    "keep_severe": (["levels"], "select log_id, severity_text from levels where severity_text in ('ERROR', 'WARN', 'FATAL')"),
    "drop_below_warn": (["levels"], "select log_id, severity_number from levels where severity_number >= 13"),
    "severity_band": (["ev"], """select event_id, k % 26 as severity_number, case when k % 26 between 1 and 4 then 'TRACE'
  when k % 26 between 5 and 8 then 'DEBUG' when k % 26 between 9 and 12 then 'INFO' when k % 26 between 13 and 16 then 'WARN'
  when k % 26 between 17 and 20 then 'ERROR' when k % 26 between 21 and 24 then 'FATAL' end as severity_band from ev"""),
    "modify_fields": (["logs"], "select log_id, container_name as service_name, 'development' as environment from logs"),
    "log_transform": (["levels"], """select log_id, coalesce(container_name, 'unknown-service') as service_name,
  'log.' || severity_text as operation, log as body from levels"""),
    "tag_for_trace_ui": (["levels"], """select log_id, coalesce(container_name, 'unknown-service') as jaeger_service,
  'log.' || severity_text as jaeger_operation, 'development' as environment from levels"""),
    "trace_default_service": (["spans"], """select span_id, case when status = 'Ok' then service_name else 'backend' end as service_name
from spans"""),
    "drop_long_lines": (["logs"], "select log_id, log from logs where coalesce(strlen(log), 0) <= 25"),
    "match_labels": (["metric_samples"], """select event_id, job, instance, value from metric_samples
where job = 'purchase' and instance = 'host-1'"""),
    "filter_difficulty": (["questions"], "select question_id, difficulty from questions where difficulty = 3"),
    "filter_concepts": (["questions"], """select 'any' as match, question_id, array_to_string(concepts, ',') as concepts
from questions where list_has_any(concepts, ['src1', 'fr'])
union all select 'all', question_id, array_to_string(concepts, ',') from questions where list_has_all(concepts, ['src1', 'fr'])"""),
    "embedding_backfill": ([], "select doc_id, lang from documents where doc_id not in (select vec_id from embeddings) order by 1"),
    "enrich_context": (["app_errors"], """select event_id,
  coalesce(nullif(request_id, ''), md5(cast(event_id as varchar) || '|' || code)) as request_id, trace_id as correlation_id,
  cast(user_id as varchar) as user_id, case when cause is not null then 's' || trace_id end as session_id from app_errors"""),
    "error_is": (["app_errors"], """select event_id, code, '[' || code || '] ' || message ||
  case when cause is null then '' else ': ' || cause end as error_text from app_errors where code = 'db.not_found'"""),
    "correlation_match": (["span_tags", "app_errors"], """select set_id, trace_id, span_id, operation, hits from (
select h.*, s.operation, row_number() over (partition by set_id order by s.start_ts, s.span_id) as rn from (
  select i.set_id, t.trace_id, t.span_id, count(*) as hits from (
    select event_id as set_id, 'user.id' as tag_key, cast(user_id as varchar) as tag_value from app_errors
    union all select event_id, 'session.id', trace_id from app_errors
    union all select event_id, 'request.id', cast(event_id as varchar) from app_errors) i
  join span_tags t using (tag_key, tag_value) group by all having count(*) >= 2) h
join spans s using (trace_id, span_id)) r where rn = 1"""),
    "series_up": (["metric_samples"], """select count(*) > 0 as success, count(*) as series, min_by(case when job = 'error' then 0.0::double else 1.0::double end, event_id)
  as first_value from metric_samples where job = 'purchase'"""),
    "missing_spans": (["spans"], """select trace_id, missing from (select distinct trace_id from spans) t
cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) e(missing)
where not exists (select 1 from spans s where s.trace_id = t.trace_id and s.operation = e.missing)"""),
    "trace_integrity": (["spans"], """with broken as (select trace_id, span_id, case when status = 'Error' then
    case when k % 2 = 0 then min(span_id) over (partition by user_id) else -span_id end else parent_span_id end as parent_span_id from spans)
select c.trace_id, count(*) as spans, count(*) filter (c.parent_span_id is null) as roots,
  count(*) filter (c.parent_span_id is not null and (p.trace_id is null or p.trace_id <> c.trace_id)) as orphans,
  count(*) filter (p.trace_id <> c.trace_id) as foreign_parents
from broken c left join broken p on p.span_id = c.parent_span_id group by 1"""),
    "error_pattern_scan": (["logs"], f"""select pattern, n_lines, first_line from (
select p.pattern, count(*) as n_lines, arg_min(log, (ts, log_id)) as first_line
from logs join ({_values([(p,) for p in EXPORT_ERRORS])}) p(pattern) on contains(lower(log), lower(p.pattern)) group by 1) t"""),
    "pattern_table_scan": ([], """select pattern, count(*) as n_lines, arg_min(text, doc_id) as first_line
from documents join (select distinct left(text, 30) as pattern from benchmark where text <> '') p on contains(lower(text), lower(pattern)) group by 1"""),
    "pending_versions": ([], """select doc_id as version, lpad(cast(doc_id as varchar), 9, '0') || '_' || source || '.sql' as file_name
from documents where doc_id not in (select doc_id from labels) order by 1"""),
    "validate_invocations": (["invocation_params", "spec"], """with c as (select distinct invocation_id, command from invocation_params),
 g as (select invocation_id, command, param, param_value from invocation_params where param is not null),
 e as (select c.invocation_id, c.command, s.param, s.type, s.required, s.default_value, s.command is not null as is_known
   from c left join spec s using (command)),
 m as (select coalesce(e.invocation_id, g.invocation_id) as invocation_id, coalesce(e.command, g.command) as command,
   coalesce(e.param, g.param) as param, g.param is not null as is_given, g.param_value, e.type, e.required, e.default_value, e.is_known
   from e full join g on e.invocation_id = g.invocation_id and e.param = g.param)
select invocation_id, command, param, status, value,
  case when type = 'duration' then '120000000000' when value = '' then null else value end as typed_value from (
select *, case when param is null then case when is_known then 'known' else 'unknown_command' end when is_given then 'given'
   when default_value is not null then 'default' when required then 'missing' end as status,
   case when is_given then param_value else default_value end as value from m) t where status is not null"""),
    "answer_deadline": (["session_messages"], _DEADLINE),
    "progress_by_concept": (["progress", "question_concepts"], """select user_id, concept, count(*) as attempts,
  round(avg(case when correct then 1.0 else 0.0 end), 6) as correct_share
from progress join question_concepts using (question_id) group by 1, 2"""),
    "log_trace_join": (["spans"], """with w as (select span_id as event_id, k, trace_id, start_ts + to_microseconds(k * 1000) as ts from spans)
select event_id, trace_id, span_id, ts, operation from (
select w.event_id, w.trace_id, s.span_id, w.ts, s.operation, row_number() over (partition by w.event_id
    order by s.start_ts desc, s.duration_us, s.span_id) as rn
from w join spans s on s.trace_id = w.trace_id and w.ts between s.start_ts and s.start_ts + to_microseconds(s.duration_us)
  and (w.k % 2 <> 0 or s.span_id = w.event_id)) t where rn = 1"""),
    "retrieve_documents": (["label_means"], f"""select query_id, rank, doc_id, text from (
{_KNN.format(distance="1 - list_cosine_similarity(q, cast(embedding as double[]))", k=5)}) n join documents on doc_id = vec_id"""),
    "event_stats": (["event_outcomes"], _STATS.format(v="event_outcomes")),
    "event_stats_by_kind": (["kind_outcomes"], _STATS.format(v="kind_outcomes")),
    "connection_totals": (["connections"], _TOTALS),
    "total_events": (["event_outcomes"], "select count(*) filter (not is_error) as total_events from event_outcomes"),
    "stats_snapshot": (["kind_outcomes", "connections"], f"""select null::varchar as event_name, total::bigint as total, active::bigint as active,
  null::bigint as count, null::bigint as errors, null::bigint as avg_latency_ns, null::bigint as latency_samples from ({_TOTALS}) c
union all select event_name, null, null, count, errors, avg_latency_ns, latency_samples from ({_STATS.format(v='kind_outcomes')}) s"""),
    "trace_summary": (["spans"], """select trace_id, count(*) as spans, string_agg(distinct operation, ',' order by operation) as operations,
  min(start_ts) as started, max(start_ts + to_microseconds(duration_us)) as ended from spans group by 1"""),
    "list_services": (["spans"], "select distinct service_name from spans"),
    "metric_line_count": (["text_payload_lines"], """select count(*) as metric_lines from text_payload_lines
where line <> '' and line not like '#%'"""),
    "receiver_seen": (["logs"], """select coalesce(bool_or(level = 'notice' and log is not null), false) as seen from logs"""),
    "service_readiness": (["status_snapshots"], """select day, count(*) as found, bool_and(state = 'running') as all_running,
  bool_and(health in ('none', 'healthy')) as all_healthy,
  bool_and(state = 'running') and bool_and(health in ('none', 'healthy')) and count(*) = 5 as ready from (
select *, row_number() over (partition by day, service order by ts desc, event_id desc) as rn from status_snapshots) t
where rn = 1 group by 1"""),
    "check_report": (["logs", "spans", "metric_samples"], """with s as (
select 'logs' as phase, count(*) filter (log like '%connection refused%') = 0 as ok, date_diff('microsecond', min(ts), max(ts)) as d from logs
union all select 'traces', count(*) > 0, date_diff('microsecond', min(start_ts), max(start_ts)) from spans
union all select 'metrics', count(*) > 0, date_diff('microsecond', min(ts), max(ts)) from metric_samples)
select phase, case when phase = 'logs' then 1 else 2 end as steps, case when ok then case when phase = 'logs' then 1 else 2 end else 0 end as passed,
  ok as success, d as duration_us, case phase when 'logs' then 'no export errors=' || ok
    when 'traces' then 'services named=true;spans exist=true' else 'lines exist=true;samples exist=true' end as results,
  (select bool_and(ok) from s) as run_success from s"""),
    "call_groups": (["invocation_params"], """select *, cast(sum(calls) over (partition by command_group) as bigint) as group_calls from (
select command, split_part(command, '.', 1) as command_group, count(*) as calls from invocation_params group by 1, 2) t"""),
    "query_span_stats": (["spans"], """select operation, count(*) as spans, count(*) filter (status = 'Error') as failures,
  cast(sum(duration_us) as bigint) as total_us, round(avg(k % 4), 6) as mean_params from (
select case operation when 'click' then 'db.query' when 'error' then 'db.query' when 'view' then 'db.transaction.save'
  when 'purchase' then 'db.migration' end as operation, status, duration_us, k from spans) t where operation is not null group by 1"""),
    "error_families": (["app_errors"], """select split_part(code, '.', 1) as family, code, count(*) as errors from app_errors
group by rollup(family, code)"""),
    "error_rate": (["event_outcomes"], """select coalesce(event_name, '(all)') as event_name, count(*) as outcomes,
  count(*) filter (is_error) as errors, round(count(*) filter (is_error) / count(*), 6) as error_rate
from event_outcomes group by rollup(event_name)"""),
    "span_red": (["spans"], """select service_name, operation, count(*) as spans,
  round(count(*) filter (status = 'Error') / count(*), 6) as error_share, round(avg(duration_us), 6) as mean_us,
  round(quantile_cont(cast(duration_us as double), 0.95), 6) as p95_us from spans group by 1, 2"""),
    "latency_ring": (["event_samples"], """select event_name, event_id, latency_ns, rank from (
select *, row_number() over (partition by event_name order by ts desc, event_id desc) as rank from event_samples) t where rank <= 100"""),
    "active_gauge": (["connections"], _GAUGE),
    "recent_progress": (["progress"], """select user_id, rank, event_id, question_id, correct, answered_at from (
select *, row_number() over (partition by user_id order by answered_at desc, event_id desc) as rank from progress) t where rank <= 5"""),
    "log_tail": (["logs"], """select container_name, log_id, rank from (
select *, row_number() over (partition by container_name order by ts desc, log_id desc) as rank from logs) t where rank <= 100"""),
    "latest_sample": (["metric_samples"], """select job, instance, ts, value from (
select *, row_number() over (partition by job, instance order by ts desc, event_id desc) as rn from metric_samples) t where rn = 1"""),
    "scrape_samples": (["metric_samples"], _SCRAPE),
    "conversation_history": ([], """select conv_id, turn, role, text from (
select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) t where rn <= 4"""),
    "context_size": ([], f"""select conv_id, turn, tokens, cast(sum(tokens) over (partition by conv_id order by turn) as bigint) as context_tokens
from (select conv_id, turn, coalesce(len({_tokens('text')}), 0) as tokens from conversations) t"""),
    "search_traces": (["spans"], """select trace_id, count(*) as spans, min(start_ts) as started from spans
where service_name = 'svc-1' and start_ts >= (select max(start_ts) from spans) - interval 24 hours
group by 1 order by started desc, trace_id limit 100"""),
    "knn_cosine": (["label_means"], _COSINE),
    "knn_l2": (["label_means"], _L2),
    "knn_ivf": (["label_means"], """with c as (select query_id as list_id, q as centre from label_means),
 a as (select vec_id, embedding, list_id from (select vec_id, embedding, list_id, row_number() over (partition by vec_id
   order by round(list_distance(centre, cast(embedding as double[])), 9), list_id) as rn from embeddings, c where embedding is not null) t where rn = 1),
 p as (select query_id, q, list_id from (select query_id, q, list_id, row_number() over (partition by query_id
   order by round(list_distance(q, centre), 9), list_id) as rn from label_means, c) t where rn <= 3)
select query_id, rank, vec_id, round(distance, 6) as distance from (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank
  from (select query_id, vec_id, list_distance(q, cast(embedding as double[])) as distance from p join a using (list_id)) d) r where rank <= 10"""),
    "knn_ivf_rows": (["label_means"], f"""{_IVF_ROWS}
select query_id, rank, vec_id, round(distance, 6) as distance from near"""),
    "knn_ivf_rows_recall": (["label_means"], f"""{_IVF_ROWS}, exact as (select query_id, vec_id from (select query_id, vec_id, row_number() over (partition by query_id
   order by round(list_distance(q, cast(embedding as double[])), 9), vec_id) as rank from asked, embeddings where embedding is not null) t where rank <= 10)
select round(count(near.vec_id) / count(*), 6) as recall from exact left join near using (query_id, vec_id)"""),
    "knn_ivf_codes": ([], "select vec_id as query_id, 10 as n, 0 as n_wrong from embeddings where vec_id % 20 = 0 and embedding is not null"),
    "knn_ivf_recall": ([], "select true as finds_nine_tenths, 60 <= 0.2 * count(*) as compares_a_fifth from embeddings where embedding is not null"),
    "intent_match": (["best"], "select doc_id, entry, round(confidence, 6) as confidence from best", _DOCS),
    "intent_match_commands": (["best"], "select event_id, entry, round(confidence, 6) as confidence from best", _SAYS),
    "tokenize": ([], f"select doc_id, token, count(*) as n from (select doc_id, unnest({_tokens('text')}) as token from documents) t group by all"),
    "term_vectors": (["tok_norm"], """select doc_id, token, n, round(n / sqrt(cast(norm2 as double)), 6) as weight
from tok join tok_norm using (doc_id)""", _DOCS),
    "intent_route": (["best"], """select entry, case when entry is not null then 'embeddings' else 'unmatched' end as source_alone,
  case when confidence >= 0.7 then 'embeddings' else 'llm' end as source, count(*) as n from best group by all""", _SAYS),
    "extract_slots": (["best"], """select event_id, entry, case when entry = 'infra.logs' then case
    when contains(lower(text), 'postgres') then 'postgres' when contains(lower(text), 'jaeger') then 'jaeger'
    when contains(lower(text), 'prometheus') then 'prometheus' when contains(lower(text), 'otel') then 'otel' end end as service,
  case when entry = 'infra.start' and (contains(text, 'background') or contains(text, '-d')) then true end as detached,
  case when entry = 'infra.stop' and (contains(text, 'volume') or contains(text, '-v')) then true end as remove_volumes
from best join utterances using (event_id)""", _SAYS),
    "parse_envelopes": (["session_messages"], """select event_id, case when k % 7 <> 0 then event_type end as event,
  case when k % 7 <> 0 then k end as k, case when k % 7 <> 0 then cast(user_id as varchar) end as meta_user_id,
  case when k % 7 = 0 then 'protocol.invalid_envelope' when event_type = 'error' then 'protocol.unknown_event' end as error_code
from session_messages"""),
    "parse_widgets": ([], """select doc_id as question_id, case when doc_id % 2 = 0 then 'mcq' else 'text' end as widget_type,
  'w' || doc_id as widget_id, cast(doc_id as varchar) as asked_id, null::varchar as question,
  case when doc_id % 2 = 0 then lang end as first_option, cast(1 + doc_id % 5 as int) as difficulty,
  source || ',' || lang as concepts from documents"""),
    "namespace_metrics": (["metric_samples"], "select distinct 'agent_' || job as name, instance from metric_samples"),
    "span_events": (["spans"], """select trace_id, span_id, start_ts, 'executing query' as event_name, 'debug' as level, null::varchar as error_message,
  'db.rows=' || k || ';level=debug' as attributes from spans
union all select trace_id, span_id, start_ts, 'retry', null, null, 'attempt=' || (k % 3) from spans
union all select trace_id, span_id, start_ts, case when status = 'Error' then 'query failed' else 'query completed successfully' end,
  case when status = 'Error' then 'error' else 'info' end, case when status = 'Error' then 'boom' end,
  case when status = 'Error' then 'error.message=boom;level=error' else 'level=info' end from spans"""),
    "session_funnel": (["session_messages"], """with m as (select session_id, ts, event from session_messages),
 a as (select s.session_id, (select min(ts) from m where m.session_id = s.session_id and event = 'client.connect') as t0
       from (select distinct session_id from m) s),
 b as (select *, (select min(ts) from m where m.session_id = a.session_id and event = 'kc.request.next' and ts >= t0) as t1 from a),
 c as (select *, (select min(ts) from m where m.session_id = b.session_id and event = 'kc.answer.submit' and ts >= t1) as t2 from b),
 d as (select *, (select min(ts) from m where m.session_id = c.session_id and event = 'kc.answer.result' and ts >= t2) as t3 from c)
select session_id, (t0 is not null)::int + (t1 is not null)::int + (t2 is not null)::int + (t3 is not null)::int as stages_reached,
  case when t0 is null then 'client.connect' when t1 is null then 'kc.request.next' when t2 is null then 'kc.answer.submit'
    when t3 is null then 'kc.answer.result' end as first_missing from d"""),
    "check_rows": ([], """select doc_id as question_id, 'body_not_null' as rule from documents where n_chars % 5 = 0
union all select doc_id, 'difficulty_not_null' from documents where doc_id % 11 = 0
union all select doc_id, 'difficulty_range' from documents where doc_id % 11 <> 0 and doc_id % 7 not between 1 and 5
union all select doc_id, 'concepts_not_null' from documents where n_chars % 13 = 0
union all select doc_id, 'concepts_not_empty' from documents where n_chars % 3 = 0 and n_chars % 13 <> 0
union all select vec_id, 'embedding_length' from embeddings where len(embedding) <> 64"""),
    "check_unique": (["progress"], "select user_id, question_id, count(*) as n from progress group by 1, 2 having count(*) > 1"),
    "apply_defaults": (["progress"], """select event_id, case when correct then answered_at else timestamp '2024-02-01 00:00:00' end as answered_at
from progress"""),
    "dependency_levels": (["spans"], """with recursive edges as (select span_id as node, parent_span_id as dep from spans where parent_span_id is not null),
 nodes as (select span_id as node from spans union select dep from edges),
 lv as (select node, 0 as level from nodes where node not in (select node from edges)
   union all select e.node, lv.level + 1 from edges e join lv on e.dep = lv.node)
select node, max(level) as level from lv group by 1"""),
    "dependency_levels_dag": ([], """with recursive edges as (select distinct o_orderkey::bigint as node, unnest([o_orderkey // 2, o_orderkey // 3])::bigint as dep from orders),
 e as (select * from edges where dep > 0), nodes as (select node from edges union select dep from e),
 lv as (select node, 0::bigint as level from nodes where node not in (select node from e)
   union select e.node, lv.level + 1 from e join lv on e.dep = lv.node)
select node, max(level) as level from lv group by 1"""),
    "span_depth": (["spans"], """with recursive d as (select trace_id, span_id, 0 as depth from spans where parent_span_id is null
  union all select s.trace_id, s.span_id, d.depth + 1 from spans s join d on s.parent_span_id = d.span_id and s.trace_id = d.trace_id)
select trace_id, span_id, depth from d"""),
    "reassemble": (["logs"], _WHOLE),
    "stream_reassemble": (["logs"], _WHOLE),
    "stream_logs": (["logs"], f"""select container_id as service_name, ts, severity_text, 'log.' || severity_text as operation,
  log as body, msg from (select *, case when lower(coalesce(level, '')) = 'warn' then 'WARN'
    when regexp_matches(lower(log), 'error|exception|failed|failure|panic') then 'ERROR'
    when regexp_matches(lower(log), 'warn|deprecated') then 'WARN'
    when regexp_matches(lower(log), 'fatal|critical') then 'FATAL' else 'INFO' end as severity_text
  from (select *, case when log like '{{%' then log ->> '$.level' end as level, case when log like '{{%' then log ->> '$.msg' end as msg
    from ({_WHOLE}) w) p) s where severity_text <> 'INFO'"""),
    "stream_event_stats": (["kind_outcomes"], _STATS.format(v="kind_outcomes")),
    "stream_active_gauge": (["connections"], _TOTALS),
    "stream_scrape": (["metric_samples"], _SCRAPE),
    "stream_answer_deadline": (["session_messages"], _DEADLINE),
    "severe_log_counts": (["logs"], f"select service_name, severity_text, operation, count(*) as records from ({_SEVERE}) s group by all"),
}


_FOUND, _ABSENT = ORACLES["correlation_match"], ORACLES["missing_spans"]
ORACLES["log_tail_follow"] = ORACLES["log_tail_load"]
ORACLES["concept_mastery"] = (["progress", "questions"], """select user_id, concept, count(*) as answers,
  round(sum(case when correct then difficulty else 0 end) / sum(difficulty)::double, 6) as mastery_score, true as valid
from progress p join (select distinct question_id, unnest(concepts) as concept from questions) c using (question_id) where concept is not null group by 1, 2""")
ORACLES["nearest_concepts"] = (["questions"], """with c as (select distinct question_id, unnest(concepts) as concept from questions),
 m as (select concept, list(m order by i) as v from (select concept, i, avg(embedding[i]::double) as m
   from c join embeddings on vec_id = question_id, unnest(generate_series(1, 64)) as g(i) where concept is not null and embedding is not null group by all) t group by concept),
 d as (select a.concept, b.concept as near, list_distance(a.v, b.v) as distance from m a join m b on a.concept <> b.concept)
select concept, rank, near, round(distance, 6) as distance from (select *, row_number() over (partition by concept order by round(distance, 9), near) as rank from d) r where rank <= 3""")
ORACLES["trace_operations"] = (["spans"], """select trace_id, operation, count(*) as spans, min(start_ts) as started, max(start_ts + to_microseconds(duration_us)) as ended
from spans group by 1, 2""")
ORACLES["filter_concepts_indexed"] = ORACLES["filter_concepts"]
ORACLES["trace_check"] = (["span_tags", "app_errors", "spans"], f"""with found as ({_FOUND[1]}), lacking as ({_ABSENT[1]}),
 n as (select trace_id, count(*) as n_missing from lacking group by 1)
select e.event_id as set_id, f.trace_id, coalesce(f.hits, 0) as hits, case when f.trace_id is null then 5 else coalesce(n.n_missing, 0) end as n_missing,
  f.trace_id is not null and coalesce(n.n_missing, 0) = 0 as success
from app_errors e left join found f on f.set_id = e.event_id left join n on n.trace_id = f.trace_id""")

_READY, _UP, _SNAPSHOT, _SCAN = (ORACLES[k] for k in ("service_readiness", "series_up", "stats_snapshot", "error_pattern_scan"))
ORACLES["verify_run"] = (sorted({*_READY[0], *ORACLES["trace_check"][0], *_UP[0], *_SNAPSHOT[0], *_SCAN[0]}), f"""with steps as (
select 0 as number, 'infrastructure' as phase, 'services are ready' as step, coalesce(bool_and(ready), false) as success,
  count(*) filter (ready) || ' of ' || count(*) || ' ready' as detail from ({_READY[1]}) r
union all select 1, 'data flow', 'traces are whole', coalesce(bool_and(success), false), count(*) filter (success) || ' of ' || count(*) || ' id sets' from ({ORACLES["trace_check"][1]}) t
union all select 2, 'data flow', 'metric is up', coalesce(bool_and(success), false), sum(series) || ' series' from ({_UP[1]}) u
union all select 3, 'data flow', 'snapshot is not empty', count(event_name) > 0,
  'active ' || coalesce(max(active), 0) || ' total ' || coalesce(max(total), 0) || ' events ' || count(event_name) from ({_SNAPSHOT[1]}) s
union all select 4, 'logs', 'lines are there', count(*) > 0, count(*) || ' lines' from logs
union all select 5, 'logs', 'no export failed', count(*) = 0, coalesce(sum(n_lines), 0) || ' lines' from ({_SCAN[1]}) e)
select *, number <= (select coalesce(min(number), 6) from steps where not success) as reached, (select bool_and(success) from steps) as run_success from steps""")


def _with_args(text: str, args: dict) -> str:
    for name, value in args.items():
        text = text.replace(":" + name, _quoted(value))
    return text


def _needed(names: list[str], views: dict, found: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in found:
            _needed(views[name][0], views, found)
            found[name] = None
    return found


def statement(needs: list[str], body: str, own: dict | None = None) -> str:
    """A query text with the views it reads as named subqueries."""
    views = {**VIEWS, **(own or {})}
    parts = [f"{name} as ({views[name][1]})" for name in _needed(needs, views, {})]
    if not parts:
        return body
    if body.lstrip().startswith("with recursive "):
        return "with recursive " + ", ".join(parts) + ", " + body.lstrip()[len("with recursive "):]
    if body.lstrip().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body.lstrip()[len("with "):]
    return "with " + ", ".join(parts) + " " + body


def oracle_sql() -> dict[str, str]:
    """SQL per query key; keys without an entry have no SQL form."""
    texts = {key: statement(*parts) for key, parts in ORACLES.items()}
    for name, (text, args) in TEXTS.items():
        body = _with_args(text, args)
        texts[f"sql_query_{name}"] = statement(["questions"], body) if "questions" in body else body
    return texts
