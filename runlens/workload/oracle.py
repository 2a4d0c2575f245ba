"""The registered queries in SQL for the checking engine, one per key.

Fixed values (word lists, patterns, the prompt) come from the package; the
logic is written out here on its own.
"""

from __future__ import annotations

from runlens.functions.failures import ERROR_CHARS, NO_RULE, PROMPT, RULES
from runlens.functions.screens import SCREEN_WORDS
from runlens.operators.grid import DEVICES
from runlens.operators.lookup import DEFAULT_RATE, EXPECTED_RATES
from runlens.schema import CLASSES, RAW_RUN
from runlens.workload.inputs import RUNS_SQL
from runlens.workload.queries import SESSION_ASKED

DUCK_WORDS = {
    "S": "varchar",
    "ARR": "list_value",
    "EMPTY": "cast([] as varchar[])",
    "EVENTS": "events",
}

ACTION_TYPE = """coalesce(list_filter(list_transform(list_reverse(last_actions), lambda a:
  case when contains(lower(a), 'fill') then 'fill'
       when contains(lower(a), 'tap') or contains(lower(a), 'click') then 'tap'
       when contains(lower(a), 'swipe') or contains(lower(a), 'scroll') then 'swipe'
       when contains(lower(a), 'press') then 'press' end), lambda t: t is not null)[1], 'other')"""

RUNS = f"""runs as (select *, {ACTION_TYPE} as action_type,
  case when result = 'passed' then 1 else 0 end as ok,
  case when result <> 'passed' then 1 else 0 end as bad
  from ({RUNS_SQL.format(**DUCK_WORDS)}) v)"""

HOURLY = """incoming as (select id, case when platform is not null then test_name end as test_name,
  date_trunc('hour', run_at) as run_at, platform, result from runs),
stored as (select * from incoming where platform = 'android'),
firsts as (select id, test_name, run_at, platform, result, copies from (
  select *, row_number() over (partition by test_name, run_at order by id) as n,
    count(*) over (partition by test_name, run_at) as copies from incoming where test_name is not null) k where n = 1
  union all select id, test_name, run_at, platform, result, 1 from incoming where test_name is null)"""
NOT_STORED = "not exists (select 1 from stored s where s.test_name = i.test_name and s.run_at = i.run_at)"

STEPS = """steps as (select user_id as test_id, cast(event_id % 2 as integer) as retry,
  case when event_type = 'view' then 'expect' else 'pw:api' end as category,
  event_type || '#' || cast(event_id % 97 as varchar) as title, ts, event_id as seq from events)"""

LAST_STEPS = f"""with {STEPS}, ranked as (select *, row_number() over (
    partition by test_id, retry order by ts desc, seq desc) as n from steps where category = 'pw:api')
select test_id, retry, string_agg(title, '|' order by ts, seq) as last_actions
from ranked where n <= 10 group by test_id, retry"""

REPLY = """case when id % 11 = 0 then null
  when id % 7 = 0 then '  MAYBE: ' || error_message || ' '
  when id % 13 = 0 then 'GUESS|' || test_name
  else case id % 5 when 0 then 'REAL_BUG' when 1 then ' timeout_flake ' when 2 then 'DEVICE_FLAKE'
    when 3 then 'Locator_Flake' else 'UNKNOWN' end || '| seen in ' || test_name || '|again' || chr(10) end"""

# Rows (…, reply) to rows (…, new_class, new_reason).
PARSED = r"""parsed as (select *, case when known then cat when reply is not null then 'UNKNOWN' end as new_class,
    case when known then regexp_replace(substr(txt, strpos(txt, '|') + 1), '^\s+|\s+$', '', 'g')
         when reply is not null then 'Could not parse: ' || left(txt, 200) end as new_reason
  from (select *, strpos(txt, '|') > 0 and cat in ({classes}) as known
    from (select *, upper(regexp_replace(split_part(txt, '|', 1), '^\s+|\s+$', '', 'g')) as cat
      from (select *, regexp_replace(reply, '^\s+|\s+$', '', 'g') as txt from replies) a) b) c)""".replace(
    "{classes}", ", ".join(f"'{c}'" for c in CLASSES)
)
MERGED = """select id,
  case when result <> 'passed' then case when new_class is not null then new_class else classification end end as classification,
  case when result <> 'passed' then case when new_class is not null then new_reason else classification_reason end end as classification_reason
from parsed"""

ACTIONS_JSON = "'[' || array_to_string(list_transform(last_actions, lambda a: cast(to_json(a) as varchar)), ', ') || ']'"

TIME_TEXT = """case id % 6 when 0 then strftime(run_at, '%Y-%m-%dT%H:%M:%S.%fZ')
  when 1 then strftime(run_at, '%Y-%m-%dT%H:%M:%S.%f')
  when 2 then strftime(run_at, '%Y-%m-%dT%H:%M:%S') || '-05:00'
  when 3 then strftime(run_at, '%Y-%m-%d') when 4 then 'junk'
  else strftime(run_at, '%Y-%m-%d %H:%M') end"""
ISO = "replace(cast(run_at as varchar), ' ', 'T') || 'Z'"

SIXTH = "case when classification is not null and id % 5 = 0 then 'ENV_FLAKE' else classification end"

TITLE = """case id % 5 when 0 then test_name when 1 then replace(test_name, ' - ', ' ')
  when 2 then ' - ' || test_name when 3 then 'works as told' else upper(test_name) end"""

BUCKET = """case when {d} < 5000 then '0-5s' when {d} < 15000 then '5-15s' when {d} < 30000 then '15-30s'
  when {d} < 60000 then '30-60s' when {d} < 120000 then '60-120s' else '120s+' end"""

# One decimal by the exact binary value, as fixed-point formatting prints it. A double
# of up to 100 times ten is exact as a decimal of 38 digits for the counts here.
RATE_EXACT = (
    "cast(floor(cast(cast(sum(bad) as double) / cast(count(*) as double) * 100.0::double as decimal(38, 30))"
    " * 10 + 0.5) as double) / 10"
)
RATE = "round(sum(bad) * 100.0::double / count(*), 1)"
RATE_HALF_EVEN = "round_even(sum(bad)::double / count(*)::double * 100.0::double, 1)"
SECONDS = "cast(floor(round(avg(duration_ms) / 1000)) as bigint)"
RAW_COLUMNS = ", ".join(f.name for f in RAW_RUN.fields)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mentioned(text: str) -> str:
    arms = " ".join(
        "when " + " or ".join(f"contains({text}, '{w}')" for w in words) + f" then '{screen}'"
        for screen, words in SCREEN_WORDS.items()
    )
    return f"case {arms} end"


def _prefixed(text: str) -> str:
    arms = " ".join(
        "when " + " or ".join(f"starts_with({text}, '{w}')" for w in words) + f" then '{screen}'"
        for screen, words in SCREEN_WORDS.items()
    )
    return f"case {arms} end"


def _prompt() -> str:
    fields = {
        "{test_name}": "test_name",
        "{platform}": "coalesce(platform, 'unknown')",
        "{error_message}": f"substr(error_message, 1, {ERROR_CHARS})",
        "{last_actions}": ACTIONS_JSON,
    }
    sql = _quoted(PROMPT)
    for mark, value in fields.items():
        sql = f"replace({sql}, '{mark}', {value})"
    return sql


def _rules(part: int = 1) -> str:
    """The category (1) or the reason (2) of an error."""
    arms = " ".join(
        f"when regexp_matches(lower(error_message), {_quoted(rule[0])}) then {_quoted(rule[part])}" for rule in RULES
    )
    return f"case {arms} else {_quoted(NO_RULE[part - 1])} end"


def _common(keys: str, source: str = "runs") -> str:
    """Per key, the category most of its failures have."""
    return f"""select {keys}, classification as common_classification from (
      select {keys}, classification, row_number() over (partition by {keys}
        order by count(*) desc, coalesce(classification, '') desc) as n
      from {source} where result <> 'passed' and {keys} is not null group by {keys}, classification) r where n = 1"""


SESSIONS = f"""sessions_all as (select session_id,
    max(platform) filter (where newest = 1) as platform, max(device_id) filter (where newest = 1) as device_id,
    count(*) as total_runs, cast(sum(ok) as bigint) as passed, cast(sum(bad) as bigint) as failed,
    {SECONDS} as avg_duration_s, min(run_at) as first_run, max(run_at) as last_run
  from (select *, row_number() over (partition by session_id
      order by run_at desc, platform desc nulls last, device_id desc nulls last) as newest
    from runs where session_id is not null and session_id <> '') o group by session_id),
newest_session as (select * from sessions_all order by last_run desc, session_id limit 1)"""

REPORTS = {
    "stats": f"""select count(*) as total_runs, cast(sum(bad) as bigint) as fail_count,
        cast(sum(case when classification is not null then 1 else 0 end) as bigint) as classified_count,
        cast(sum(case when classification = 'REAL_BUG' then 1 else 0 end) as bigint) as real_bug_count,
        coalesce({RATE_HALF_EVEN}, 0) as flake_rate, coalesce({SECONDS}, 0) as avg_duration,
        coalesce(cast(min(run_date) as varchar) || ' to ' || cast(max(run_date) as varchar), '') as date_range
        from runs""",
    "flake_rate": f"select run_date as day, {RATE} as rate from runs group by run_date order by day limit 60",
    "breakdown": """select coalesce(classification, 'UNCLASSIFIED') as classification, count as count from (
        select classification, count(*) as count from runs where result <> 'passed' group by classification) c""",
    "heatmap": f"""select run_date as day, screen_name as screen, {RATE} as rate from runs
        where screen_name is not null and screen_name <> '' group by run_date, screen_name having count(*) >= 2""",
    "top_flakes": f"""select t.test_name, platform, screen_name, total, fail_count, common_classification from (
        select test_name, platform, max(screen_name) filter (where newest = 1) as screen_name, count(*) as total,
          cast(sum(bad) as bigint) as fail_count
        from (select *, row_number() over (partition by test_name, platform
            order by run_at desc, screen_name desc nulls last) as newest from runs) o
        group by test_name, platform having count(*) >= 2) t
        left join ({_common("test_name")}) c on c.test_name = t.test_name
        order by fail_count::double / total desc, total desc, t.test_name, platform nulls last limit 20""",
    "devices": f"""select t.device_id, platform, total, fail_count, common_classification from (
        select device_id, max(platform) filter (where newest = 1) as platform, count(*) as total,
          cast(sum(bad) as bigint) as fail_count
        from (select *, row_number() over (partition by device_id
            order by run_at desc, platform desc nulls last) as newest from runs) o
        group by device_id having count(*) >= 2) t
        left join ({_common("device_id")}) c on c.device_id = t.device_id""",
    "by_action": f"""select action_type, count(*) as total, cast(sum(bad) as bigint) as fail_count, {RATE} as rate
        from runs where action_type is not null and action_type <> '' group by action_type""",
    "by_platform": f"""select platform, count(*) as total, cast(sum(ok) as bigint) as pass_count,
        cast(sum(bad) as bigint) as fail_count, {RATE} as fail_rate
        from runs where platform is not null and platform <> '' group by platform""",
    "volume": """select run_date as day, cast(sum(ok) as bigint) as pass_count,
        cast(sum(bad) as bigint) as fail_count from runs group by run_date""",
    "duration_dist": f"""select {BUCKET.format(d="duration_ms")} as bucket, count(*) as count
        from runs where result <> 'passed' group by 1""",
    "class_trend": """select run_date as day, classification, count(*) as count from runs
        where result <> 'passed' and classification is not null group by run_date, classification""",
    "sessions": "select * from sessions_all order by last_run desc, session_id limit 20",
    "latest_session": """select max(session_id) as session_id, max(platform) as platform, max(device_id) as device_id,
        coalesce(max(total_runs), 0) as total_runs, coalesce(max(passed), 0) as passed,
        coalesce(max(failed), 0) as failed, max(avg_duration_s) as avg_duration_s from newest_session""",
    "latest_session_tests": """select id, session_id, run_at, test_name, result, duration_ms, platform, screen_name,
        classification from runs where session_id = (select session_id from newest_session)""",
}

STAMP = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
# How a report's columns are written as JSON, where not as they are.
JSON_COLUMNS = {
    "latest_session_tests": {"run_at": STAMP.format(c="run_at")},
    "sessions": {"first_run": STAMP.format(c="first_run"), "last_run": STAMP.format(c="last_run")},
}
COLUMNS = {
    "stats": "total_runs fail_count classified_count real_bug_count flake_rate avg_duration date_range",
    "flake_rate": "day rate",
    "breakdown": "classification count",
    "heatmap": "day screen rate",
    "top_flakes": "test_name platform screen_name total fail_count common_classification",
    "devices": "device_id platform total fail_count common_classification",
    "by_action": "action_type total fail_count rate",
    "by_platform": "platform total pass_count fail_count fail_rate",
    "volume": "day pass_count fail_count",
    "duration_dist": "bucket count",
    "class_trend": "day classification count",
    "sessions": "session_id platform device_id total_runs passed failed avg_duration_s first_run last_run",
    "latest_session": "session_id platform device_id total_runs passed failed avg_duration_s",
    "latest_session_tests": "id session_id run_at test_name result duration_ms platform screen_name classification",
}


ORDERS = {
    "breakdown": "count desc, classification",
    "heatmap": "day, screen",
    "top_flakes": "fail_count::double / total desc, total desc, test_name, platform nulls last",
    "devices": "fail_count::double / total desc, total desc, device_id nulls last",
    "by_action": "rate desc, action_type",
    "by_platform": "fail_rate desc, platform",
    "flake_rate": "day",
    "volume": "day",
    "duration_dist": "list_position(['0-5s', '5-15s', '15-30s', '30-60s', '60-120s', '120s+'], bucket)",
    "class_trend": "day, classification",
    "sessions": "last_run desc, session_id",
    "latest_session_tests": "run_at, id",
}


def _json_report(name: str) -> str:
    written = JSON_COLUMNS.get(name, {})
    fields = ", ".join(f"'{c}': {written.get(c, c)}" for c in COLUMNS[name].split())
    place = f"cast(row_number() over (order by {ORDERS.get(name, '1')}) as integer)"
    return (
        f"select '{name}' as report, {place} as place, cast(to_json({{{fields}}}) as varchar) as payload"
        f" from ({REPORTS[name]}) r_{name}"
    )


def _record(**columns: str) -> str:
    """A record's columns, those not given as they are."""
    given = {"last_actions": "array_to_string(last_actions, '|')", "run_at": ISO} | columns
    return ", ".join(f"{given.get(f.name, f.name)} as {f.name}" for f in RAW_RUN.fields)


NO_CLASS = {"classification": "cast(null as varchar)", "classification_reason": "cast(null as varchar)"}
DETOX = _record(
    **NO_CLASS,
    test_file="replace(test_file, '.spec.ts', '.test.js')",
    device_id="coalesce(device_id, 'unknown')",
    error_message="case when error_message = '' then '' else error_message || chr(10) || 'in ' || test_name end",
    last_actions="''",
)
APPIUM = _record(
    **NO_CLASS,
    test_file="replace(test_file, '.spec.ts', '.js')",
    result="case when result = 'passed' then 'passed' else 'failed' end",
)
PYTEST = _record(
    **NO_CLASS,
    platform="'selenium'",
    device_id="coalesce(device_id, 'chrome')",
    duration_ms="cast(floor(duration_ms::double / 1000 * 1000) as bigint)",
    result="case when error_message = '' then 'passed' else 'failed' end",
    last_actions="''",
    screen_name="test_name",
)

RATES = ", ".join(
    f"('{screen}', '{platform}', {rate}::double)"
    for screen, pair in EXPECTED_RATES.items()
    for platform, rate in zip(("android", "ios"), pair)
)
GRID = f"""grid as (select test_file, test_name, screen_name, device_id, d.platform, cast(day as integer) as day,
    cast(repeat as integer) as repeat, date '2024-01-01' + cast(day as integer) as run_date,
    device_id || '_' || cast(day as varchar) as session_id
  from (select distinct test_file, test_name, screen_name from runs) t,
    (values {", ".join(f"('{a}', '{b}')" for a, b in DEVICES)}) d(device_id, platform),
    range(0, 30) x(day), range(1, 6) y(repeat))"""


def _over_runs(sql: str, *more: str) -> str:
    return "with " + ", ".join([RUNS, *more]) + " " + sql


ORACLE = {
    "read_runs": _over_runs(
        f"select {_record(duration_ms='duration_ms + case when id % 9 = 0 then 1 else 0 end')} from runs"
    ),
    "append_runs_json": _over_runs(
        "select cast(to_json({"
        + ", ".join(f"'{f.name}': {ISO if f.name == 'run_at' else f.name}" for f in RAW_RUN.fields)
        + "}) as varchar) as line from runs"
    ),
    "runs_table": _over_runs("select id % 2 as load_id, id, run_date, run_at, test_name, action_type, duration_ms from runs"),
    "merge_new_runs": _over_runs(f"select * from firsts i where {NOT_STORED}", HOURLY),
    "report_json": _over_runs(f"select payload from ({_json_report('by_platform')}) j"),
    "run_grid": _over_runs("select * from grid", GRID),
    "grid_cross": _over_runs(
        """select test_name, device_id, count(*) as planned, max(run_date) as last_day
        from grid group by test_name, device_id""",
        GRID,
    ),
    "report_bundle": _over_runs(
        " union all ".join(f"select * from ({_json_report(n)}) j_{n}" for n in REPORTS), SESSIONS
    ),
    "action_type": _over_runs("select id, action_type from runs"),
    "screen_of": _over_runs(
        f"""select id, title, coalesce({_prefixed("prefix")},
          case when regexp_full_match(prefix, '[a-z]+') then prefix end, {_mentioned("lower(title)")},
          list_filter(list_transform(last_actions, lambda a: {_mentioned("lower(a)")}), lambda s: s is not null)[1],
          'unknown') as screen
        from (select id, last_actions, title,
            case when contains(title, ' - ') then lower(trim(split_part(title, ' - ', 1))) end as prefix
          from (select id, last_actions, {TITLE} as title from runs) t) p"""
    ),
    "annotation_value": _over_runs(
        """select id, case when device_id is null then '' else coalesce(platform, '') end as platform,
        coalesce(device_id, '') as device_id from runs"""
    ),
    "platform_fallback": _over_runs(
        """select id, case when device_id is not null and platform <> '' then platform
        when screen_name <> 'login' then screen_name else '' end as platform from runs"""
    ),
    "run_day": _over_runs(
        f"""select id, {TIME_TEXT} as text, case id % 6 when 4 then null
        when 2 then cast(run_at + interval 5 hour as date) else run_date end as day from runs"""
    ),
    "pass_fail_flags": _over_runs(
        """select id, case when result = 'passed' then 1 else 0 end as passed,
        case when result in ('failed', 'timedOut') then 1 else 0 end as failed from runs"""
    ),
    "duration_bucket": _over_runs(
        f"""select id, {BUCKET.format(d="d")} as bucket
        from (select id, case when device_id is not null then duration_ms end as d from runs) x"""
    ),
    "class_label": _over_runs("select id, coalesce(classification, 'UNCLASSIFIED') as label from runs"),
    "pct1": _over_runs(
        f"""select test_name, run_date, {RATE} as rate, {RATE_HALF_EVEN} as rate_half_even
        from runs group by test_name, run_date"""
    ),
    "avg_seconds": _over_runs(f"select test_name, {SECONDS} as avg_duration_s from runs group by test_name"),
    "failure_prompt": _over_runs(f"select id, {_prompt()} as prompt from runs where result <> 'passed'"),
    "parse_reply": _over_runs(
        "select id, new_class as classification, new_reason as classification_reason from parsed",
        f"replies as (select id, {REPLY} as reply from runs)",
        PARSED,
    ),
    "rule_classify": _over_runs(
        f"""select id, case when result <> 'passed' then {_rules()} end as classification,
          case when result <> 'passed' then {_rules(2)} end as classification_reason from runs"""
    ),
    "merge_class": _over_runs(MERGED, f"replies as (select *, {REPLY} as reply from runs)", PARSED),
    "actions_json": _over_runs(
        f"select id, {ACTIONS_JSON} as text, cast(len(last_actions) as integer) as n_actions from runs"
    ),
    "date_range": _over_runs(
        """select test_name, cast(min(run_date) as varchar) || ' to ' || cast(max(run_date) as varchar) as date_range
        from runs group by test_name"""
    ),
    "severity_bands": _over_runs(
        f"""select test_name, platform,
          case when rate > 20 then 'high' when rate > 10 then 'medium' else 'low' end as rate_band,
          case when rate = 0 then 'none' when rate < 10 then 'low' when rate < 20 then 'mild'
            when rate < 35 then 'warm' when rate < 50 then 'hot' else 'severe' end as heat_band,
          case when bar > 50 then 'red' when bar > 25 then 'yellow' when bar > 10 then 'orange' else 'green' end as bar_band,
          case when good >= 90 then 'good' when good >= 70 then 'fair' else 'poor' end as pass_band
        from (select test_name, platform, {RATE} as rate, least(100, round(sum(bad) * 100.0::double / count(*))) as bar,
            round(sum(ok) * 100.0::double / count(*)) as good from runs group by test_name, platform) g"""
    ),
    "display_text": _over_runs(
        """select id, left(session_id || '_' || test_name, 30) as session,
        coalesce(left('a device with a long name ' || device_id, 25), '—') as device,
        strftime(run_at, '%Y-%m-%d %H:%M') as minute, strftime(run_date, '%m-%d') as day from runs"""
    ),
    "display_pct": _over_runs(
        f"""select test_name, {RATE_EXACT} as fail_pct, least(100, cast(round(sum(bad) * 100.0::double / count(*)) as bigint)) as bar_pct,
        case when count(classification) > 0 then cast(round(count(*) filter (where classification = 'REAL_BUG') * 100.0::double
          / count(classification)) as bigint) end as bug_share,
        cast(round(sum(ok) * 100.0::double / count(*)) as bigint) as pass_pct from runs group by test_name"""
    ),
    "issue_default": _over_runs(
        """select id, case when classification is null or classification = '' then 'UNKNOWN' else classification end as issue,
        coalesce(platform, '') as platform from runs"""
    ),
    "conform_detox": _over_runs(f"select {DETOX} from runs"),
    "conform_appium": _over_runs(f"select {APPIUM} from runs"),
    "conform_pytest": _over_runs(f"select {PYTEST} from runs where result <> 'skipped'"),
    "conform_capture": f"""with {STEPS}, ranked as (select *, row_number() over (
        partition by test_id, retry, category order by ts desc, seq desc) as n from steps)
      select 'Login - case ' || cast(test_id as varchar) as test_name, 'web' as platform,
        'd' || cast(retry as varchar) as device_id, count(*) as duration_ms,
        case when retry = 0 then 'failed' else 'passed' end as result, '' as error_message, 'login' as screen_name,
        coalesce(string_agg(title, '|' order by ts, seq) filter (where category = 'pw:api' and n <= 10), '') as last_actions
      from ranked group by test_id, retry""",
    "failed_only": _over_runs("select id, result from runs where result <> 'passed'"),
    "present_dim": _over_runs(
        """select id, platform, session_id from runs where platform is not null and platform <> ''
        and session_id is not null and session_id <> ''"""
    ),
    "classified_only": _over_runs("select id, classification from runs where classification is not null"),
    "min_runs": _over_runs(
        """select test_name, device_id, run_date, count(*) as total from runs
        group by test_name, device_id, run_date having count(*) >= 2"""
    ),
    "session_runs": _over_runs(
        f"select id, run_at, test_name, result, duration_ms from runs where session_id = '{SESSION_ASKED}'"
    ),
    "api_steps": f"with {STEPS} select seq, test_id, title from steps where category = 'pw:api'",
    "dedupe_anti": _over_runs(f"select * from incoming i where {NOT_STORED}", HOURLY),
    "test_common_class": _over_runs(_common("test_name")),
    "device_common_class": _over_runs(_common("device_id")),
    "rate_lookup": _over_runs(
        f"""select g.screen_name, g.platform, total, fail_count, rate, expected_pct,
          round(rate - expected_pct, 1) as gap
        from (select *, round(coalesce(expected, {DEFAULT_RATE}::double) * 100.0::double, 1) as expected_pct from (
            select screen_name, platform, count(*) as total, cast(sum(bad) as bigint) as fail_count, {RATE} as rate
            from runs group by screen_name, platform) c
          left join (values {RATES}) x(s, p, expected) on s = screen_name and p = platform) g"""
    ),
    **{name: _over_runs(sql, SESSIONS) for name, sql in REPORTS.items()},
    "load_counts": _over_runs(
        """select 0 as load, count(*) as processed,
          count(*) filter (where first_known and result <> 'passed') as classified,
          count(*) filter (where not first_known) as skipped, count(distinct run_date) as days
        from told where platform = 'android'
        union all select 1, count(*), count(*) filter (where first_new and result <> 'passed'),
          count(*) filter (where not first_new), count(distinct run_date) from told""",
        """told as (select *,
          platform = 'android' and row_number() over (partition by test_name, hour, platform = 'android' order by id) = 1 as first_known,
          row_number() over (partition by test_name, hour order by id) = 1
            and count(*) filter (where platform = 'android') over (partition by test_name, hour) = 0 as first_new
        from (select *, date_trunc('hour', run_at) as hour from runs) h)""",
    ),
    "seed_summary": _over_runs(
        """select count(*) as total, cast(sum(ok) as bigint) as passed, cast(sum(bad) as bigint) as failed,
        round(sum(ok) * 100.0::double / count(*), 1) as pass_pct from runs"""
    ),
    "rolling7": _over_runs(
        """select day, cast(t as bigint) as total, cast(f as bigint) as fail_count,
          round(f * 100.0::double / t, 1) as rate
        from (select day, sum(total) over w as t, sum(bad) over w as f
          from (select run_date as day, count(*) as total, sum(bad) as bad from runs group by run_date) d
          window w as (order by day range between interval 6 days preceding and current row)) s"""
    ),
    "recent60": _over_runs(
        f"""select * from (select run_date as day, {RATE} as rate from runs
        group by run_date order by day desc limit 60) d"""
    ),
    "last_actions_n": LAST_STEPS,
    "first_wins": _over_runs("select * from firsts", HOURLY),
    "topk_ratio": _over_runs(
        """select device_id, screen_name, count(*) as total, cast(sum(bad) as bigint) as fail_count from runs
        group by device_id, screen_name order by sum(bad)::double / count(*) desc, total desc,
          device_id nulls last, screen_name nulls last limit 20"""
    ),
    "topk_sessions": _over_runs(
        "select session_id, last_run from sessions_all order by last_run desc, session_id limit 20", SESSIONS
    ),
    "order_by_agg": _over_runs(
        """select test_name, count(*) as n_runs,
          cast(row_number() over (order by min(duration_ms), test_name) as integer) as place
        from runs group by test_name"""
    ),
    "dim_values": _over_runs(
        """select distinct 'screen_name' as dim, screen_name as value from runs where screen_name is not null
        union all select distinct 'run_date', cast(run_date as varchar) from runs where run_date is not null
        union all select distinct 'classification', classification from runs where classification is not null"""
    ),
    "union_sources": _over_runs(
        f"""select {DETOX} from runs where platform = 'ios'
        union all select {APPIUM} from runs where platform = 'android'
        union all select {PYTEST} from runs
          where (platform is null or platform not in ('ios', 'android')) and result <> 'skipped'"""
    ),
    "class_matrix": _over_runs(
        "select run_date as day, "
        + ", ".join(f"count(*) filter (where klass = '{c}') as {c}" for c in CLASSES)
        + ", count(*) filter (where klass = 'ENV_FLAKE') as OTHER"
        + f" from (select *, {SIXTH} as klass from runs) r"
        + " where result <> 'passed' and classification is not null group by run_date"
    ),
    "class_counts": _over_runs(
        f"""select day, string_agg(klass || '=' || cast(n as varchar), '|' order by klass) as counts
        from (select run_date as day, klass, count(*) as n from (select *, {SIXTH} as klass from runs) r
          where result <> 'passed' and classification is not null group by run_date, klass) k group by day"""
    ),
    "heat_matrix": _over_runs(
        f"""select screen, cast(count(*) as integer) as n_days,
          string_agg(coalesce(cast(rate as varchar), '-'), '|' order by day) as rates
        from (select distinct screen from ({REPORTS["heatmap"]}) s) s
          cross join (select distinct day from ({REPORTS["heatmap"]}) d) d
          left join ({REPORTS["heatmap"]}) h using (screen, day)
        group by screen"""
    ),
    "heat_rows": _over_runs(
        f"""select screen, string_agg(cast(day as varchar) || '=' || cast(rate as varchar), '|' order by day) as days,
        cast(round(sum(cast(round(rate * 10) as bigint)) / (count(*) * 10.0::double)) as bigint) as avg_rate
        from ({REPORTS["heatmap"]}) h group by screen"""
    ),
    "stream_last_actions": LAST_STEPS,
    "stream_ingest": _over_runs(
        f"""select test_name, run_at, run_date, platform, device_id, result, action_type,
          case when result <> 'passed' then {_rules()} end as classification
        from (select * replace (date_trunc('hour', run_at) as run_at), row_number() over (
            partition by test_name, date_trunc('hour', run_at) order by id) as n from runs) h where n = 1"""
    ),
    "classify_batch": _over_runs(
        MERGED,
        f"""replies as (select *, case when digest in ('0', '1', '2', '3') then 'REAL_BUG|digest ' || digest
          when digest in ('4', '5', '6', '7') then ' timeout_flake | digest ' || digest
          when digest in ('8', '9', 'a', 'b') then 'no idea ' || digest end as reply
        from (select *, case when result <> 'passed' then left(md5({_prompt()}), 1) end as digest from runs) m)""",
        PARSED,
    ),
}
