"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from driftlens.functions.times import DAY_MS, HOUR_MS

# The adapters of ``fixtures``. Times are floored to milliseconds.
LE = r"""
le AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms,
    CASE event_type WHEN 'click' THEN 'fswatch' WHEN 'view' THEN 'watchman' WHEN 'purchase' THEN 'entr'
      WHEN 'signup' THEN 'logstream' ELSE 'plugin:sample' END AS source,
    CASE WHEN event_id % 50 = 0 THEN 'info' WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS level,
    CASE WHEN event_id % 50 = 0 THEN concat('started (pid ', CAST(event_id AS VARCHAR), ')')
      WHEN event_id % 41 = 0 THEN 'heartbeat'
      WHEN event_id % 37 = 0 THEN ' changed'
      WHEN event_id % 31 = 0 THEN concat('log stream Output: /var/log//svc/../u', CAST(user_id % 7 AS VARCHAR), '/')
      ELSE concat('/var/', CASE user_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'tmp' WHEN 2 THEN 'cache' ELSE 'folders' END,
        '/u', CAST(user_id % 10 AS VARCHAR),
        '/k', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS VARCHAR), ' ',
        CASE event_id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Updated' WHEN 2 THEN 'Removed' ELSE 'Renamed' END, ' IsFile')
    END AS message
  FROM events),
a AS (SELECT max(ts_ms) AS now FROM le)
"""

SNAPS = r"""
snaps AS (
  SELECT CASE WHEN step = 6 THEN '' ELSE '/docs/' || CAST(doc_id // 10 AS VARCHAR) END AS path, doc_id * 8 + step AS version_id,
    (1704067200 + doc_id * 8 + step) * 1000 AS ts_ms, content
  FROM (
    SELECT doc_id, unnest(range(0, 7)) AS step, unnest([text, text, replace(text, chr(10), chr(13) || chr(10)),
      replace(text, 'the', 'THE') || chr(10) || 'added line', CASE WHEN doc_id % 7 = 3 THEN text || chr(0) END,
      CASE WHEN doc_id % 41 = 5 THEN repeat(replace(text, chr(10), ' '), 1048576 // greatest(length(text), 1) + 1) END,
      CASE WHEN doc_id % 11 = 4 THEN text || ' unnamed' END]) AS content
    FROM documents) WHERE content IS NOT NULL),
eligible AS (SELECT * FROM snaps WHERE path <> '' AND NOT contains(content, chr(0))),
clean AS (
  SELECT path, version_id, ts_ms, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM eligible),
pairs AS (
  SELECT * FROM (SELECT path, version_id, ts_ms, content AS new,
    lag(content) OVER (PARTITION BY path ORDER BY ts_ms, version_id) AS old FROM clean) WHERE old <> new)
"""
# The same with files of at most 1 MiB.
SMALL_SNAPS = SNAPS.replace("NOT contains(content, chr(0))", "NOT contains(content, chr(0)) AND strlen(content) <= 1048576")

RULES = """
rules(rule_no, rule_id, rule_name, pattern, src, lvl, min_events, window_ms, sound) AS (VALUES
  (0, 'burst', 'Created burst', 'Created', '', '', 5, 3600000, true),
  (1, 'err', 'error lines', '', '', 'stderr', 10, 7200000, false),
  (2, 'one', 'each start', 'started', '', '', 1, 60000, false),
  (3, 'lower', 'wrong case', 'created', '', '', 1, 60000, false),
  (4, 'src', 'entr only', '', 'entr', 'stdout', 3, 1800000, false)),
matched AS (
  SELECT r.*, le.id, le.ts_ms, le.message FROM le JOIN rules r
    ON (r.pattern = '' OR contains(le.message, r.pattern)) AND (r.src = '' OR le.source = r.src)
    AND (r.lvl = '' OR le.level = r.lvl) WHERE le.source <> 'alert')
"""

MANY_RULES = """
many(rule_id, pattern, src, lvl) AS (
  SELECT p, p, CASE WHEN change = 'Removed' THEN 'entr' ELSE '' END, '' FROM (
    SELECT '/' || top || '/u' || u.range || '/k' || k.range || ' ' || change AS p, change
    FROM (VALUES ('log'), ('tmp'), ('cache'), ('folders')) t(top), range(10) u, range(5) k,
      (VALUES ('Created'), ('Updated'), ('Removed'), ('Renamed')) c(change))
  UNION ALL VALUES ('k3', 'k3', '', 'stderr'), ('beat', 'heartbeat', '', ''))
"""

# A rule fires at a match that has min_events matches in its window, then again min_events matches on.
FIRED = RULES + """,
nth AS (
  SELECT *, row_number() OVER w AS i, lag(ts_ms, min_events - 1) OVER w AS first_ms
  FROM matched WINDOW w AS (PARTITION BY rule_id ORDER BY ts_ms, id)),
complete AS (SELECT * FROM nth WHERE first_ms >= ts_ms - window_ms),
fires(rule_id, i) AS (
  SELECT rule_id, min(i) FROM complete GROUP BY rule_id
  UNION ALL
  SELECT f.rule_id, min(c.i) FROM fires f JOIN complete c ON c.rule_id = f.rule_id AND c.i >= f.i + c.min_events
  GROUP BY f.rule_id),
fired AS (
  SELECT c.rule_id AS id, rule_name AS name, CAST(min_events AS INTEGER) AS count, ts_ms AS fired_ms, message AS last,
    id AS event_id, sound, rule_no,
    'alert: ' || rule_name || ' (' || CAST(min_events AS VARCHAR) || ' events) — ' || message AS alert
  FROM complete c JOIN fires f ON c.rule_id = f.rule_id AND c.i = f.i)
"""

PATHS = r"""
found AS (SELECT *, regexp_extract(message, '(?:^|\s)(/\S*)', 1) AS raw FROM le),
-- The adapter's only unclean paths.
pathed AS (SELECT *, rtrim(replace(raw, '//svc/../', '/'), '/') AS path FROM found WHERE raw <> '')
"""


def _nodes(rows: str = "pathed") -> str:
    return PATHS + f""",
steps AS (
  SELECT array_to_string(string_split(path, '/')[1:n], '/') AS node FROM
    (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM {rows})
  UNION ALL SELECT '/' FROM {rows}),
nodes AS (
  SELECT node AS path, CASE WHEN node = '/' THEN NULL WHEN regexp_extract(node, '^(.*)/[^/]*$', 1) = '' THEN '/'
      ELSE regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent,
    CASE WHEN node = '/' THEN '/' ELSE regexp_extract(node, '[^/]*$') END AS name,
    CAST(CASE WHEN node = '/' THEN 0 ELSE len(string_split(node, '/')) - 1 END AS INTEGER) AS depth,
    count(*) AS count
  FROM steps GROUP BY node)
"""


ROWS = "id, ts_ms, source, level, message"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NOCASE = FOLD.format("message")
CLOCK = "strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S')"
RFC3339 = (
    "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_ms % 1000 = 0 THEN '' "
    "ELSE '.' || rtrim(lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0'), '0') END || 'Z'"
)
TOKEN = "CASE WHEN instr(message, ' ') > 0 THEN substr(message, 1, instr(message, ' ') - 1) ELSE '' END"
LABELS = "['日', '月', '火', '水', '木', '金', '土']"
WEEKDAY = "((({0}) // 24 + 4) % 7)"


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _log(select: str, *more: str) -> str:
    return _sql(",".join([LE, *more]), select)


def _since(hours: int) -> str:
    return f"ts_ms >= now - {hours} * {HOUR_MS}"


def _hourly(hours: int, where: str = "true", whole: bool = False) -> str:
    last = f"now // {HOUR_MS} + 1" if whole else f"(now - {hours} * {HOUR_MS}) // {HOUR_MS} + 24"
    return f"""SELECT hour, lpad(CAST(hour % 24 AS VARCHAR), 2, '0') || ':00' AS label, coalesce(n, 0) AS count
FROM (SELECT unnest(range((now - {hours} * {HOUR_MS}) // {HOUR_MS}, {last})) AS hour FROM a)
LEFT JOIN (SELECT ts_ms // {HOUR_MS} AS hour, count(*) AS n FROM le, a WHERE {_since(hours)} AND {where} GROUP BY ALL) USING (hour)"""


def _weekday(hours: int) -> str:
    return f"""SELECT CAST(weekday AS INTEGER) AS weekday, {LABELS}[weekday + 1] AS label, coalesce(n, 0) AS count
FROM (SELECT unnest(range(0, 7)) AS weekday)
LEFT JOIN (SELECT {WEEKDAY.format(f'ts_ms // {HOUR_MS}')} AS weekday, count(*) AS n FROM le, a WHERE {_since(hours)} GROUP BY ALL)
USING (weekday)"""


def _by_source(hours: int) -> str:
    return f"SELECT source, count(*) AS count FROM le, a WHERE {_since(hours)} GROUP BY source"


def _top_paths(hours: int) -> str:
    return (
        f"SELECT {TOKEN} AS path, count(*) AS count FROM le, a WHERE {_since(hours)} AND message <> '' "
        "GROUP BY ALL ORDER BY count DESC, path LIMIT 10"
    )


def _taken(window_ms: int) -> str:
    return f"""firsts AS (SELECT level, message, ts_ms, min(id) AS id FROM le GROUP BY ALL),
taken(level, message, ts_ms) AS (
  SELECT level, message, min(ts_ms) FROM firsts GROUP BY ALL
  UNION ALL
  SELECT t.level, t.message, min(f.ts_ms) FROM taken t JOIN firsts f
    ON f.level = t.level AND f.message = t.message AND f.ts_ms >= t.ts_ms + {window_ms} GROUP BY ALL)"""


_KEPT = f"SELECT le.{ROWS.replace(', ', ', le.')} FROM taken t JOIN firsts f USING (level, message, ts_ms) JOIN le ON le.id = f.id"


def _dedup(window_ms: int) -> str:
    return _log(_KEPT, _taken(window_ms))


# Longest common subsequence lengths, one old line per recursion step.
LCS = """,
lined AS (
  SELECT path, version_id, ts_ms,
    CASE WHEN old[-1:] = chr(10) THEN string_split(old, chr(10))[:-2] ELSE string_split(old, chr(10)) END AS x,
    CASE WHEN new[-1:] = chr(10) THEN string_split(new, chr(10))[:-2] ELSE string_split(new, chr(10)) END AS y
  FROM pairs),
lcs(version_id, i, best) AS (
  SELECT version_id, 0, list_transform(y, lambda v: 0) FROM lined
  UNION ALL
  SELECT version_id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT l.version_id, l.i,
      list_transform(range(1, len(y) + 1), lambda j: CASE WHEN y[j] = x[l.i + 1]
        THEN CASE WHEN j = 1 THEN 0 ELSE l.best[j - 1] END + 1 ELSE l.best[j] END) AS c
    FROM lcs l JOIN lined USING (version_id) WHERE l.i < len(x))),
counted AS (
  SELECT path, version_id, ts_ms, CAST(len(y) - best[-1] AS INTEGER) AS added, CAST(len(x) - best[-1] AS INTEGER) AS removed
  FROM lined JOIN lcs USING (version_id) WHERE i = len(x))
"""

# The same lengths from the ends of both texts, and a walk from their starts: the old side goes first where both ways
# are as long. Between two common lines the removed ones stand before the added ones.
WALK = LCS + """,
ends AS (SELECT version_id, list_reverse(x) AS x, list_reverse(y) AS y FROM lined),
back(version_id, i, best) AS (
  SELECT version_id, 0, list_transform(y, lambda v: 0) FROM ends
  UNION ALL
  SELECT version_id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT l.version_id, l.i,
      list_transform(range(1, len(y) + 1), lambda j: CASE WHEN y[j] = x[l.i + 1]
        THEN CASE WHEN j = 1 THEN 0 ELSE l.best[j - 1] END + 1 ELSE l.best[j] END) AS c
    FROM back l JOIN ends USING (version_id) WHERE l.i < len(x))),
walk(version_id, i, j, seg, kind, line_no, line) AS (
  SELECT version_id, 0, 0, 0, '', 0, '' FROM lined
  UNION ALL
  SELECT version_id, i + (kind <> 'added')::INT, j + (kind <> 'removed')::INT, seg + (kind = 'context')::INT, kind,
    CASE WHEN kind = 'removed' THEN i + 1 ELSE j + 1 END, CASE WHEN kind = 'removed' THEN x[i + 1] ELSE y[j + 1] END
  FROM (
    SELECT w.version_id, w.i, w.j, w.seg, l.x, l.y,
      CASE WHEN w.i < len(l.x) AND w.j < len(l.y) AND l.x[w.i + 1] = l.y[w.j + 1] THEN 'context'
        WHEN w.j = len(l.y) OR (w.i < len(l.x) AND
          coalesce(d.best[len(l.y) - w.j], 0) >= CASE WHEN len(l.y) - w.j - 1 = 0 THEN 0 ELSE s.best[len(l.y) - w.j - 1] END) THEN 'removed'
        ELSE 'added' END AS kind
    FROM walk w JOIN lined l USING (version_id)
      LEFT JOIN back s ON s.version_id = w.version_id AND s.i = len(l.x) - w.i
      LEFT JOIN back d ON d.version_id = w.version_id AND d.i = len(l.x) - w.i - 1
    WHERE w.i < len(l.x) OR w.j < len(l.y))),
steps AS (
  SELECT *, CASE kind WHEN 'context' THEN seg - 1 ELSE seg END AS block,
    CASE kind WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE 2 END AS turn FROM walk WHERE kind <> '')
"""

_FIRED_ROWS = "SELECT id, name, count, fired_ms, last, event_id, sound FROM fired"
_WHERE = {
    "filter_since": f"ts_ms >= now - 3 * {DAY_MS}",
    "filter_until": f"ts_ms <= now - 20 * {DAY_MS}",
    "filter_source": "source = 'entr'",
    "filter_keyword": f"contains({NOCASE}, 'created')",
    "filter_search": f"ts_ms BETWEEN now - 10 * {DAY_MS} AND now - {DAY_MS} AND source = 'fswatch' AND contains({NOCASE}, '/var/log')",
    "filter_parsed_query": (
        "ts_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-10 10:00:00') AND epoch_ms(TIMESTAMP '2024-01-20 00:00:00') "
        f"AND contains({NOCASE}, 'is')"
    ),
    "filter_live": f"contains(lower({CLOCK} || ' ' || source || ' ' || message), ':15 fswatch')",
    "filter_multi_field": "contains(lower(message), 'entr') OR contains(source, 'entr')",
    "filter_has_message": "message <> ''",
    "filter_has_path": r"regexp_matches(message, '(?:^|\s)/\S*')",
    "prune_kept": f"ts_ms >= now - 7 * {DAY_MS}",
}


def _preset(target: str, sources: str) -> str:
    return _log(
        f"""SELECT {ROWS} FROM le LEFT JOIN (SELECT id, path FROM pathed) USING (id)
WHERE source = 'plugin:sample' OR (source IN ({sources}) AND CASE WHEN source = 'logstream' THEN contains(message, '{target}')
  ELSE coalesce(path = '{target}' OR starts_with(path, '{target}/'), false) END)""",
        PATHS,
    )


def _rate(step: int) -> str:
    return f"""SELECT slot * {step} AS ts_ms, coalesce(n, 0) AS events, round(coalesce(n, 0) * 1000.0::DOUBLE / {step}, 9) AS events_sec
FROM (SELECT unnest(range(min(ts_ms) // {step}, max(ts_ms) // {step} + 1)) AS slot FROM le)
LEFT JOIN (SELECT ts_ms // {step} AS slot, count(*) AS n FROM le GROUP BY ALL) USING (slot)"""


def _samples(step: int) -> str:
    return f"""SELECT ts_ms, events, max(events) OVER () AS max_events FROM (SELECT * FROM ({_rate(step)}) ORDER BY ts_ms DESC LIMIT 60)"""


_STORED = "SELECT source, level, message, count(*) AS rows, CAST(1 AS BIGINT) AS most_per_id FROM {0} GROUP BY ALL"


def _dashboard(hours: int, whole: bool = False) -> str:
    return _log(
        f"""SELECT 'total' AS part, CAST(0 AS INTEGER) AS pos, 'all' AS label, count(*) AS count FROM le, a WHERE {_since(hours)}
UNION ALL SELECT 'hourly', CAST(row_number() OVER (ORDER BY hour) - 1 AS INTEGER), label, count FROM ({_hourly(hours, whole=whole)})
UNION ALL SELECT 'weekly', weekday, label, count FROM ({_weekday(hours)})
UNION ALL SELECT 'by_source', CAST(row_number() OVER (ORDER BY count DESC, source) - 1 AS INTEGER), source, count FROM ({_by_source(hours)})
UNION ALL SELECT 'top_paths', CAST(row_number() OVER (ORDER BY count DESC, path) - 1 AS INTEGER), path, count FROM ({_top_paths(hours)})"""
    )


ORACLES: dict[str, str] = {
    "live_text_sources": _log("SELECT source, 'stdout' AS level, message, count(*) AS events FROM le WHERE source IN ('fswatch', 'entr') GROUP BY source, message"),
    "snapshot_folder": """SELECT doc_id % 20 AS part, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS md5
FROM documents GROUP BY doc_id % 20""",
    **{name: _log(f"SELECT {ROWS} FROM le, a WHERE {where}") for name, where in _WHERE.items()},
    "append_and_read_logs": _log(
        "SELECT row_number() OVER (ORDER BY ts_ms, id) AS id, ts_ms, source, level, message FROM le"
    ),
    "append_two_writers": _log(_STORED.format("le")),
    "append_after_restart": _log(_STORED.format("le")),
    "compact_stored_table": _log(_STORED.format("le")),
    "append_after_prune": _log(_STORED.format(f"(SELECT * FROM le UNION ALL SELECT le.* FROM le, a WHERE ts_ms >= now - {DAY_MS})")),
    "read_log_lines": _log("SELECT 'entr' AS source, 'stderr' AS level, message FROM le WHERE id % 7 <> 0"),
    "union_sources": _log("SELECT ts_ms, source, level, message FROM le"),
    "prune_deleted": _log(f"SELECT count(*) AS deleted FROM le, a WHERE ts_ms < now - 7 * {DAY_MS}"),
    "prune_stored_table": _log(
        "SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS rows FROM le, a "
        f"WHERE ts_ms >= now - 7 * {DAY_MS} GROUP BY ALL"
    ),
    "export_csv": _log(
        f"""SELECT 'ts,source,level,message' AS line UNION ALL
SELECT {RFC3339} || ',' || source || ',' || level || ',' || CASE WHEN regexp_matches(message, '[,"\\r\\n]|^\\s')
  THEN '"' || replace(message, '"', '""') || '"' ELSE message END FROM le WHERE contains({NOCASE}, 'c')"""
    ),
    "export_json": _log(f"SELECT id, {RFC3339} AS ts, source, level, message FROM le WHERE source = 'watchman'"),
    "read_snapshots": _sql(SNAPS, "SELECT path, version_id, strlen(content) AS size FROM snaps"),
    "fan_out": _log("SELECT source, count(*) AS stored, count(*) AS counted FROM le GROUP BY source"),
    "preset_logs": _preset("/var/log", "'fswatch', 'logstream'"),
    "preset_temp": _preset("/var/tmp", "'fswatch'"),
    "filter_not_alert": _log("SELECT source, count(*) AS events FROM le GROUP BY source"),
    "path_drilldown": _log(
        f"SELECT {ROWS} FROM le WHERE contains({NOCASE}, '/var/log/u4') ORDER BY ts_ms DESC, id DESC LIMIT 200"
    ),
    "extract_path": _log("SELECT le.id, coalesce(path, '') AS path FROM le LEFT JOIN pathed ON le.id = pathed.id", PATHS),
    "clean_path": _log("SELECT id, '/' || source || '/x/' || CAST(id % 9 AS VARCHAR) AS path FROM le"),
    "path_prefixes": _log(
        """SELECT id, array_to_string(string_split(path, '/')[1:n], '/') AS prefix
FROM (SELECT id, path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM pathed)""",
        PATHS,
    ),
    "leading_token": _log(f"SELECT id, {TOKEN} AS token FROM le"),
    "escape_like": _log(
        r"SELECT id, replace(replace(replace(source || '_100%\' || message, '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM le"
    ),
    "dedup_keys": _log("SELECT level, message, count(*) AS events FROM le GROUP BY ALL"),
    "time_parts": _log(
        f"""SELECT id, ts_ms // {HOUR_MS} AS hour, CAST(dayofweek(make_timestamp(ts_ms * 1000)) AS INTEGER) AS weekday,
  {LABELS}[dayofweek(make_timestamp(ts_ms * 1000)) + 1] AS weekday_label,
  strftime(make_timestamp(ts_ms * 1000), '%H:00') AS hour_label,
  strftime(make_timestamp((ts_ms + 9 * {HOUR_MS}) * 1000), '%H:00') AS hour_label_tokyo, {RFC3339} AS rfc3339 FROM le"""
    ),
    "snapshot_lines": _sql(
        SNAPS,
        """SELECT version_id, CAST(len(lines) AS BIGINT) AS lines, CAST(len(lines) AS BIGINT) AS counted,
  CAST(length(array_to_string(lines, '')) AS BIGINT) AS chars
FROM (SELECT version_id, CASE WHEN content[-1:] = chr(10) THEN string_split(content, chr(10))[:-2]
  ELSE string_split(content, chr(10)) END AS lines FROM (SELECT * REPLACE (replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content) FROM snaps))""",
    ),
    "alert_messages": _log("SELECT event_id, id, alert AS message FROM fired", FIRED),
    "bar_widths": _log(
        "SELECT source, count, CAST(greatest(2, round(count * 100.0 / max(count) OVER ())) AS INTEGER) AS pct "
        f"FROM ({_by_source(168)})"
    ),
    "render_lines": _log(f"SELECT id, {CLOCK} || ' ' || source || ' ' || message AS line FROM le"),
    "search_logs": _log(
        f"SELECT {ROWS} FROM le, a WHERE ts_ms >= now - 14 * {DAY_MS} AND source = 'fswatch' "
        f"AND contains({NOCASE}, 'created') ORDER BY ts_ms DESC, id DESC LIMIT 200"
    ),
    "search_logs_wide": _log(f"SELECT {ROWS} FROM le ORDER BY ts_ms DESC, id DESC LIMIT 9999"),
    "render_lines_cut": _log(f"SELECT id, {CLOCK} || ' ' || source || ' ' || substr(message, 1, 12) AS line FROM le"),
    "alert_count_all": _log("SELECT count(*) AS alerts FROM fired", FIRED),
    "alert_history_all": _log("SELECT id, name, count, fired_ms, last, event_id FROM fired", FIRED),
    "diff_history_all": _sql(SNAPS, "SELECT path, version_id, ts_ms FROM pairs"),
    "eligible_small_snapshots": _sql(SMALL_SNAPS, "SELECT path, version_id FROM eligible"),
    "file_diffs_small": _sql(
        SMALL_SNAPS + LCS,
        "SELECT path, version_id, CASE WHEN len(x) * len(y) > 200 THEN 0 ELSE added END AS added, "
        "CASE WHEN len(x) * len(y) > 200 THEN 0 ELSE removed END AS removed FROM counted JOIN lined USING (path, version_id)",
    ),
    "diff_lines": _sql(
        SNAPS + WALK,
        """SELECT l.path, s.version_id, CAST(row_number() OVER (PARTITION BY s.version_id ORDER BY block, turn, line_no) - 1 AS INTEGER) AS position,
  kind, line, CAST(line_no AS INTEGER) AS line_no FROM steps s JOIN lined l USING (version_id)""",
    ),
    "search_logs_max": _log(f"SELECT {ROWS} FROM le ORDER BY ts_ms DESC, id DESC LIMIT 5000"),
    "export_order": _log(f"SELECT {ROWS} FROM le WHERE source = 'logstream' ORDER BY ts_ms, id"),
    "tail": _log(
        f"SELECT id, {CLOCK} || ' ' || source || ' ' || message AS line FROM le ORDER BY ts_ms DESC, id DESC LIMIT 500"
    ),
    "oldest_events": _log(f"SELECT {ROWS} FROM le ORDER BY ts_ms, id LIMIT 3000"),
    "top_paths": _log(_top_paths(168)),
    "alert_history": _log(
        "SELECT id, name, count, fired_ms, last, event_id FROM fired "
        "ORDER BY fired_ms DESC, event_id DESC, rule_no DESC LIMIT 100",
        FIRED,
    ),
    "diff_history": _sql(SNAPS, "SELECT path, version_id, ts_ms FROM pairs ORDER BY ts_ms DESC, version_id DESC LIMIT 20"),
    "sibling_order": _log(
        """SELECT path, parent, count, row_number() OVER (PARTITION BY parent ORDER BY count DESC, name) AS sibling_rank
FROM nodes""",
        _nodes(),
    ),
    "total": _log(f"SELECT count(*) AS total FROM le, a WHERE {_since(24)}"),
    "hourly": _log(_hourly(24)),
    "hourly_long_window": _log(_hourly(168)),
    "weekday_counts": _log(_weekday(60)),
    "by_source": _log(_by_source(168)),
    "dashboard": _dashboard(24),
    "dashboard_whole_window": _dashboard(60, True),
    "hourly_whole_window": _log(_hourly(168, whole=True)),
    "path_rollup": _log("SELECT path, parent, name, depth, count FROM nodes", _nodes()),
    "path_rollup_limited": _log(
        "SELECT path, parent, name, depth, count FROM nodes",
        _nodes("capped").replace(
            ",\nsteps",
            f""",
oldest AS (SELECT le.id FROM le, a WHERE {_since(168)} AND message <> '' ORDER BY ts_ms, id LIMIT 500),
capped AS (SELECT * FROM pathed WHERE id IN (SELECT id FROM oldest)),
steps""",
            1,
        ),
    ),
    "flatten_tree": _log(
        """SELECT path, name AS label, count, depth, path IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) AS has_children FROM nodes
WHERE depth > 0 AND NOT starts_with(path, '/var/log/') AND NOT starts_with(path, '/var/tmp/u1/')""",
        _nodes(),
    ),
    "path_tree_json": _log(
        """SELECT string_agg(piece, '' ORDER BY key) AS tree FROM (
  SELECT key, '{"name":"' || name || '","path":"' || path || '","count":' || CAST(count AS VARCHAR) ||
    CASE WHEN following > depth THEN ',"children":[' ELSE '}' || repeat(']}', CAST(depth - following AS BIGINT)) ||
      CASE WHEN following > 0 THEN ',' ELSE '' END END AS piece
  FROM (SELECT *, lead(depth, 1, 0) OVER (ORDER BY key) AS following FROM walk))""",
        _nodes("recently").replace(
            ",\nsteps", f", recently AS (SELECT pathed.* FROM pathed, a WHERE {_since(168)}),\nsteps", 1
        ),
        """walk(path, name, depth, count, key) AS (
  SELECT path, name, depth, count, CAST([] AS STRUCT(o BIGINT, n VARCHAR)[]) FROM nodes WHERE path = '/'
  UNION ALL
  SELECT n.path, n.name, n.depth, n.count, list_append(w.key, {'o': -n.count, 'n': n.name})
  FROM walk w JOIN nodes n ON n.parent = w.path)""",
    ),
    "heatmap": _log(
        """SELECT path, count, 200.0::DOUBLE - (count / top) * 100 AS hue, 50.0::DOUBLE - (count / top) * 20 AS lightness
FROM nodes, (SELECT max(count) AS top FROM nodes)""",
        _nodes(),
    ),
    "event_rate": _log(
        f"""SELECT ts_ms // {HOUR_MS} AS hour, count(*) AS seconds, count(*) FILTER (WHERE events = 0) AS idle,
  CAST(sum(events) AS BIGINT) AS events, max(events_sec) AS peak, min(ts_ms) AS first_ms FROM ({_rate(1000)}) GROUP BY ALL"""
    ),
    "event_rate_hourly": _log(_rate(HOUR_MS)),
    "rate_samples": _log(_samples(1000)),
    "rate_samples_hourly": _log(_samples(HOUR_MS)),
    "threshold_latch": """SELECT coalesce(bool_or(value >= 200), false) AS warned,
  min(epoch_us(ts) // 1000) FILTER (WHERE value >= 200) AS first_ms, CAST(200 AS INTEGER) AS threshold FROM events""",
    "alert_count": _log("SELECT least(count(*), 100) AS alerts FROM fired", FIRED),
    "source_overview": _log("SELECT source, count(*) AS events, max(ts_ms) AS last_ms FROM le GROUP BY source"),
    "match_rules": _log("SELECT rule_id, id FROM matched", RULES),
    "match_many_rules": _log(
        """SELECT rule_id, count(*) AS events, max(id) AS last_id FROM le JOIN many ON contains(message, pattern)
AND (src = '' OR source = src) AND (lvl = '' OR level = lvl) GROUP BY rule_id""",
        MANY_RULES,
    ),
    "zero_fill": _log(_hourly(24, "source = 'entr'")),
    "link_children": _log("SELECT path, coalesce(path IN (SELECT parent FROM nodes WHERE parent IS NOT NULL), false) AS has_children FROM nodes", _nodes()),
    "hide_collapsed": _log(
        """SELECT path, count FROM nodes n WHERE NOT EXISTS
  (SELECT 1 FROM nodes c WHERE c.depth = 3 AND c.count > 300 AND starts_with(n.path, c.path || '/'))""",
        _nodes(),
    ),
    "previous_snapshot": _sql(
        SNAPS,
        """SELECT path, version_id, lag(strlen(content)) OVER (PARTITION BY path ORDER BY ts_ms, version_id) AS prev_bytes
FROM eligible""",
    ),
    "runs_of_activity": _log(
        """SELECT level, min(ts_ms) AS run_start, count(*) AS moments FROM
  (SELECT level, ts_ms, count(*) FILTER (WHERE fresh) OVER (PARTITION BY level ORDER BY ts_ms) AS run FROM
    (SELECT level, ts_ms, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY level ORDER BY ts_ms) >= 3600000, true) AS fresh
     FROM (SELECT DISTINCT level, ts_ms FROM le)))
GROUP BY level, run"""
    ),
    "dedup_day": _dedup(DAY_MS),
    "dedup_hour": _dedup(HOUR_MS),
    "fire_alerts": _log(_FIRED_ROWS, FIRED),
    "alert_feedback": _log(
        """SELECT ts_ms, source, level, message FROM le
UNION ALL SELECT fired_ms, 'alert', 'warn', alert FROM fired""",
        FIRED,
    ),
    "dedup_stream": _dedup(DAY_MS),
    "ingest_with_feedback": _log(
        """SELECT ts_ms, source, level, message FROM kept
UNION ALL SELECT fired_ms, 'alert', 'warn', alert FROM fired""",
        _taken(DAY_MS),
        f"kept AS ({_KEPT})",
        FIRED.replace("FROM le JOIN rules", "FROM kept le JOIN rules"),
    ),
    "fire_alerts_stream": _log(_FIRED_ROWS, FIRED),
    "rate_stream": _log(
        f"""SELECT ts_ms // {HOUR_MS} AS hour, count(*) AS seconds, count(*) FILTER (WHERE events = 0) AS idle,
  CAST(sum(events) AS BIGINT) AS events, max(events_sec) AS peak, min(ts_ms) AS first_ms
FROM ({_rate(1000)}) WHERE ts_ms <= (SELECT max(ts_ms) // 1000 * 1000 FROM le, a WHERE (ts_ms // 1000 + 1) * 1000 <= now - {HOUR_MS}) GROUP BY ALL"""
    ),
    "live_tail": _log(
        f"""SELECT '{{"ts":"' || {RFC3339} || '","source":"' || source || '","level":"' || level || '","message":"' || message || '"}}' AS value
FROM le"""
    ),
    "diff_stream": _sql(SNAPS + LCS, "SELECT path, version_id, ts_ms, added, removed FROM counted"),
    "on_fire": _log("SELECT id, event_id, count FROM fired WHERE sound", FIRED),
    "eligible_snapshots": _sql(SNAPS, "SELECT path, version_id FROM eligible"),
    "changed_pairs": _sql(SNAPS, "SELECT path, version_id, length(old) AS old_chars, length(new) AS new_chars FROM pairs"),
    "file_diffs": _sql(SNAPS + LCS, "SELECT path, version_id, added, removed FROM counted"),
    "diff_rebuild": _sql(
        SNAPS,
        """SELECT version_id, md5(rtrim(old, chr(10))) AS old_md5, md5(rtrim(new, chr(10))) AS new_md5 FROM pairs""",
    ),
    "recent_diffs": _sql(
        SNAPS + LCS,
        "SELECT path, version_id, added, removed FROM counted ORDER BY ts_ms DESC, version_id DESC LIMIT 20",
    ),
}
