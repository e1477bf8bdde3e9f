"""The checks' reference results: plain DuckDB SQL over the given tables.

Every statement is a chain of named subqueries.  ``SUBQUERIES`` lists them in
order of dependency; ``statement`` adds those that a final select needs.
"""

from __future__ import annotations

import re

from veilcheck import fixed_values as fv
from veilcheck.operators import advice
from veilcheck.operators.rules import RuleSet, ru_names, rules

from . import views

SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_list(items) -> str:
    return "[" + ", ".join(map(text_literal, items)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def name_of(path: str) -> str:
    return f"string_split(rtrim({path}, '/'), '/')[-1]"


def suffix_of(path: str) -> str:
    return rf"lower(regexp_extract({name_of(path)}, '(?s)^.+(\.[^.]+)$', 1))"


def ext_of(path: str) -> str:
    return (
        f"CASE WHEN {suffix_of(path)} = '' AND {name_of(path)} LIKE '.%' THEN lower({name_of(path)}) "
        f"ELSE {suffix_of(path)} END"
    )


def skipped(path: str, mode: str, dirs=(), extensions=()) -> str:
    parts = f"string_split({path}, '/')"
    tested = parts if mode == "parts" else f"list_slice({parts}, 1, len({parts}) - 1)"
    return (
        f"(list_has_any({tested}, {text_list([*fv.SKIP_DIRS, *dirs])}) "
        f"OR list_contains({text_list([*fv.SKIP_EXTENSIONS, *extensions])}, {suffix_of(path)}))"
    )


def lines_of(content: str) -> str:
    parts = f"string_split_regex({content}, '{LINE_ENDS}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END)"


def exploded(columns: str, source: str, content: str = "content") -> str:
    return (
        f"SELECT {columns}, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_number, unnest(ls) AS line "
        f"FROM (SELECT *, {lines_of(content)} AS ls FROM {source})"
    )


def matchable(line: str) -> str:
    return rf"NOT regexp_matches({line}, '^{SPACE}*($|#|//)')"


def matches(rule_set: RuleSet, lines: str, key: str = "file_id") -> str:
    """Every match of every rule: one constant regex per rule."""
    return " UNION ALL ".join(
        f"SELECT {key}, line_number, {i} AS rule_ord, {text_literal(r.name)} AS secret_type, "
        f"{r.score} AS base_score, {text_literal(r.category)} AS category, "
        f"CAST(generate_subscripts(ms, 1) AS INTEGER) AS match_ord, unnest(ms) AS value "
        f"FROM (SELECT {key}, line_number, regexp_extract_all(line, {text_literal(r.regex)}, {r.group}) AS ms "
        f"FROM {lines})"
        for i, r in enumerate(rule_set)
    )


def is_false_positive(v: str, extra=()) -> str:
    pattern = "|".join(f"(?:{p})" for p in [*fv.PLACEHOLDER_PATTERNS, *extra])
    return f"(regexp_matches({v}, {text_literal('(?i)' + pattern)}) OR len(list_distinct(string_split({v}, ''))) < 4)"


def entropy(v: str) -> str:
    return (
        f"(CASE WHEN {v} = '' THEN 0.0 ELSE -list_sum(list_transform(map_values("
        f"list_histogram(string_split({v}, ''))), lambda f: (f / len(string_split({v}, ''))) "
        f"* log2(f / len(string_split({v}, ''))))) END)"
    )


def round2(x: str) -> str:
    return f"(CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN round_even({x}, 2) ELSE round({x}, 2) END)"


def is_hash(v: str) -> str:
    return f"regexp_matches({strip(v)}, '(?i)^([a-f0-9]{{32}}|[a-f0-9]{{40}}|[a-f0-9]{{64}})$')"


def structure(t: str, v: str) -> str:
    return f"""(CASE WHEN {t} = 'JWT Token' THEN len(string_split({v}, '.')) = 3 AND NOT list_contains(string_split({v}, '.'), '')
      WHEN {t} = 'AWS Access Key' THEN regexp_matches({v}, '^AKIA[0-9A-Z]{{16}}$')
      WHEN {t} = 'Yandex Cloud Service Account Key' THEN regexp_matches({v}, '^AQ[A-Za-z0-9_-]{{38,}}$')
      WHEN {t} = 'Private Key' THEN contains({v}, 'BEGIN') AND (contains({v}, 'PRIVATE KEY') OR contains({v}, 'RSA'))
      WHEN contains({t}, 'UUID') OR contains({t}, 'HubSpot') OR contains({t}, 'Ozon Client ID')
        THEN regexp_matches({v}, '(?i)^[a-f0-9-]{{36}}$')
      WHEN {t} = 'Connection String' THEN contains({v}, '://') AND contains({v}, '@')
      ELSE false END)"""


def severity(s: str, critical=12, high=8, medium=5) -> str:
    return (
        f"(CASE WHEN {s} >= {critical} THEN 'CRITICAL' WHEN {s} >= {high} THEN 'HIGH' "
        f"WHEN {s} >= {medium} THEN 'MEDIUM' ELSE 'LOW' END)"
    )


def rank(level: str) -> str:
    return f"(CASE {level} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END)"


def confidence(score: str, entropy2: str, structural: str, tainted: str) -> str:
    raw = (
        f"least(least(0.99::DOUBLE, 0.15::DOUBLE + {score} / 16.0::DOUBLE) "
        f"+ CASE WHEN {entropy2} > 4.5 THEN 0.1::DOUBLE ELSE 0 END "
        f"+ CASE WHEN {structural} THEN 0.15::DOUBLE ELSE 0 END "
        f"+ CASE WHEN {tainted} THEN 0.15::DOUBLE ELSE 0 END, 0.99::DOUBLE)"
    )
    return round2(raw)


def sink(line: str) -> str:
    return "(CASE " + " ".join(
        f"WHEN regexp_matches({line}, {text_literal(p)}) THEN {text_literal(s)}" for p, s in fv.SINKS
    ) + " END)"


VARIABLE = r"^\s*([A-Z_a-z][A-Z_a-z0-9]*)\s*="
RISKY = "(?i)" + "|".join(f"(?:{p})" for p in fv.RISK_MARKERS)


def _scored(source: str, extra_ignore=()) -> str:
    return f"""
SELECT *, base_score - CASE WHEN {is_hash('value')} THEN 3 ELSE 0 END
    + CASE WHEN raw_entropy > 4.5 THEN 3 WHEN raw_entropy > 3.5 THEN 1 ELSE 0 END
    + CASE WHEN context_match THEN 2 ELSE 0 END
    + CASE WHEN list_contains({text_list(fv.CONFIG_EXTENSIONS)}, ext) THEN 2 ELSE 0 END
    + CASE WHEN ext = '.env' THEN 1 ELSE 0 END
    + CASE WHEN structural_valid THEN 3 ELSE 0 END AS score
FROM (SELECT m.*, l.path, l.ext, l.line, l.context_match, {entropy('m.value')} AS raw_entropy,
        {structure('m.secret_type', 'm.value')} AS structural_valid
      FROM {source} m JOIN lines l USING (file_id, line_number)
      WHERE NOT {is_false_positive('m.value', extra_ignore)})"""


def _findings(hits: str, attached: str, thresholds=(12, 8, 5)) -> str:
    return f"""
SELECT file_id, path AS file, line_number, {rstrip('line')} AS line_content, secret_type,
  CASE WHEN length(value) > 80 THEN substr(value, 1, 80) || '...' ELSE value END AS matched_value,
  CAST(final AS INTEGER) AS score, {severity('final', *thresholds)} AS severity, category,
  CASE WHEN starts_with(path, 'history/') THEN 'history' ELSE 'current' END AS source,
  entropy, context_match, structural_valid,
  {confidence('final', 'entropy', 'structural_valid', 'traces > 0')} AS confidence,
  CAST(traces AS INTEGER) AS trace_count, rule_ord, match_ord
FROM (SELECT h.*, coalesce(a.n, 0) AS traces, score + CASE WHEN coalesce(a.n, 0) > 0 THEN 2 ELSE 0 END AS final,
        {round2('raw_entropy')} AS entropy
      FROM {hits} h LEFT JOIN {attached} a USING (file_id, line_number))"""


def _flow(prefix: str, hits: str) -> dict[str, str]:
    """Secret variables, their spread and the calls they reach, from a table of hits."""
    p = prefix
    return {
        f"{p}secrets": rf"""
SELECT file_id, path, line_number AS src, rule_ord, match_ord, regexp_extract(line, '{VARIABLE}', 1) AS var
FROM {hits} WHERE regexp_matches(line, '{VARIABLE}') AND list_contains({text_list(fv.FLOW_EXTENSIONS)}, ext)""",
        f"{p}spread": f"""
SELECT DISTINCT file_id, var, src, var AS name, 0 AS since FROM {p}secrets
UNION
SELECT t.file_id, t.var, t.src, a.lhs, a.line_number
FROM {p}spread t JOIN assigns a ON a.file_id = t.file_id AND a.line_number > t.since
  AND a.line_number <> t.src AND list_contains(a.words, t.name)""",
        f"{p}tainted": f"SELECT file_id, var, src, name, min(since) AS since FROM {p}spread GROUP BY ALL",
        f"{p}steps": f"""
SELECT DISTINCT t.file_id, t.var, t.src, a.line_number, a.lhs, a.line
FROM {p}tainted t JOIN assigns a ON a.file_id = t.file_id AND a.line_number > t.since
  AND a.line_number <> t.src AND list_contains(a.words, t.name)""",
        f"{p}traces": f"""
SELECT DISTINCT t.file_id, t.var, t.src, s.sink, s.line_number AS sink_line, s.line AS sink_content,
  (SELECT count(*) FROM {p}steps x WHERE x.file_id = t.file_id AND x.var = t.var AND x.src = t.src
     AND x.line_number <= s.line_number) AS depth
FROM {p}tainted t JOIN sinks s ON s.file_id = t.file_id AND s.line_number <> t.src
  AND s.line_number >= t.since AND list_contains(s.words, t.name)""",
        # Every listed secret repeats the traces of its variable.
        f"{p}listed": f"""
SELECT t.*, s.rule_ord, s.match_ord FROM {p}traces t JOIN {p}secrets s USING (file_id, var, src)""",
        f"{p}touches": f"""
SELECT file_id, var, src, sink_line, src AS line_number FROM {p}traces
UNION
SELECT t.file_id, t.var, t.src, t.sink_line, x.line_number FROM {p}traces t JOIN {p}steps x
  ON x.file_id = t.file_id AND x.var = t.var AND x.src = t.src AND x.line_number <= t.sink_line""",
        f"{p}attached": f"""
SELECT c.file_id, c.line_number, count(*) AS n
FROM {p}touches c JOIN {p}listed l USING (file_id, var, src, sink_line) GROUP BY ALL""",
    }


CUSTOM_RULES = [
    {"name": "Import Line", "regex": r"import\s+([a-z]{4,})"},
    {"name": "Merchant Handle", "regex": r"(?i)merchant_[a-f0-9]{12}", "score": 9, "category": "handle"},
    {"name": "Broken", "regex": "(["},
    {"regex": "no name"},
]
CUSTOM_SQL_RULES = [
    ("Import Line", r"import\s+([a-z]{4,})", 1, 5, "api_key"),
    ("Merchant Handle", r"(?i)merchant_[a-f0-9]{12}", 0, 9, "handle"),
]


def _custom_matches() -> str:
    extra = " UNION ALL ".join(
        f"SELECT file_id, line_number, {len(rules()) + i} AS rule_ord, {text_literal(name)} AS secret_type, "
        f"{score} AS base_score, {text_literal(category)} AS category, "
        f"CAST(generate_subscripts(ms, 1) AS INTEGER) AS match_ord, unnest(ms) AS value "
        f"FROM (SELECT file_id, line_number, regexp_extract_all(line, {text_literal(regex)}, {group}) AS ms "
        f"FROM matchable)"
        for i, (name, regex, group, score, category) in enumerate(CUSTOM_SQL_RULES)
    )
    return f"SELECT * FROM matches UNION ALL {extra}"


SUBQUERIES: dict[str, str] = {
    "code_files": views.CODE_FILES,
    "targets": views.TARGETS,
    "manifest": views.MANIFEST,
    "reviews": views.REVIEWS,
    "blobs": views.BLOBS,
    "scripts": views.SCRIPTS,
    "files": f"SELECT *, {ext_of('path')} AS ext FROM code_files WHERE NOT {skipped('path', 'dirs')}",
    "plain_lines": exploded("file_id, path, ext", "files"),
    "lines": f"""
SELECT *, bool_or(regexp_matches(lower(line), '{"|".join(fv.CONTEXT_KEYWORDS)}')) OVER (
  PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context_match
FROM plain_lines""",
    "matchable": f"SELECT file_id, line_number, line FROM lines WHERE {matchable('line')}",
    "matches": matches(rules("core"), "matchable"),
    "doc_lines": f"SELECT * FROM ({exploded('doc_id', 'documents', 'text')}) WHERE {matchable('line')}",
    "scored": _scored("matches"),
    "hits": "SELECT * FROM scored WHERE score >= 2",
    "assigns": rf"""
SELECT file_id, line_number, line, regexp_extract(line, '{VARIABLE}(.+)', 1) AS lhs,
  regexp_extract_all(regexp_extract(line, '{VARIABLE}(.+)', 2), '\w+') AS words
FROM lines WHERE regexp_matches(line, '{VARIABLE}(.+)')""",
    "sinks": rf"""
SELECT * FROM (SELECT file_id, line_number, line, {sink('line')} AS sink, regexp_extract_all(line, '\w+') AS words
FROM lines) WHERE sink IS NOT NULL""",
    **_flow("", "hits"),
    "findings": _findings("hits", "attached"),
    "full_matches": matches(rules("full"), "matchable"),
    "full_scored": _scored("full_matches"),
    "full_hits": "SELECT * FROM full_scored WHERE score >= 2",
    **_flow("full_", "full_hits"),
    "full_findings": _findings("full_hits", "full_attached"),
    "custom_matches": _custom_matches(),
    "custom_scored": _scored("custom_matches"),
    "custom_hits": "SELECT * FROM custom_scored WHERE score >= 2",
    **_flow("custom_", "custom_hits"),
    "custom_findings": _findings("custom_hits", "custom_attached"),
    "distinct_findings": """
SELECT * FROM findings QUALIFY row_number() OVER (
  PARTITION BY file, line_number, secret_type, matched_value, source ORDER BY rule_ord, match_ord) = 1""",
    "ranked": """
SELECT *, row_number() OVER (
  ORDER BY score DESC, file, line_number, rule_ord, match_ord, source, secret_type, matched_value) AS idx
FROM distinct_findings""",
    "full_ranked": """
SELECT *, row_number() OVER (
  ORDER BY score DESC, file, line_number, rule_ord, match_ord, source, secret_type, matched_value) AS idx
FROM (SELECT * FROM full_findings QUALIFY row_number() OVER (
  PARTITION BY file, line_number, secret_type, matched_value, source ORDER BY rule_ord, match_ord) = 1)""",
    "advice": "SELECT * FROM (VALUES " + ", ".join(
        "({}, {}, {}, {})".format(*map(text_literal, (kind, title, description, priority)))
        for kind, priority, title, description, _ in advice.ADVICE
    ) + ") AS t(secret_type, title, description, priority)",
    "advised": """
SELECT f.*, a.title, a.description, a.priority FROM findings f JOIN advice a
  ON a.secret_type = CASE WHEN f.secret_type IN (SELECT secret_type FROM advice) THEN f.secret_type ELSE 'default' END""",
    "ru_names": f"SELECT unnest({text_list(ru_names())}) AS secret_type",
    "history": f"""
SELECT 'history/' || substr(commit_id, 1, 12) || '/' || path AS path, content
FROM (SELECT * FROM blobs WHERE commit_ord IN (SELECT DISTINCT commit_ord FROM blobs ORDER BY commit_ord LIMIT 50)
      AND NOT {skipped('path', 'parts')}
      QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY commit_ord, path_ord) = 1)
WHERE content <> ''""",
    "eligible": f"""
SELECT * FROM scripts
WHERE NOT starts_with({name_of('path')}, '.') AND list_contains({text_list(fv.REVIEW_EXTENSIONS)}, {suffix_of('path')})
  AND octet_length(encode(content)) <= {fv.REVIEW_MAX_BYTES} AND regexp_matches(content, '[^{SPACE[1:]}')""",
    "response_lines": f"""
SELECT file_id, path, line_number AS verdict_ord, {strip('line')} AS line
FROM ({exploded('file_id, path', 'safe_filtered', 'response')})""",
    "verdict_parts": f"""
SELECT *, CASE WHEN starts_with(lhs, '[') AND ends_with(lhs, ']') THEN {strip('substr(lhs, 2, length(lhs) - 2)')}
    ELSE lhs END AS word
FROM (SELECT *, {strip("substr(line, 1, strpos(line, ' - ') - 1)")} AS lhs,
        {strip("substr(line, strpos(line, ' - ') + 3)")} AS rhs
      FROM response_lines WHERE contains(line, ' - '))""",
    "verdicts": rf"""
SELECT file_id, path, CAST(row_number() OVER (PARTITION BY file_id ORDER BY verdict_ord) AS INTEGER) AS verdict_ord,
  severity,
  CASE WHEN numbered THEN CAST(regexp_extract(rhs, '^\s*L(\d+)\s*:', 1) AS INTEGER) END AS line,
  CASE WHEN numbered THEN {strip(r"regexp_extract(rhs, '^\s*L\d+\s*:\s*(.*)$', 1)")} ELSE rhs END AS code
FROM (SELECT *, regexp_matches(rhs, '^\s*L\d+\s*:') AS numbered, CASE upper(word) {" ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fv.THREAT_WORDS.items())} END AS severity FROM verdict_parts)
WHERE severity IS NOT NULL AND severity <> 'SAFE'""",
    "located": f"""
SELECT v.file_id, v.path, v.verdict_ord, v.severity, v.code, CAST(v.number AS INTEGER) AS line_number,
  CASE WHEN number BETWEEN 1 AND len(ls) THEN {rstrip('ls[number]')} ELSE substr(code, 1, 200) END AS line_content
FROM (SELECT v.*, c.ls, coalesce(v.line, CASE WHEN v.code <> '' THEN
        list_position(list_transform(c.ls, lambda x: contains(x, v.code)), true) END, 1) AS number
      FROM verdicts v LEFT JOIN (SELECT path, {lines_of('content')} AS ls FROM code_files) c USING (path)) v""",
    "review_findings": """
SELECT path AS file, line_number, line_content, 'AI Security' AS secret_type,
  substr(CASE WHEN code <> '' THEN code ELSE line_content END, 1, 80) AS matched_value,
  CASE severity WHEN 'LOW' THEN 3 WHEN 'MEDIUM' THEN 6 WHEN 'HIGH' THEN 9 ELSE 13 END AS score, severity,
  'ai_security' AS category, 'ai:nvidia' AS source, 0.0::DOUBLE AS entropy, false AS context_match,
  false AS structural_valid, CASE WHEN severity IN ('LOW', 'MEDIUM') THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
  0 AS trace_count, 1000000 AS rule_ord, verdict_ord AS match_ord
FROM located""",
    "stream_lines": f"""
SELECT file_id AS session_id, line_number AS seq, line FROM ({exploded('file_id', 'code_files')})
UNION ALL SELECT file_id, 0, '{fv.STREAM_START}' FROM code_files WHERE file_id % 5 <> 4
UNION ALL SELECT file_id, len({lines_of('content')}) + 1, '{fv.STREAM_END}' FROM code_files""",
    "signals": f"""
SELECT *, last_value(CASE WHEN kind <> 'alarm' THEN kind END IGNORE NULLS) OVER w AS marker,
  max(CASE WHEN kind = 'start' THEN seq END) OVER w AS opened
FROM (SELECT *, CASE WHEN line = '{fv.STREAM_START}' THEN 'start' WHEN line = '{fv.STREAM_END}' THEN 'end'
        ELSE 'alarm' END AS kind, CASE {" ".join(
    f"WHEN contains(line, '{a}') THEN '{a}'" for a in fv.ALARM_SUBSTRINGS)} END AS pattern
      FROM (SELECT session_id, seq, {strip('line')} AS line FROM stream_lines))
WHERE kind <> 'alarm' OR pattern IS NOT NULL
WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "alarms": """
SELECT session_id, CAST(seq AS INTEGER) AS seq, 'CRITICAL' AS severity, pattern, line
FROM signals WHERE kind = 'alarm' AND marker = 'start'""",
    "stream_verdicts": f"""
SELECT e.session_id, CAST(e.seq AS INTEGER) AS seq, CASE WHEN e.marker = 'start' AND EXISTS (
    SELECT 1 FROM alarms a WHERE a.session_id = e.session_id AND a.seq > e.opened AND a.seq < e.seq)
  THEN '{fv.VERDICT_ALARM}' ELSE '{fv.VERDICT_CLEAN}' END AS verdict
FROM signals e WHERE e.kind = 'end'""",
}
SUBQUERIES["safe_filtered"] = f"""
SELECT * FROM reviews WHERE NOT (contains(upper({strip('response')}), '[SAFE]')
  OR contains(upper({strip('response')}), '[БЕЗОПАСНО]') OR upper({strip('response')}) IN ('SAFE', 'БЕЗОПАСНО'))"""

_RECURSIVE = {name for name in SUBQUERIES if name.endswith("spread")}
_ORDER = [n for n in SUBQUERIES if n != "safe_filtered"]
_ORDER.insert(_ORDER.index("response_lines"), "safe_filtered")
_ORDER.remove("history")
_ORDER.insert(_ORDER.index("files"), "history")


def statement(final: str, replaced: dict[str, str] | None = None) -> str:
    """``final`` with the subqueries it needs, some of them replaced."""
    texts = {**SUBQUERIES, **(replaced or {})}

    def used(sql: str) -> set[str]:
        return {n for n in texts if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)}

    needed, pending = set(), used(final)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending |= used(texts[name]) - needed
    parts = [f"{n} AS ({texts[n]})" for n in _ORDER if n in needed]
    recursive = "RECURSIVE " if needed & _RECURSIVE else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + final
