"""Registered queries over the driver's tables, one or more for each operator, each with DuckDB SQL.

The events table is a frame with type event_type, time ts in microseconds and order event_id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.api import Analytic, Config, Engine
from wakeline.functions.values import BOOLEAN, NUMBER
from wakeline.operators import pipes
from wakeline.operators.frames import shared_path
from wakeline.plans import tree
from wakeline.plans.parser import Dialect
from wakeline.sources import frames, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MICRO = Config(ticks=1_000_000, host_key="no_host")
STRICT = Dialect(strict=True, implied_any=True, implied_base=True, allow_negation=True, allow_sample=True, allow_runs=True)
SPAN = 6 * 3600 * 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, config: Config = MICRO, **extra: Column) -> Engine:
    df = read(spark, sf_dir, "events")
    return Engine(spark, config).load(df.withColumns(extra) if extra else df, type="event_type", time="ts", order="event_id", unique=True)


def add(name: str, text: str, sql: str | None, columns: str = "event_id", config: Config = MICRO, **extra: Column | str) -> None:
    """A query over events; columns are SQL expressions over its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {k: F.expr(x) if isinstance(x, str) else x for k, x in extra.items()}
        return engine(spark, sf_dir, config, **made).run(text).selectExpr(*columns.split("; "))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def where(name: str, text: str, condition: str, **extra: Any) -> None:
    add(name, text, f"SELECT event_id FROM (SELECT *, nullif(value, 50) AS v, CASE WHEN event_id % 3 <> 0 THEN event_type END AS s FROM events) WHERE {condition}", v="nullif(value, 50)", s="CASE WHEN event_id % 3 <> 0 THEN event_type END", **extra)


# event queries, conditions

where("event_filter", "purchase where value > 50", "event_type = 'purchase' AND value > 50")
where("any_filter", "any where value >= 10 and value < 20 and user_id != 3", "value >= 10 AND value < 20 AND user_id <> 3")
where("implied_any", "user_id == 5 or value <= 1.5", "user_id = 5 OR value <= 1.5")
where("cmp_null3vl", 'any where not (s == "view" and value > 20)', "NOT (s = 'view' AND value > 20)")
where("cmp_types", 'any where value == "x" or user_id > 12 or event_type == 3', "user_id > 12")
where("cmp_strings", 'any where event_type >= "PURCHASE" and event_type < "View"', "event_type >= 'purchase' AND event_type < 'view'")
where("is_null", "any where s == null and value > 90", "s IS NULL AND value > 90")
where("not_null", "any where s != null and missing.field == null", "s IS NOT NULL")
where("in_set", 'any where event_type in ("CLICK", "view", null) and user_id in (1, 2, 3)', "event_type IN ('click', 'view') AND user_id IN (1, 2, 3)")
where("not_in", 'any where s not in ("click", null, "error")', "s NOT IN ('click', 'error')")
where("in_dynamic", "any where user_id in (event_id % 7, 3, event_id % 5)", "user_id = event_id % 7 OR user_id = 3 OR user_id = event_id % 5")
where("truthiness", "any where not (user_id % 4) and s", "user_id % 4 = 0 AND s IS NOT NULL AND s <> ''", config=Config(ticks=1_000_000, dialect=Dialect(implied_booleans=True)))
where("wildcard_eq", 'any where event_type == "*IC*"', "lower(event_type) LIKE '%ic%'")
where("wildcard_ne", 'any where s != "*r*"', "s NOT LIKE '%r%'")
where("wildcard_multi", 'any where wildcard(event_type, "c*k", "S*", "%_")', "lower(event_type) LIKE 'c%k' OR lower(event_type) LIKE 's%'")
where("like_operator", 'any where event_type like~ ("CL*", "err*") or event_type : "sign*"', "event_type LIKE 'cl%' OR event_type LIKE 'err%' OR event_type LIKE 'sign%'", config=Config(ticks=1_000_000, dialect=STRICT))
where("method_chain", 'any where event_type:substring(0, 3):length() == 3 and props:stringContains("1")', "length(substr(event_type, 1, 3)) = 3 AND contains(props, '1')")
where("case_sensitive", 'any where event_type == "View" or event_type == "click"', "event_type = 'click'", config=Config(ticks=1_000_000, case_sensitive=True))
where("fn_match", 'any where match(event_type, "[cv].*[kw]$", "SIGN(?P<x>up)")', "regexp_matches(event_type, '^(?:[cv].*[kw]$|sign(up))', 'is')")
where("enum_shorthand", "any where event_type.click and value > 10", "event_type = 'click' AND value > 10")
where("json_path", "any where false or k == 69", "json_extract(props, '$.k')::BIGINT = 69", k="CAST(get_json_object(props, '$.k') AS BIGINT)")
where("variant_path", "any where p.k > 90 and p.none == null", "json_extract(props, '$.k')::BIGINT > 90", p="parse_json(props)")
where("safe_missing", "any where safe(length(none)) == null and safe(value) > 120", "value > 120")
where("macro_const", "const LIMIT = 80 macro BIG(x, y) x > LIMIT and y == \"P*\" any where BIG(value, event_type)", "value > 80 AND event_type LIKE 'p%'")
where("arith_condition", "any where -value + 2 * user_id > 3 - event_id % 4", "-value + 2 * user_id > 3 - event_id % 4")

where("regex_operator", 'any where event_type regex~ ("cl.*k", "[ep].*") or props regex """\\{.*5.*"""', "regexp_matches(event_type, '^(?:cl.*k|[ep].*)', 'is') OR regexp_matches(props, '^\\{.*5.*', 'is')", config=Config(ticks=1_000_000, dialect=STRICT))
where("in_tilde", 'any where event_type in~ ("CLICK", "Error") and endsWith~(event_type, "K")', "event_type = 'click'", config=Config(ticks=1_000_000, dialect=STRICT))
where("fn_match_lite", 'any where matchLite(event_type, "p.*e", "s")', "regexp_matches(event_type, '^(?:p.*e|s)', 'is')")
where("null_order", "any where not (null < value) or not (s > null) or value > 130", "value > 130")
where("field_optional", 'any where ?missing.name == null and ?value > 125', "value > 125", config=Config(ticks=1_000_000, dialect=STRICT))
add("seq_single", "sequence by user_id [purchase where value > 60]", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 60", config=Config(ticks=1_000_000, dialect=STRICT))

# functions: one row an event, results as columns


def scalars(name: str, expressions: dict[str, tuple[str, str]], **extra: str) -> None:
    """Each expression as a result column: it stands in a lambda of an engine over events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from wakeline.plans import parser
        from wakeline.plans.compiler import Compiler, Scope

        e = engine(spark, sf_dir, MICRO, **{k: F.expr(x) for k, x in extra.items()})
        c = Compiler(Scope.frame(e.frame), e.context)
        return e.frame.select("event_id", *[c.value(e.definitions.expand(parser.expression(x))).col.alias(k) for k, (x, _) in expressions.items()])

    QUERIES[name] = run
    made = ", ".join(f"{x} AS {k}" for k, x in _DUCK.get(name, {}).items())
    SQL[name] = f"SELECT event_id, {', '.join(f'{y} AS {k}' for k, (_, y) in expressions.items())} FROM (SELECT *{', ' + made if made else ''} FROM events)"


_DUCK = {
    "fn_cidr": {"ip": "'10.' || (event_id % 4) || '.' || (event_id % 256) || '.' || (event_id % 100)"},
    "fn_number_long": {"t": "CASE event_id % 4 WHEN 0 THEN repeat('0', 30) || event_id WHEN 1 THEN repeat('f', 20) WHEN 2 THEN '0x' || repeat('f', 16) ELSE '-1234567890123456789' || event_id END"},
    "fn_number": {"t": "CASE event_id % 5 WHEN 0 THEN '0x' || printf('%x', event_id) WHEN 1 THEN '-' || event_id WHEN 2 THEN event_id || '.25' WHEN 3 THEN 'x1' END"},
    "arr_functions": {"a": "string_split(event_type || ',A,' || (event_id % 3), ',')"},
}
_S = "event_type"
scalars("fn_string_tests", {
    "a": ('startsWith(event_type, "CL")', f"starts_with({_S}, 'cl')"), "b": ('endsWith(event_type, "UP")', f"suffix({_S}, 'up')"), "c": ('stringContains(event_type, "Ur")', f"contains({_S}, 'ur')"),
    "d": ("stringContains(missing, \"x\")", "false"), "e": ('indexOf(event_type, "I")', f"(nullif(instr({_S}, 'i'), 0) - 1)::BIGINT"), "f": ('indexOf(props, "k", 3)', "CASE WHEN instr(substr(props, 4), 'k') > 0 THEN instr(substr(props, 4), 'k') + 2 END::BIGINT"),
    "g": ("length(event_type)", f"length({_S})::BIGINT"), "h": ("startsWith(missing, \"x\")", "NULL::BOOLEAN"),
})
scalars("fn_string_parts", {
    "a": ("substring(event_type, 1, 3)", f"{_S}[2:3]"), "b": ("substring(event_type, -3)", f"right({_S}, 3)"), "c": ("substring(event_type, -60, -1)", f"left({_S}, length({_S}) - 1)"),
    "d": ('between(props, "k", "}")', "regexp_extract(props, 'k([^}]*)[}]', 1)"), "e": ('concat(event_type, ":", user_id, true, "")', f"{_S} || ':' || user_id || 'true'"), "f": ("concat(event_type, missing)", "NULL::VARCHAR"),
    "g": ("string(user_id)", "user_id::VARCHAR"), "h": ('between(event_type, "I", "u")', f"CASE WHEN regexp_matches({_S}, 'i.*u') THEN regexp_extract({_S}, 'i(.*?)u', 1) END"),
})
scalars("fn_number", {"n": ("number(t)", "CASE event_id % 5 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN -event_id::DOUBLE WHEN 2 THEN event_id + 0.25::DOUBLE END"), "h": ("number(\"ff\", 16)", "255::BIGINT")}, t="CASE event_id % 5 WHEN 0 THEN concat('0x', lower(hex(event_id))) WHEN 1 THEN concat('-', event_id) WHEN 2 THEN concat(event_id, '.25') WHEN 3 THEN 'x1' END")
scalars("fn_number_long", {
    "n": ("number(t)", "CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 2 THEN 18446744073709551615::DOUBLE WHEN 3 THEN ('-1234567890123456789' || event_id)::DOUBLE END"),
    "h": ("number(t, 16) > 18446744073709551615", "CASE event_id % 4 WHEN 1 THEN true ELSE false END"), "b": ("number(t, 36) == null", "event_id % 4 = 3 AND false"),
}, t="CASE event_id % 4 WHEN 0 THEN concat(repeat('0', 30), event_id) WHEN 1 THEN repeat('f', 20) WHEN 2 THEN concat('0x', repeat('f', 16)) ELSE concat('-1234567890123456789', event_id) END")
scalars("fn_math", {
    "a": ("(user_id - 9) / 4", "floor((user_id - 9) / 4.0)::BIGINT"), "b": ("(user_id - 9) % 4", "(((user_id - 9) % 4 + 4) % 4)::BIGINT"), "c": ("(user_id - 9) % -4", "(user_id - 9 - (-4) * floor((user_id - 9) / -4.0))::BIGINT"),
    "d": ("value / 2", "value / 2"), "e": ("user_id / 0", "NULL::BIGINT"), "f": ("user_id / 2.0", "user_id / 2.0::DOUBLE"), "g": ("add(user_id, multiply(2, 3)) - subtract(event_id, 1)", "(user_id + 6 - (event_id - 1))::BIGINT"), "h": ("modulo(user_id, 0)", "NULL::BIGINT"),
})
scalars("fn_cidr", {
    "a": ('cidrMatch(ip, "10.1.0.0/16", "10.2.16.9/20")', "event_id % 4 = 1 OR event_id % 4 = 2 AND event_id % 256 BETWEEN 16 AND 31"), "b": ('cidrMatch(event_type, "10.0.0.0/8")', "false"), "c": ('cidrMatch(missing, "0.0.0.0/0")', "false"), "d": ('cidrMatch("fe80::1", "fe80::/10")', "true"),
}, ip="concat('10.', event_id % 4, '.', event_id % 256, '.', event_id % 100)")
scalars("arr_functions", {
    "a": ('arrayContains(a, "a", "zz")', "true"), "b": ('arrayContains(a, "CLICK")', "list_contains(a, 'click')"), "c": ('arraySearch(a, x, x == "v*" or x == "2")', "len(list_filter(a, lambda x: x LIKE 'v%' OR x = '2')) > 0"), "d": ('arrayCount(a, x, length(x) == 1)', "len(list_filter(a, lambda x: length(x) = 1))::BIGINT"),
    "e": ("length(a)", "len(a)::BIGINT"), "f": ("a[2]", "a[3]"), "g": ("a[9]", "NULL::VARCHAR"), "h": ("arraySearch(missing, x, true)", "false"), "i": ("arrayCount(event_type, x, true)", "0::BIGINT"), "j": ("arrayContains(missing, 1)", "NULL::BOOLEAN"),
}, a="split(concat(event_type, ',A,', event_id % 3), ',')")

# pipes

add("pipe_count_total", "purchase where true | count", "SELECT 'totals' AS key, count(*) AS count FROM events WHERE event_type = 'purchase'", "key; count")
add("pipe_count_by", "any where true | count event_type", "SELECT event_type AS key, count(*) AS count, count(*) / sum(count(*)) OVER () AS percent FROM events GROUP BY event_type", "key; count; percent")
add("pipe_count_by2", "any where value > 20 | count event_type, user_id", "SELECT event_type AS key0, user_id::VARCHAR AS key1, count(*) AS count, count(*) / sum(count(*)) OVER () AS percent FROM events WHERE value > 20 GROUP BY 1, 2", "key[0] AS key0; key[1] AS key1; count; percent")
add("pipe_count_hosts", "any where value > 50 | count event_type", "SELECT event_type AS key, count(*) AS count, count(DISTINCT user_id) AS total_hosts, array_to_string(list_sort(list(DISTINCT user_id::VARCHAR)), ',') AS hosts FROM events WHERE value > 50 GROUP BY 1", "key; count; CAST(total_hosts AS BIGINT) AS total_hosts; array_join(hosts, ',') AS hosts", config=Config(ticks=1_000_000, host_key="user_id"))
add("pipe_percent_filter", "any where true | count event_type | filter percent > 0.2", "SELECT event_type AS key, count FROM (SELECT event_type, count(*) AS count, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) WHERE p > 0.2", "key; count")
add("pipe_unique", "any where true | unique user_id, event_type", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
add("pipe_unique_count", "any where value > 5 | unique_count user_id", "SELECT event_id, count, percent FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS count, count(*) OVER (PARTITION BY user_id) / count(*) OVER () AS percent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value > 5) WHERE n = 1", "event_id; count; percent")
add("pipe_head", "click where true | head 7", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 7")
add("pipe_tail", "click where true | tail", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 50")
add("pipe_sort_tail", "any where true | sort event_type value | tail 9", "SELECT event_id FROM (SELECT * FROM events ORDER BY event_type DESC, value DESC, event_id DESC LIMIT 9)")
add("pipe_sort_unique", "any where value > 30 | sort value | unique event_type | head 3", "SELECT event_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n FROM events WHERE value > 30) WHERE n = 1 ORDER BY value, event_id LIMIT 3)")
add("pipe_filter_chain", "any where true | filter value > 10 | filter user_id == 4 | tail 5 | head 2", "SELECT event_id FROM (SELECT * FROM events WHERE value > 10 AND user_id = 4 ORDER BY event_id DESC LIMIT 5) ORDER BY event_id LIMIT 2")
add("pipe_implied_base", "| unique event_type | count", "SELECT 'totals' AS key, count(DISTINCT event_type) AS count FROM events", "key; count")

# sequences, joins, samples

_BASE = "SELECT event_id AS o, epoch_us(ts) AS t, user_id, event_type, value FROM events"


def sequence_sql(steps: list[tuple[str, str]], key: str, span: int | None = None, until: str | None = None, fork: tuple[int, ...] = (), missing: tuple[int, ...] = (), types: dict[int, str] | None = None) -> str:
    """The chained windows of a sequence in SQL: (condition, alias of the id) for each step."""
    n = len(steps)
    rows = [f"SELECT o, t, {key} AS k, {n - 1 - p} AS r, {p} AS p, coalesce({(types or {}).get(p, c) if p in missing else c}, false) AND TRUE AS present, coalesce({c}, false) AS hit FROM e WHERE {(types or {}).get(p, c) if p in missing else c}" for p, (c, _) in enumerate(steps)]
    if until:
        rows.append(f"SELECT o, t, {key}, -1, -1, true, true FROM e WHERE {until}")
    none = "{'v': NULL::STRUCT(ids BIGINT[], s BIGINT)}"
    fresh = "{'v': {'ids': []::BIGINT[], 's': NULL::BIGINT}}" if 0 in missing else "{'v': {'ids': [o], 's': t}}"
    parts = [f"e AS ({_BASE})", f"r AS ({' UNION ALL '.join(rows)})", f"s0 AS (SELECT *, CASE WHEN p = 0 AND {'NOT ' * (0 in missing)}hit THEN {fresh} END AS c0 FROM r)"]
    for p in range(1, n):
        take = "" if p in fork else f" WHEN p = {p} THEN {none}"
        parts.append(f"w{p} AS (SELECT *, last_value(CASE WHEN p = {p - 1} AND c{p - 1} IS NOT NULL THEN c{p - 1} WHEN p = -1 THEN {none}{take} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY o, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev{p} FROM s{p - 1})")
        live = f"p = {p} AND prev{p}.v IS NOT NULL AND {'NOT ' * (p in missing)}hit" + (f" AND coalesce(prev{p}.v.s >= t - {span}, true)" if span is not None else "")
        grown = f"prev{p}" if p in missing else f"{{'v': {{'ids': list_append(prev{p}.v.ids, o), 's': coalesce(prev{p}.v.s, t)}}}}"
        parts.append(f"s{p} AS (SELECT *, CASE WHEN {live} THEN {grown} END AS c{p} FROM w{p})")
    ids = ", ".join(f"c{n - 1}.v.ids[{k + 1}] AS {a}" for k, a in enumerate(a for p, (_, a) in enumerate(steps) if p not in missing))
    return f"WITH {', '.join(parts)} SELECT {ids} FROM s{n - 1} WHERE p = {n - 1} AND c{n - 1} IS NOT NULL"


def match(name: str, text: str, n: int, sql: str | None, config: Config = MICRO, **extra: str) -> None:
    add(name, text, sql, "; ".join(f"events[{k}].event_id AS e{k}_id" for k in range(n)), config, **extra)


def _steps(*conditions: str) -> list[tuple[str, str]]:
    return [(c, f"e{k}_id") for k, c in enumerate(conditions)]


_V, _C, _P = "event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'"
match("seq2", "sequence [view where value > 90] [purchase where value > 90]", 2, sequence_sql(_steps(f"{_V} AND value > 90", f"{_P} AND value > 90"), "0"))
match("seq2_by", "sequence by user_id [view where true] [click where true]", 2, sequence_sql(_steps(_V, _C), "user_id"))
match("seq_by_each", "sequence [view where true] by user_id, 1 * user_id % 3 [click where true] by user_id % 20, user_id % 3", 2, f"WITH e AS ({_BASE}), r AS (SELECT o, t, user_id AS k, user_id % 3 AS k2, 1 AS r, 0 AS p FROM e WHERE {_V} UNION ALL SELECT o, t, user_id % 20, user_id % 3, 0, 1 FROM e WHERE {_C}), w AS (SELECT *, last_value(CASE WHEN p = 0 THEN o ELSE -1 END) OVER (PARTITION BY k, k2 ORDER BY o, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r) SELECT prev AS e0_id, o AS e1_id FROM w WHERE p = 1 AND prev >= 0")
match("seq_maxspan", "sequence by user_id with maxspan=6h [view where true] [click where true] [purchase where true]", 3, sequence_sql(_steps(_V, _C, _P), "user_id", SPAN))
match("seq3", "sequence by user_id [view where true] [any where value > 20] [purchase where true]", 3, sequence_sql(_steps(_V, "value > 20", _P), "user_id"))
match("seq_until", "sequence by user_id with maxspan=2d [view where true] [click where true] [purchase where true] until [error where value > 10]", 3, sequence_sql(_steps(_V, _C, _P), "user_id", 48 * 3600 * 1_000_000, "event_type = 'error' AND value > 10"))
match("seq_fork", "sequence by user_id [view where true] [click where true] fork=true", 2, sequence_sql(_steps(_V, _C), "user_id", fork=(1,)))
match("seq_negated", "sequence by user_id with maxspan=2d [view where true] ![click where value > 30] [purchase where true]", 2, sequence_sql([(_V, "e0_id"), (f"{_C} AND value > 30", "x"), (_P, "e1_id")], "user_id", 48 * 3600 * 1_000_000, missing=(1,), types={1: _C}), Config(ticks=1_000_000, dialect=STRICT))
match("seq_runs", "sequence by user_id [view where true] with runs=3 [purchase where true]", 4, sequence_sql(_steps(_V, _V, _V, _P), "user_id"), Config(ticks=1_000_000, dialect=STRICT))
match("seq_filter_events1", "sequence by user_id [view where true] [click where true] | filter events[1].value > 40 and value < 60", 2, f"SELECT x.* FROM ({sequence_sql(_steps(_V, _C), 'user_id')}) x JOIN events a ON a.event_id = e0_id JOIN events b ON b.event_id = e1_id WHERE b.value > 40 AND a.value < 60")
add("seq_count", "sequence by user_id [view where true] [click where true] | count events[1].event_type, user_id", f"SELECT 'click' AS key0, user_id::VARCHAR AS key1, count(*) AS count FROM ({sequence_sql(_steps(_V, _C), 'user_id')}) x JOIN events ON event_id = e0_id GROUP BY user_id", "key[0] AS key0; key[1] AS key1; count")
match("seq_head_tail", "sequence by user_id [view where true] [click where true] | tail 20 | unique user_id", 2, f"SELECT e0_id, e1_id FROM (SELECT x.*, user_id, row_number() OVER (PARTITION BY user_id ORDER BY e1_id) AS n FROM (SELECT * FROM ({sequence_sql(_steps(_V, _C), 'user_id')}) ORDER BY e1_id DESC LIMIT 20) x JOIN events ON event_id = e0_id) WHERE n = 1")


def join_sql(conditions: list[str], key: str, until: str | None = None) -> str:
    """The fold of a join as a recursive walk along each key's rows."""
    n = len(conditions)
    rows = [f"SELECT o, {key} AS k, {p} AS r, {p} AS p FROM e WHERE {c}" for p, c in enumerate(conditions)]
    if until:
        rows.append(f"SELECT o, {key}, -1, -1 FROM e WHERE {until}")
    put = [f"CASE WHEN q.p = {p} AND s{p} IS NULL THEN q.o ELSE s{p} END" for p in range(n)]
    full = " AND ".join(f"({x}) IS NOT NULL" for x in put)
    state = ", ".join(f"CASE WHEN q.p = -1 OR w.done THEN CASE WHEN q.p = {p} THEN q.o END ELSE {put[p]} END AS s{p}" for p in range(n))
    done = f"q.p >= 0 AND NOT w.done AND {full}"
    return f"WITH RECURSIVE e AS ({_BASE}), r AS ({' UNION ALL '.join(rows)}), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, r) AS n FROM r), w AS (SELECT DISTINCT k, 0::BIGINT AS n, {', '.join(f'NULL::BIGINT AS s{p}' for p in range(n))}, false AS done FROM q UNION ALL SELECT q.k, q.n, {state}, {done} FROM w JOIN q ON q.k = w.k AND q.n = w.n + 1) SELECT {', '.join(f's{p} AS e{p}_id' for p in range(n))} FROM w WHERE done"


match("join2", "join by user_id [view where true] [purchase where true]", 2, join_sql([_V, _P], "user_id"))
match("join3", "join by user_id [view where true] [click where value > 10] [purchase where true]", 3, join_sql([_V, f"{_C} AND value > 10", _P], "user_id"))
match("join_until", "join by user_id [view where true] [click where true] [any where value > 100] until [error where true]", 3, join_sql([_V, _C, "value > 100"], "user_id", "event_type = 'error'"))
match("join_global", "join [view where value > 120] [signup where value > 120]", 2, join_sql([f"{_V} AND value > 120", "event_type = 'signup' AND value > 120"], "0"))
match("sample2", "sample by user_id [view where true] [purchase where value > 5]", 2, f"WITH e AS ({_BASE}), r AS (SELECT o, user_id AS k, 1 AS r FROM e WHERE {_V} UNION ALL SELECT o, user_id, 0 FROM e WHERE {_P} AND value > 5), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, r) - 1 AS n FROM r) SELECT min_by(o, n) AS e0_id, max_by(o, n) AS e1_id FROM n GROUP BY k, n // 2 HAVING count(*) = 2", Config(ticks=1_000_000, dialect=STRICT))

# ancestry: processes derived from event ids

_PROC = {"pid": "(event_id * 31) % 97 + 1", "ppid": "(event_id * 17) % 97 + 1", "subtype": "CASE WHEN event_id % 3 <> 1 THEN 'create' WHEN event_id % 5 = 0 THEN 'terminate' ELSE 'other' END", "kind": "CASE WHEN event_type = 'error' THEN 'file' ELSE 'process' END"}
_DSQL = f"""p AS (SELECT event_id AS o, {', '.join(f'{x} AS {k}' for k, x in _PROC.items())}, event_type, value FROM events),
nx AS (SELECT o, pid, kind, subtype, (SELECT min(b.o) FROM p b WHERE b.kind = 'process' AND b.o > a.o) AS n FROM p a WHERE kind = 'process' AND subtype = 'terminate'),
u AS (SELECT pid, n FROM nx WHERE n IS NOT NULL),
m AS (SELECT o, pid FROM p WHERE kind = 'process' AND event_type = 'signup' AND value > 60),
c AS (SELECT o, pid, ppid, coalesce((SELECT max(n) FROM u WHERE u.pid = p.ppid AND n <= p.o), 0) AS pu FROM p WHERE kind = 'process' AND subtype = 'create'),
l AS (SELECT o, pid, coalesce((SELECT max(n) FROM u WHERE u.pid = p.pid AND n <= p.o), 0) AS su FROM p)"""


def _ancestry(name: str, kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "events").withColumns({k: F.expr(x) for k, x in _PROC.items()})
        e = Engine(spark, MICRO).load(df, type="kind", time="ts", order="event_id", unique=True)
        return e.run(f'any where {kind} of [process where event_type == "signup" and value > 60]').select("event_id")

    QUERIES[name] = run
    SQL[name] = sql


_ancestry("event_of", "event", f"WITH {_DSQL} SELECT o AS event_id FROM l WHERE EXISTS (SELECT 1 FROM m WHERE m.pid = l.pid AND m.o BETWEEN l.su AND l.o)")
_GOOD = "g AS (SELECT o, pid FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.pid = c.ppid AND m.o >= c.pu AND m.o < c.o))"
_ancestry("child_of", "child", f"WITH {_DSQL}, {_GOOD} SELECT o AS event_id FROM l WHERE EXISTS (SELECT 1 FROM g WHERE g.pid = l.pid AND g.o BETWEEN l.su AND l.o)")
_ancestry("descendant_of", "descendant", f"WITH RECURSIVE {_DSQL}, {_GOOD}, d AS (SELECT o, pid FROM g UNION SELECT c.o, c.pid FROM c JOIN d ON d.pid = c.ppid AND d.o >= c.pu AND d.o < c.o) SELECT o AS event_id FROM l WHERE EXISTS (SELECT 1 FROM d WHERE d.pid = l.pid AND d.o BETWEEN l.su AND l.o)")

# places in the order that four events share


def _shared(spark: SparkSession, sf_dir: str) -> Engine:
    df = read(spark, sf_dir, "events").withColumns({k: F.expr(x) for k, x in _PROC.items()} | {"place": F.expr("event_id DIV 4")})
    return Engine(spark, MICRO).load(df, type="kind", time="ts", order="place")


def ties_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).run('any where not descendant of [process where event_type == "signup" and value > 60]').select("event_id")


def ties_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _shared(spark, sf_dir).run('join by event_id % 4 [any where event_type == "view"] [any where event_type == "purchase" and value > 20]')
    return got.selectExpr("events[0].event_id AS e0_id", "events[1].event_id AS e1_id")


_TIES = _DSQL.replace("SELECT event_id AS o,", "SELECT event_id, event_id // 4 AS o,", 1).replace("l AS (SELECT o, pid,", "l AS (SELECT event_id, o, pid,")
SQL["ties_ancestry"] = f"WITH RECURSIVE {_TIES}, {_GOOD}, d AS (SELECT o, pid FROM g UNION SELECT c.o, c.pid FROM c JOIN d ON d.pid = c.ppid AND d.o >= c.pu AND d.o < c.o) SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pid = l.pid AND d.o BETWEEN l.su AND l.o)"
SQL["ties_join"] = join_sql([_V, f"{_P} AND value > 20"], "o % 4")
QUERIES |= {"ties_ancestry": ties_ancestry, "ties_join": ties_join}

# the rest of the surface


def custom_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("reversed", lambda c: F.reverse(c)).register("near", lambda a, b: F.abs(a - b) < 5, BOOLEAN)
    e.register_python("half", lambda x: x / 2, NUMBER)
    return e.run('any where reversed(event_type) == "WEIV" and near(value, 40) or half(value) > 60').select("event_id")


def map_reduce_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four parts counts on its own; the partial rows are merged."""
    text = "any where value > 5 | count event_type | filter count > 3"
    e = engine(spark, sf_dir)
    parts = [e.run("any where value > 5 | count event_type", e.frame.where(F.col("user_id") % 4 == k)) for k in range(4)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return e.merge(merged, text).select("key", "count", "percent")


def conversation_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 100_000 + F.col("turn"))
    e = Engine(spark, MICRO).load(df, type="role", time="n", order="n")
    got = e.run("sequence by conv_id [system where true] [user where true] [assistant where true]")
    return got.select(*[F.col(f"events")[k]["n"].alias(f"e{k}") for k in range(3)])


def orders_lineitem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their returned lines as events of two types, joined by key."""
    o = frames.from_table(read(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS status"), F.lit("order"), F.lit(0), F.col("key") * 10)
    li = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "l_returnflag AS flag", "l_linenumber AS line")
    line = frames.from_table(li, F.lit("line"), F.lit(0), F.col("key") * 10 + F.col("line"))
    got = Engine(spark, MICRO).run('join by key [order where status == "F"] [line where flag == "r"]', frames.union(o, line))
    return got.selectExpr("events[0].key AS key", "CAST(events[1].line AS BIGINT) AS line")


def sequence_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir).with_config(flatten=True)
    return e.run("sequence by user_id [view where true] [click where true] | head 30").select("event_id", "event_type")


def analytics_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).analytics([Analytic("big", "any where value > 150"), Analytic("pair", "sequence by user_id [view where value > 60] [purchase where value > 60]")])
    return got.groupBy("analytic_id").agg(F.count("*").alias("n"), F.sum(F.size("events")).cast("bigint").alias("n_events"))


def unique_on_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as whole VARIANTs: fields, keys and pipes without a schema."""
    df = read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("j"))
    frame = frames.from_variant(df, F.parse_json("j"), F.col("event_id"))
    got = Engine(spark, MICRO).run('any where event_type == "C*" and value > 20 | unique user_id', frame)
    return got.select(F.try_variant_get(F.col("__data"), "$.event_id", "bigint").alias("event_id"))


def sink_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    got = sinks.csv_columns(e.raw("sequence by user_id [view where true] [click where true]"), 2)
    return got.select(F.col("`events[0].event_id`").alias("e0_id"), F.col("`events[1].event_id`").alias("e1_id"))


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    got = e.run("any where value > 100")
    return got.select(F.get_json_object(sinks.as_json(got.select("event_id", "user_id")), "$.event_id").cast("bigint").alias("event_id"))


def streamed(spark: SparkSession, sf_dir: str, text: str, complete: bool = False, config: Config = MICRO) -> DataFrame:
    """A query over the events table as a stream, run to its end; what the sink has got."""
    # a glob, as a stream's path may be a folder or a pattern but no single file
    table = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out = Engine(spark, config).stream(text, frames.from_table(table, "event_type", "ts", "event_id"))
    path = shared_path(spark, "stream")
    w = out.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if complete:
        query = w.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    else:
        query = w.format("parquet").start(f"{path}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "purchase where value > 20 | filter user_id != 3").select("event_id")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "any where value > 20 | unique event_type, user_id").select("event_type", "user_id")


def stream_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "any where value > 20 | count event_type", complete=True).select("key", "count")


def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streamed(spark, sf_dir, "sequence by user_id with maxspan=6h [view where true] [click where true] [purchase where true] until [error where value > 50]")
    return _ids(got, 3)


def _ids(got: DataFrame, n: int) -> DataFrame:
    return got.select(*[F.get_json_object(F.col("events")[k], "$.event_id").cast("bigint").alias(f"e{k}_id") for k in range(n)])


def stream_filter_events1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(streamed(spark, sf_dir, "sequence by user_id [view where true] [click where true] | filter events[1].value > 40 and value < 60"), 2)


def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(streamed(spark, sf_dir, "sample by user_id [view where true] [purchase where value > 5]", config=Config(ticks=1_000_000, dialect=STRICT)), 2)


def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes of a query on matches found before."""
    e = engine(spark, sf_dir)
    found = e.raw("sequence by user_id [view where true] [click where true]")
    return e.post_process(found, "| filter events[1].value > 40 and value < 60").select(*[F.col("events")[k]["event_id"].alias(f"e{k}_id") for k in range(2)])


@pipes.register("every")
def every(flow: pipes.Flow, args: tuple[tree.Node, ...]) -> pipes.Flow:
    """A pipe of one's own: each n-th result by its place in the order."""
    n = pipes.amount(args, "every")
    return flow.with_df(flow.df.where(F.pmod(F.col(frames.ORD), F.lit(n)) == 0))


def custom_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("any where value > 20 | every 7 | filter user_id < 30").select("event_id")


def python_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir).macro("twice", lambda args: tree.Arith("*", args[0], tree.Literal(2)))
    return e.run("any where twice(value) > 150 and twice(user_id) < 40").select("event_id")


def _written(spark: SparkSession, sf_dir: str, ending: str) -> str:
    """The events table as files of a text format, in the shared folder."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"))
    path = f"{shared_path(spark, 'events')}.{ending}"
    text = F.to_json(F.struct("*"))
    if ending.startswith("jsonl"):
        lines = df.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("# a comment\n"), text)).otherwise(text))
    else:  # one array a file
        arrays = df.groupBy(F.expr("event_id DIV 1000")).agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))).alias("x"))
        lines = arrays.select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["t"]), ",\n"), F.lit("]")))
        lines = lines.repartition(arrays.count())
    w = lines.write.option("maxRecordsPerFile", 1 if ending.startswith("json.") or ending == "json" else 0).option("encoding", "UTF-8")
    (w.option("compression", "gzip") if ending.endswith("gz") else w).text(path)
    return path


def _from_files(ending: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = frames.read(spark, _written(spark, sf_dir, ending), ending)
        got = Engine(spark, MICRO).run("sequence by user_id [view where true] [click where value > 10] | tail 300", frame)
        return got.select(*[F.try_variant_get(F.col("events")[k]["__data"], "$.event_id", "bigint").alias(f"e{k}_id") for k in range(2)])

    return run


def source_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in UTF-16."""
    lines = read(spark, sf_dir, "events").where("event_id < 500").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("j"))
    path = shared_path(spark, "utf16")
    whole = lines.agg(F.encode(F.array_join(F.collect_list("j"), "\n"), "UTF-16BE").cast("string"))  # a cast keeps the bytes
    whole.write.option("encoding", "ISO-8859-1").option("lineSep", "\0\n").text(path)
    frame = frames.read(spark, path, "jsonl", "UTF-16BE")
    return Engine(spark, MICRO).run("any where value > 40", frame).select(F.try_variant_get(F.col("__data"), "$.event_id", "bigint").alias("event_id"))


_TAIL = f"SELECT e0_id, e1_id FROM ({sequence_sql([(_V, 'e0_id'), (f'{_C} AND value > 10', 'e1_id')], 'user_id')}) ORDER BY e1_id DESC LIMIT 300"
for _ending in ("json", "json.gz", "jsonl", "jsonl.gz"):
    QUERIES["source_" + _ending.replace(".", "_")] = _from_files(_ending)
    SQL["source_" + _ending.replace(".", "_")] = _TAIL
QUERIES |= {f.__name__: f for f in (custom_pipe, python_macro, source_encoding)}
SQL |= {
    "custom_pipe": "SELECT event_id FROM events WHERE value > 20 AND event_id % 7 = 0 AND user_id < 30",
    "python_macro": "SELECT event_id FROM events WHERE value * 2 > 150 AND user_id * 2 < 40",
    "source_encoding": "SELECT event_id FROM events WHERE event_id < 500 AND value > 40",
}
QUERIES |= {f.__name__: f for f in (stream_filter, stream_unique, stream_count, stream_sequence, stream_filter_events1, stream_sample, post_process, custom_fn, map_reduce_count, conversation_seq, orders_lineitem_join, sequence_flatten, analytics_shared, unique_on_variant, sink_csv_columns, sink_json)}
_PAIR = sequence_sql(_steps("event_type = 'view' AND value > 60", "event_type = 'purchase' AND value > 60"), "user_id")
SQL |= {
    "stream_filter": "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 20 AND user_id <> 3",
    "stream_unique": "SELECT DISTINCT event_type, user_id FROM events WHERE value > 20",
    "stream_count": "SELECT event_type AS key, count(*) AS count FROM events WHERE value > 20 GROUP BY 1",
    "stream_sequence": sequence_sql(_steps(_V, _C, _P), "user_id", SPAN, "event_type = 'error' AND value > 50"),
    "stream_filter_events1": SQL["seq_filter_events1"],
    "stream_sample": SQL["sample2"],
    "post_process": SQL["seq_filter_events1"],
    "custom_fn": "SELECT event_id FROM events WHERE event_type = 'view' AND abs(value - 40) < 5 OR value / 2 > 60",
    "map_reduce_count": "SELECT event_type AS key, count(*) AS count, count(*) / sum(count(*)) OVER () AS percent FROM events WHERE value > 5 GROUP BY 1",
    "conversation_seq": sequence_sql([(f"role = '{r}'", f"e{k}") for k, r in enumerate(("system", "user", "assistant"))], "conv_id").replace(_BASE, "SELECT conv_id * 100000 + turn AS o, conv_id * 100000 + turn AS t, conv_id, role FROM conversations"),
    "orders_lineitem_join": "SELECT l_orderkey AS key, min(l_linenumber)::BIGINT AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' GROUP BY 1",
    "sequence_flatten": f"SELECT event_id, event_type FROM (SELECT unnest([e0_id, e1_id]) AS i FROM (SELECT * FROM ({sequence_sql(_steps(_V, _C), 'user_id')}) ORDER BY e1_id LIMIT 30)) JOIN events ON event_id = i",
    "analytics_shared": f"SELECT 'big' AS analytic_id, count(*) AS n, count(*) AS n_events FROM events WHERE value > 150 UNION ALL SELECT 'pair', count(*), 2 * count(*) FROM ({_PAIR})",
    "unique_on_variant": "SELECT min(event_id) AS event_id FROM events WHERE event_type LIKE 'c%' AND value > 20 GROUP BY user_id",
    "sink_csv_columns": SQL["seq2_by"],
    "sink_json": "SELECT event_id FROM events WHERE value > 100",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views followed by a click and a purchase of the same user within six hours, counted by user."""
    return engine(spark, sf_dir).run("sequence by user_id with maxspan=6h [view where true] [click where true] [purchase where true] until [error where true] | count user_id")
