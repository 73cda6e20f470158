"""SQL for the queries of `registry` that SQL can express."""

from __future__ import annotations

from ..schemas import FLIGHT_COLUMNS

WORDS = """
WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents WHERE text IS NOT NULL),
     c AS (SELECT word, count(*) AS cnt FROM w WHERE regexp_matches(word, '^[mnopqMNOPQ]') GROUP BY word)
"""

FLIGHTS = """
WITH f AS (SELECT row_id, try_cast(yearstring AS int) AS year, try_cast(monthstring AS int) AS month, flight_date, unique_carrier AS carrier, origin, dest,
                  try_cast(dep_time AS int) AS dep_time, try_cast(arr_time AS int) AS arr_time, CASE WHEN isnan(arr_delay_minutes) THEN NULL ELSE arr_delay_minutes END AS arr_delay,
                  try_cast(cancelled AS double) AS cancelled, try_cast(diverted AS double) AS diverted FROM flights),
     g AS (SELECT * FROM f WHERE cancelled = 0 AND diverted = 0 AND arr_time IS NOT NULL AND dep_time IS NOT NULL AND arr_delay IS NOT NULL AND origin <> '' AND dest <> '')
"""
_PERIOD = "({0}.year = 2007 AND {0}.month BETWEEN 6 AND 12 OR {0}.year = 2008 AND {0}.month BETWEEN 1 AND 5)"


def _met(second_too: bool) -> str:
    return f"""{FLIGHTS}, p AS (SELECT a.flight_date, a.arr_delay + b.arr_delay AS total_delay FROM g a JOIN g b ON a.flight_date = b.flight_date AND a.dest = b.origin AND a.arr_time < b.dep_time
    WHERE a.origin = 'ORD' AND b.dest = 'JFK' AND {_PERIOD.format('a')} {'AND ' + _PERIOD.format('b') if second_too else ''})
"""


_MEAN = "SELECT round(sum(total_delay) / count(total_delay), 6) AS avg_delay FROM p HAVING count(total_delay) > 0"
_COUNT_MEAN = "SELECT count(total_delay) AS cnt, round(sum(total_delay) / count(total_delay), 6) AS avg_delay FROM {} HAVING count(total_delay) > 0"
_MONTHS = FLIGHTS + ", m AS (SELECT carrier, month, CAST(ceil(sum(arr_delay) / count(arr_delay)) AS int) AS avg_delay FROM f WHERE year = 2008 AND cancelled = 0 AND arr_delay IS NOT NULL GROUP BY carrier, month)\n"
_KEYED = FLIGHTS + ", k AS (SELECT *, year || ',' || carrier || ',' || lpad(CAST(month AS varchar), 2, '0') || ',' || row_id AS row_key FROM f WHERE year IS NOT NULL AND carrier IS NOT NULL AND month IS NOT NULL)\n"

ITEMS = """
WITH h0 AS (SELECT tx_id AS uid, unnest(songs) AS item FROM user_transactions), h AS (SELECT * FROM h0 WHERE uid IS NOT NULL AND item IS NOT NULL),
     i AS (SELECT item, count(*) AS support, list_sort(list(DISTINCT uid)) AS users FROM h GROUP BY item HAVING count(*) > 50),
     u AS (SELECT DISTINCT item, uid FROM h WHERE item IN (SELECT item FROM i)),
     l2 AS (SELECT [a.item, b.item] AS items, list_sort(list(a.uid)) AS users FROM u a JOIN u b ON a.uid = b.uid AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) > 10)
"""


def _levels(last: int, prune: bool = True) -> str:
    out = ITEMS
    for k in range(3, last + 1):
        dropped = [f"list_concat(items[1:{j - 1}], items[{j + 1}:{k}])" for j in range(1, k - 1)] if prune else []
        kept = " AND ".join([f"list_aggregate({x}, 'string_agg', ',') IN (SELECT list_aggregate(items, 'string_agg', ',') FROM l{k - 1})" for x in dropped] or ["true"])
        out += f""", c{k} AS (SELECT list_append(a.items, b.items[{k - 1}]) AS items, list_intersect(a.users, b.users) AS users
      FROM l{k - 1} a JOIN l{k - 1} b ON a.items[1:{k - 2}] = b.items[1:{k - 2}] AND a.items[{k - 1}] < b.items[{k - 1}]),
      l{k} AS (SELECT * FROM c{k} WHERE len(users) >= 1 AND {kept})"""
    return out


def _level(last: int, prune: bool = True) -> str:
    return _levels(last, prune) + f"\nSELECT list_aggregate(items, 'string_agg', ',') AS itemset, len(users) AS support FROM l{last}"


_PAIRS = "SELECT list_aggregate(items, 'string_agg', ',') AS pair, len(users) AS support, list_aggregate(users, 'string_agg', ',') AS users FROM l2"
TRANSACTIONS = """SELECT user_key AS "user", row_number() OVER (ORDER BY user_key) + 1 AS id, string_agg(song, ',' ORDER BY song) AS songs FROM listens WHERE user_key IS NOT NULL AND song IS NOT NULL GROUP BY user_key"""

POINTS = """
WITH p AS (SELECT song_id AS id, coalesce(CASE WHEN isnan(artist_hotness) THEN NULL ELSE artist_hotness END, 0) AS hotness,
                  coalesce(CASE WHEN isnan(loudness) THEN NULL ELSE loudness END, 0) AS loudness, coalesce(CASE WHEN isnan(beat) THEN NULL ELSE beat END, 0) AS beat FROM song_features),
     r AS (SELECT *, row_number() OVER (ORDER BY id, hotness, loudness, beat) AS row_no, count(*) OVER () AS n FROM p),
     s AS (SELECT CAST(i + 1 AS int) AS cluster, hotness, loudness, beat FROM r JOIN range(4) t(i) ON row_no = i * 7919 % n + 1),
     d AS (SELECT r.row_no, r.id, r.hotness, r.loudness, r.beat, s.cluster, sqrt((r.hotness - s.hotness) * (r.hotness - s.hotness) + (r.loudness - s.loudness) * (r.loudness - s.loudness) + (r.beat - s.beat) * (r.beat - s.beat)) AS far FROM r, s),
     a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY far, cluster) = 1)
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _records(feed: str, fields: str, values: str) -> str:
    """Rejected lines of a feed; `values` is over v, the list of fields without quotes (from 1)."""
    return f"""
{feed}_r AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') AS whole FROM {feed}),
{feed}_v AS (SELECT line_id, whole, list_transform(regexp_extract_all(',' || raw_line, ',({_FIELD})', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM {feed}_r),
{feed}_f AS (SELECT '{feed}' AS feed, line_id, v, CASE WHEN whole IS NOT NULL AND NOT whole THEN 'quoting' WHEN whole IS NULL OR NOT (len(v) {fields}) THEN 'columns' WHEN NOT ({values}) THEN 'value' END AS reason FROM {feed}_v)"""


def _wrong(names: list[str], ats: list[int], checks: list[str]) -> str:
    """What `records.rejected` says of the first value that isn't valid."""
    return "CASE " + " ".join(f"WHEN NOT ({check}) THEN 'value of {name}: ' || v[{at}]" for name, at, check in zip(names, ats, checks)) + " END"


def _time(at: int) -> str:
    return f"(v[{at}] = '' OR regexp_full_match(v[{at}], '[0-9]{{1,4}}') AND try_cast(v[{at}] AS int) // 100 <= 24 AND try_cast(v[{at}] AS int) % 100 <= 59)"


_SIGNED = "([-+]?[0-9]+([.][0-9]+)?)?"
_FLIGHT_CHECKS = {
    ("Year", 1): "regexp_full_match(v[1], '[0-9]{4}')",
    ("Month", 3): "regexp_full_match(v[3], '[0-9]{1,2}') AND try_cast(v[3] AS int) BETWEEN 1 AND 12",
    ("FlightDate", 6): "regexp_full_match(v[6], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[6] AS date) IS NOT NULL",
    ("Origin", 12): "regexp_full_match(v[12], '[A-Z]{3}')",
    ("Dest", 18): "regexp_full_match(v[18], '[A-Z]{3}')",
    ("DepTime", 25): _time(25),
    ("ArrTime", 36): _time(36),
    ("ArrDelayMinutes", 38): "regexp_full_match(v[38], '([0-9]+([.][0-9]+)?)?')",
    ("Cancelled", 42): "v[42] IN ('0.00', '1.00')",
    ("Diverted", 44): "v[44] IN ('0.00', '1.00')",
}
_SONG_CHECKS = {("song_id", 1): "v[1] <> ''"} | {(name, at): f"regexp_full_match(v[{at}], '{_SIGNED}')" for name, at in (("artist_hotness", 2), ("loudness", 8), ("beat", 9))}
_FLIGHT_VALUES, _SONG_VALUES = (" AND ".join(f"({c})" for c in checks.values()) for checks in (_FLIGHT_CHECKS, _SONG_CHECKS))


def _edits(feed: str, edits: str, checks: dict) -> str:
    wrong = _wrong([k[0] for k in checks], [k[1] for k in checks], list(checks.values()))
    return f"""SELECT f.feed, f.line_id, f.reason, CAST(CASE WHEN f.reason = 'columns' THEN {edits} ELSE 0 END AS int) AS edits, CASE WHEN f.reason = 'value' THEN {wrong} END AS wrong
    FROM {feed}_f f, (SELECT line_id AS line_at, len(coalesce(raw_line, '')) - len(replace(coalesce(raw_line, ''), ',', '')) + 1 AS k FROM {feed} WHERE raw_line IS NULL OR NOT contains(raw_line, '"'))
    WHERE f.line_id = line_at AND reason IS NOT NULL"""


RECORDS = f"WITH {_records('flight_lines', '= 55', _FLIGHT_VALUES)}, {_records('song_lines', '>= 9', _SONG_VALUES)}\n"

_CSV_FLIGHTS = (
    RECORDS.rstrip()
    + """, g0 AS (SELECT try_cast(v[1] AS int) AS year, try_cast(v[3] AS int) AS month, try_cast(v[6] AS date) AS flight_date, nullif(v[7], '') AS carrier, v[12] AS origin, v[18] AS dest, try_cast(v[25] AS int) AS dep_time,
     try_cast(v[36] AS int) AS arr_time, try_cast(v[38] AS double) AS arr_delay, try_cast(v[42] AS double) AS cancelled, try_cast(v[44] AS double) AS diverted FROM flight_lines_f WHERE reason IS NULL),
     g AS (SELECT * FROM g0 WHERE cancelled = 0 AND diverted = 0 AND arr_time IS NOT NULL AND dep_time IS NOT NULL AND arr_delay IS NOT NULL AND origin <> '' AND dest <> '')
"""
)
_KINDS = {"Year": "int", "Month": "int", "FlightDate": "date", "DepTime": "int", "ArrTime": "int", "ArrDelayMinutes": "double", "Cancelled": "double", "Diverted": "double"}


def _flight_column(at: int, name: str) -> str:
    return f"try_cast(v[{at}] AS {_KINDS[name]}) AS {name}" if name in _KINDS else f"v[{at}] AS {name}"


_STATISTICS = """
SELECT '{0}' AS field_name, {0} AS key_value, count(*) AS n, count(v) AS n_value, round(sum(v), 3) AS total, round(sum(v) / nullif(count(v), 0), 6) AS mean,
       {0} IS NOT NULL AND count(*) * 100 >= 5 * (SELECT count(*) FROM {2}) AS is_heavy
FROM (SELECT {0}, CASE WHEN isnan({1}) THEN NULL ELSE {1} END AS v FROM {2}) GROUP BY {0}
"""
STATISTICS = _STATISTICS.format("unique_carrier", "arr_delay_minutes", "flights") + " UNION ALL " + _STATISTICS.format("dummy", "total_delay", "connections")


_GRID = """
WITH RECURSIVE p0 AS (SELECT song_id AS id, coalesce(CASE WHEN isnan(artist_hotness) THEN NULL ELSE artist_hotness END, 0) AS h, coalesce(CASE WHEN isnan(loudness) THEN NULL ELSE loudness END, 0) AS l,
                 coalesce(CASE WHEN isnan(beat) THEN NULL ELSE beat END, 0) AS b FROM song_features),
     p AS (SELECT row_number() OVER (ORDER BY id, h, l, b) AS row_no, count(*) OVER () AS n, h, l, b FROM p0),
     s AS (SELECT k, i, c, h, l, b FROM (SELECT unnest([4, 5, 6, 7]) AS k), (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS c), p WHERE c <= k AND row_no = (i + c - 1) * 7919 % n + 1),
"""
_NEAREST = "arg_min(r.c, (sqrt((p.h - r.h) * (p.h - r.h) + (p.l - r.l) * (p.l - r.l) + (p.b - r.b) * (p.b - r.b)), r.c))"


def _sweep(rounds: int) -> str:
    """Sizes of the clusters after so many rounds, which is more than any run needs to come to rest."""
    return f"""{_GRID}
     r(round, k, i, c, h, l, b, size) AS (
       SELECT 0, k, i, c, h, l, b, 0::bigint FROM s
       UNION ALL
       SELECT round + 1, k, i, c, avg(h), avg(l), avg(b), count(*) FROM (
         SELECT r.round, r.k, r.i, p.row_no, {_NEAREST} AS c, any_value(p.h) AS h, any_value(p.l) AS l, any_value(p.b) AS b
         FROM r, p WHERE r.round < {rounds} GROUP BY r.round, r.k, r.i, p.row_no) GROUP BY round, k, i, c)
SELECT CAST(k AS int) AS k, CAST(i AS int) AS initial, string_agg(size || ' ', '' ORDER BY c) AS sizes FROM r WHERE round = {rounds} GROUP BY k, i
"""


THRESHOLD = f"""{_GRID}
     r(round, k, i, c, h, l, b, size, done) AS (
       SELECT 0, k, i, c, h, l, b, 0::bigint, false FROM s
       UNION ALL
       SELECT round + 1, k, i, c, h, l, b, size, round > 0 AND max(shift) OVER (PARTITION BY k, i) <= 1.0 AND count(*) OVER (PARTITION BY k, i) = old FROM (
         SELECT round, k, i, c, avg(ph) AS h, avg(pl) AS l, avg(pb) AS b, count(*) AS size, any_value(old) AS old,
                sqrt((avg(ph) - any_value(m.h)) * (avg(ph) - any_value(m.h)) + (avg(pl) - any_value(m.l)) * (avg(pl) - any_value(m.l)) + (avg(pb) - any_value(m.b)) * (avg(pb) - any_value(m.b))) AS shift
         FROM (SELECT r.round, r.k, r.i, p.row_no, {_NEAREST} AS c, arg_min({{'h': r.h, 'l': r.l, 'b': r.b}}, (sqrt((p.h - r.h) * (p.h - r.h) + (p.l - r.l) * (p.l - r.l) + (p.b - r.b) * (p.b - r.b)), r.c)) AS m,
                      any_value(p.h) AS ph, any_value(p.l) AS pl, any_value(p.b) AS pb, count(*) AS old
               FROM r, p WHERE NOT r.done AND r.round < 200 GROUP BY r.round, r.k, r.i, p.row_no) GROUP BY round, k, i, c))
SELECT CAST(k AS int) AS k, CAST(i AS int) AS initial, CAST(c AS int) AS cluster, round(h, 6) AS hotness, round(l, 6) AS loudness, round(b, 6) AS beat, size AS n FROM r WHERE done
"""


def oracle_sql() -> dict[str, str]:
    return {
        "wc_counts": WORDS + "SELECT word, cnt FROM c",
        "wc_by_letter": WORDS + "SELECT lower(word[1]) AS letter, ascii(lower(word[1])) - ascii('m') AS bucket, count(*) AS words, CAST(sum(cnt) AS bigint) AS cnt FROM c GROUP BY lower(word[1])",
        "flight_pairs": _met(True) + "SELECT flight_date, total_delay FROM p",
        "flight_avg_filter_first": _met(True) + _MEAN,
        "flight_avg_join_first_v1": _met(True) + _MEAN,
        "flight_avg_join_first_v2": _met(False) + _MEAN,
        "flight_count_avg": _met(True) + _COUNT_MEAN.format("p"),
        "connections_count_avg": _COUNT_MEAN.format("connections"),
        "carrier_month_flat": _MONTHS + "SELECT carrier, month, avg_delay FROM m",
        "carrier_month_nested": _MONTHS + "SELECT carrier, coalesce(string_agg('(' || month || ',' || avg_delay || '),', '' ORDER BY month), '') AS delays FROM m GROUP BY carrier",
        "flight_row_keys": _KEYED + "SELECT row_key, year, carrier, month, row_id FROM k",
        "flight_key_scan": _KEYED + "SELECT row_key, arr_delay FROM k WHERE year = 2008 AND cancelled = 0 AND arr_delay IS NOT NULL",
        "wide_table_scan": _KEYED + "SELECT row_key, arr_delay FROM k WHERE year = 2008 AND cancelled = 0 AND arr_delay IS NOT NULL",
        "wide_table_upserts": """
WITH f AS (SELECT *, try_cast(yearstring AS int) AS year, try_cast(monthstring AS int) AS month FROM flights),
     k AS (SELECT *, year || ',' || unique_carrier || ',' || lpad(CAST(month AS varchar), 2, '0') || ',' || flight_date || ',' || flight_num || ',' || origin AS row_key FROM f WHERE row_id IS NOT NULL)
SELECT row_key, row_id, year, arr_delay_minutes FROM k WHERE row_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1""",
        "letter_sink": WORDS + "SELECT lower(word[1]) AS letter, word, cnt FROM c",
        "text_sink": _MONTHS + "SELECT coalesce(carrier, '') || chr(9) || coalesce(CAST(month AS varchar), '') || chr(9) || avg_delay AS value FROM m WHERE carrier IS NOT NULL",
        "transactions_tabs": TRANSACTIONS,
        "csv_carrier_month": RECORDS
        + "SELECT v[7] AS carrier, CAST(v[3] AS int) AS month, CAST(ceil(sum(try_cast(v[38] AS double)) / count(try_cast(v[38] AS double))) AS int) AS avg_delay FROM flight_lines_f WHERE reason IS NULL AND v[1] = '2008' AND v[42] = '0.00' AND v[38] <> '' GROUP BY 1, 2",
        "csv_file_carrier_month": _CSV_FLIGHTS + "SELECT carrier, month, CAST(ceil(sum(arr_delay) / count(arr_delay)) AS int) AS avg_delay FROM g0 WHERE year = 2008 AND cancelled = 0 AND arr_delay IS NOT NULL GROUP BY carrier, month",
        "csv_file_pairs": _CSV_FLIGHTS
        + f"""SELECT a.flight_date, a.arr_delay + b.arr_delay AS total_delay FROM g a JOIN g b ON a.flight_date = b.flight_date AND a.dest = b.origin AND a.arr_time < b.dep_time
    WHERE a.origin = 'ORD' AND b.dest = 'JFK' AND {_PERIOD.format('a')} AND {_PERIOD.format('b')}""",
        "csv_points": RECORDS + "SELECT v[1] AS id, coalesce(try_cast(v[2] AS double), 0) AS hotness, coalesce(try_cast(v[8] AS double), 0) AS loudness, coalesce(try_cast(v[9] AS double), 0) AS beat FROM song_lines_f WHERE reason IS NULL",
        "tail_supports": ITEMS + "SELECT item, count(*) AS support, count(DISTINCT uid) AS users FROM h GROUP BY item",
        "kmeans_sweep": _sweep(90),
        "kmeans_parameter_lines": _sweep(90),
        "kmeans_sampled_seeds": POINTS
        + "SELECT CAST(row_number() OVER (ORDER BY id, hotness, loudness, beat) AS int) AS cluster, hotness, loudness, beat FROM r WHERE CAST('0x' || md5('1:' || id)[1:8] AS bigint) < CAST(0.005 * 4294967296 AS bigint) QUALIFY cluster <= 4",
        "kmeans_threshold": THRESHOLD,
        "transactions": TRANSACTIONS,
        "frequent_items": ITEMS + "SELECT item, support, list_aggregate(users, 'string_agg', ',') AS users FROM i",
        "frequent_pairs": ITEMS + _PAIRS,
        **{f"itemsets_k{k}": _level(k) for k in range(3, 8)},
        "itemsets_unpruned_k3": _level(3, prune=False),
        "itemsets_any_case_k3": _level(3).replace("a.items[1:1] = b.items[1:1]", "lower(a.items[1]) = lower(b.items[1])"),
        "itemset_levels": _levels(7) + " UNION ALL ".join(f" SELECT {k} AS pass, list_aggregate(items, 'string_agg', ',') AS itemset, len(users) AS support FROM l{k}" for k in range(3, 8)),
        "itemset_lines": ITEMS + _PAIRS,
        "kmeans_seeds": POINTS + "SELECT cluster, hotness, loudness, beat FROM s",
        "kmeans_assign": POINTS + "SELECT id, cluster FROM a",
        "kmeans_step": POINTS + "SELECT cluster, round(avg(hotness), 6) AS hotness, round(avg(loudness), 6) AS loudness, round(avg(beat), 6) AS beat, count(*) AS n FROM a GROUP BY cluster",
        "p4_found": RECORDS + "SELECT feed, line_id, reason FROM flight_lines_f WHERE reason IS NOT NULL UNION ALL SELECT feed, line_id, reason FROM song_lines_f WHERE reason IS NOT NULL",
        # a delimiter too many is deleted, or several are quoted by two edits
        "p4_edits": RECORDS + _edits("flight_lines", "CASE WHEN k < 55 THEN 55 - k ELSE least(k - 55, 2) END", _FLIGHT_CHECKS) + " UNION ALL " + _edits("song_lines", "9 - k", _SONG_CHECKS),
        "p4_flights": RECORDS + f"SELECT line_id, {', '.join(_flight_column(i, name) for i, name in enumerate(FLIGHT_COLUMNS, 1))} FROM flight_lines_f WHERE reason IS NULL",
        "p4_songs": RECORDS
        + "SELECT line_id, v[1] AS song_id, try_cast(v[2] AS double) AS artist_hotness, try_cast(v[8] AS double) AS loudness, try_cast(v[9] AS double) AS beat, list_aggregate(list_concat(v[3:7], v[10:]), 'string_agg', '|') AS others FROM song_lines_f WHERE reason IS NULL",
        "p6_found": f"SELECT field_name, key_value FROM ({STATISTICS}) WHERE is_heavy",
        "p6_statistics": STATISTICS,
    }
