"""SQL for the queries of this subpackage that SQL can express. The others are tested against brute force and round trips."""

from __future__ import annotations

P1 = """
WITH f AS (SELECT unique_carrier, try_cast(monthstring AS int) AS month, arr_delay_minutes AS v FROM flights
           WHERE yearstring = '2008' AND arr_delay_minutes IS NOT NULL AND NOT isnan(arr_delay_minutes)),
     r AS (SELECT *, row_number() OVER (PARTITION BY unique_carrier, month ORDER BY v) AS rn, count(*) OVER (PARTITION BY unique_carrier, month) AS n FROM f)
SELECT unique_carrier, month, max(n) AS n, max(CASE WHEN rn = (n * 50 + 99) // 100 THEN v END) AS p50,
       max(CASE WHEN rn = (n * 90 + 99) // 100 THEN v END) AS p90, max(CASE WHEN rn = (n * 99 + 99) // 100 THEN v END) AS p99
FROM r GROUP BY unique_carrier, month
"""

# a prefix holds nine bits below the leading one; delays aren't negative
P1_SUMMARIES = """
WITH f AS (SELECT unique_carrier, try_cast(monthstring AS int) AS month, flight_date, arr_delay_minutes AS v FROM flights
           WHERE yearstring = '2008' AND arr_delay_minutes IS NOT NULL AND NOT isnan(arr_delay_minutes)),
     u AS (SELECT *, CASE WHEN v = 0 THEN 1 ELSE pow(2, floor(log2(v)) - 9) END AS unit FROM f)
SELECT unique_carrier, month, flight_date, floor(v / unit) * unit AS value, count(*) AS n FROM u GROUP BY 1, 2, 3, 4
"""


def _overlaps(name: str, source: str, column: str, share: float) -> str:
    return f"""
{name}_m AS (SELECT DISTINCT set_id, unnest({column}) AS id FROM {source}),
{name}_i AS (SELECT * FROM {name}_m WHERE set_id IS NOT NULL AND id IS NOT NULL),
{name}_s AS (SELECT set_id, count(*) AS n FROM {name}_i GROUP BY set_id),
{name}_p AS (SELECT a.set_id AS set_a, b.set_id AS set_b, count(*) AS shared FROM {name}_i a JOIN {name}_i b ON a.id = b.id AND a.set_id < b.set_id GROUP BY 1, 2),
{name} AS (SELECT '{column}' AS field_name, set_a, set_b, shared, CAST(x.n AS int) AS size_a, CAST(y.n AS int) AS size_b
           FROM {name}_p JOIN {name}_s x ON x.set_id = set_a JOIN {name}_s y ON y.set_id = set_b WHERE shared >= {share} * least(x.n, y.n))"""



def _both(share: float) -> str:
    return f"WITH {_overlaps('u', 'frequent_items', 'users', share)}, {_overlaps('c', 'frequent_pairs', 'commons', share)} SELECT * FROM u UNION ALL SELECT * FROM c"


P3 = """
WITH l AS (SELECT DISTINCT itemset AS song, unnest(users) AS u FROM itemset_user_set WHERE itemset IS NOT NULL),
     i AS (SELECT * FROM l WHERE u IS NOT NULL), s AS (SELECT song, count(*) AS n FROM i GROUP BY song), t AS (SELECT count(DISTINCT u) AS n FROM i),
     p AS (SELECT a.song AS song_a, b.song AS song_b, count(*) AS n_ab FROM i a JOIN i b ON a.u = b.u AND a.song < b.song GROUP BY 1, 2)
"""
P3_FOUND = P3 + "SELECT song_a, song_b FROM p JOIN s x ON x.song = song_a JOIN s y ON y.song = song_b, t WHERE n_ab >= 20 AND n_ab * t.n >= 5 * x.n * y.n"
P3_PAIRS = P3 + "SELECT song_a, song_b, n_ab, round(CAST(n_ab AS double) * t.n / (CAST(x.n AS double) * CAST(y.n AS double)), 4) AS lift FROM p JOIN s x ON x.song = song_a JOIN s y ON y.song = song_b, t WHERE n_ab >= 5"
P3_ALL_PAIRS = P3 + "SELECT song_a, song_b, n_ab, round(CAST(n_ab AS double) * t.n / (CAST(x.n AS double) * CAST(y.n AS double)), 4) AS lift FROM p JOIN s x ON x.song = song_a JOIN s y ON y.song = song_b, t"


def _similar(name: str, left: str, right: str, same: bool) -> str:
    return f"""
{name}_p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM {left} a JOIN {right} b ON a.v = b.v {'AND a.id < b.id' if same else ''} GROUP BY 1, 2),
{name}_l AS (SELECT id, count(*) AS n FROM {left} GROUP BY id), {name}_r AS (SELECT id, count(*) AS n FROM {right} GROUP BY id),
{name} AS (SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM {name}_p JOIN {name}_l x ON x.id = a JOIN {name}_r y ON y.id = b WHERE c::double / (x.n + y.n - c) >= 0.6)"""


_P5 = f"""
WITH b0 AS (SELECT DISTINCT tx_id AS id, unnest(songs) AS v FROM user_transactions), b AS (SELECT * FROM b0 WHERE v IS NOT NULL AND id IN (SELECT id FROM b0 WHERE v IS NOT NULL GROUP BY id HAVING count(*) >= 5)),
i0 AS (SELECT DISTINCT set_id AS id, unnest(users) AS v FROM frequent_items), i AS (SELECT * FROM i0 WHERE v IS NOT NULL),
c0 AS (SELECT DISTINCT set_id AS id, unnest(commons) AS v FROM frequent_pairs), c AS (SELECT * FROM c0 WHERE v IS NOT NULL),
{_similar('s', 'b', 'b', True)}, {_similar('u', 'i', 'c', False)}
"""
P5 = _P5 + "SELECT 'songs' AS field_name, id_a, id_b FROM s UNION ALL SELECT 'users', id_a, id_b FROM u"


def _classes(name: str, source: str, links: str, all_rows: bool) -> str:
    return f"""SELECT '{name}' AS field_name, id, min(id) OVER (PARTITION BY held) AS class_id, coalesce(k, 0) AS links FROM (SELECT id, string_agg(v, ',' ORDER BY v) AS held FROM {source} GROUP BY id)
    LEFT JOIN (SELECT id AS other, count(*) AS k FROM (SELECT id_a AS id FROM {links} UNION ALL SELECT id_b FROM {links}) GROUP BY id) ON other = id {'' if all_rows else 'QUALIFY links > 0'}"""


P5_LINKS = f"{_P5} {_classes('songs', 'b', 's', True)} UNION ALL {_classes('users', 'i', 'u', False)} UNION ALL {_classes('commons', 'c', 'u', False)}"
P5_ALL_LINKS = f"{_P5} {_classes('songs', 'b', 's', True)} UNION ALL {_classes('users', 'i', 'u', True)} UNION ALL {_classes('commons', 'c', 'u', True)}"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_percentiles": P1,
        "p1_summaries": P1_SUMMARIES,
        "p2_found": f"SELECT field_name, set_a, set_b FROM ({_both(0.5)})",
        "p2_overlaps": _both(0.25),
        "p2_all_overlaps": _both(0),
        "hot_overlaps": f"WITH {_overlaps('c', 'frequent_pairs', 'commons', 0.25)} SELECT * FROM c",
        "p3_found": P3_FOUND,
        "p3_pairs": P3_PAIRS,
        "p3_all_pairs": P3_ALL_PAIRS,
        "p3_incremental": P3_FOUND,
        "p5_found": P5,
        "similar_baskets_by_rarest": _P5 + "SELECT id_a, id_b FROM s",
        "p5_links": P5_LINKS,
        "p5_all_links": P5_ALL_LINKS,
        "cluster_checks": f"SELECT CAST(count(DISTINCT song_id) AS bigint) AS songs, true AS as_many, true AS noise_is_near FROM song_features WHERE {' AND '.join(f'{f} <> 0 AND isfinite({f})' for f in ('artist_hotness', 'loudness', 'beat'))}",
        "packing_checks": "SELECT count(*) AS texts, CAST(0 AS bigint) AS cut_small, CAST(0 AS bigint) AS overfull, true AS well_filled FROM documents",
        "mix_checks": "SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND text <> '') AS has_texts, true AS share_kept, true AS repeats_kept FROM mix_targets t",
        "split_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    }
