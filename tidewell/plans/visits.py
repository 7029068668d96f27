"""Dashboard queries over a wide table of page visits.

The 43 shapes of the public ClickBench set: global and grouped aggregates, exact
distinct counts, top-k with and without offset, pattern filters, computed
grouping keys. ``VISITS`` derives the table from ``events`` by arithmetic, so
that every column the shapes need exists at any scale; ``sources.visits`` reads
a stored table with the original's types instead.

Ties at a top-k cut are broken by the group keys, so results are the same on
every run and engine.
"""

from __future__ import annotations

from tidewell.plans.suite import suite

VISITS = """visits AS (
  SELECT event_id AS visit_id, user_id, ts, CAST(ts AS DATE) AS day, user_id % 7 AS site_id, user_id % 23 AS region_id,
    CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 3 ELSE 0 END AS engine_id,
    CASE WHEN event_id % 5 = 0 THEN event_id % 17 ELSE 0 END AS ad_id, 800 + user_id % 1200 AS width, 400 + event_id % 300 AS height,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(event_type, ' ', CAST(user_id % 50 AS VARCHAR(9))) END AS phrase,
    CASE WHEN user_id % 4 = 0 THEN concat('model-', CAST(user_id % 11 AS VARCHAR(9))) ELSE '' END AS model, user_id % 6 AS phone,
    user_id * 37 % 1009 AS ip, event_id % 2 AS refresh, event_id % 3 AS is_link, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS download,
    CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS hidden, event_id % 8 - 1 AS source_id, event_id * 7919 % 641 AS url_hash, event_id % 13 AS referer_hash,
    concat('https://', CASE WHEN event_id % 2 = 0 THEN 'www.' ELSE '' END, 'site', CAST(user_id % 9 AS VARCHAR(9)), '.example/', event_type, '/', CAST(event_id % 40 AS VARCHAR(9))) AS url,
    CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('http://', CASE WHEN user_id % 2 = 0 THEN 'www.' ELSE '' END, 'ref', CAST(user_id % 5 AS VARCHAR(9)), '.example/p/', CAST(event_id % 100 AS VARCHAR(9))) END AS referer,
    CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('Page about ', event_type, ' é ', CAST(user_id % 30 AS VARCHAR(9))) END AS title
  FROM events
)"""

_DAYS = "day >= DATE '2024-01-05' AND day <= DATE '2024-01-25'"
_MINUTE = "CAST(date_trunc('minute', ts) AS [[TIMESTAMP_NTZ|TIMESTAMP]])"
_HOST = r"regexp_replace(referer, '^https?://(?:www[.])?([^/]+)/.*$', '[[$1|\1]]')"

QUERIES = {
    "q01_count": "SELECT count(*) AS n FROM visits",
    "q02_filtered_count": "SELECT count(*) AS n FROM visits WHERE ad_id <> 0",
    "q03_global_mix": "SELECT CAST(sum(ad_id) AS BIGINT) AS ads, count(*) AS n, avg(width) AS mean_width FROM visits",
    "q04_avg_wide_int": "SELECT avg(user_id) AS mean_user FROM visits",
    "q05_distinct_ints": "SELECT count(DISTINCT user_id) AS users FROM visits",
    "q06_distinct_strings": "SELECT count(DISTINCT phrase) AS phrases FROM visits",
    "q07_date_range": "SELECT min(day) AS first_day, max(day) AS last_day FROM visits",
    "q08_group_small": "SELECT ad_id, count(*) AS n FROM visits WHERE ad_id <> 0 GROUP BY ad_id ORDER BY n DESC, ad_id",
    "q09_distinct_by_group": "SELECT region_id, count(DISTINCT user_id) AS u FROM visits GROUP BY region_id ORDER BY u DESC, region_id LIMIT 10",
    "q10_mixed_distinct": "SELECT region_id, CAST(sum(ad_id) AS BIGINT) AS ads, count(*) AS c, avg(width) AS mean_width, count(DISTINCT user_id) AS u FROM visits GROUP BY region_id ORDER BY c DESC, region_id LIMIT 10",
    "q11_distinct_by_string": "SELECT model, count(DISTINCT user_id) AS u FROM visits WHERE model <> '' GROUP BY model ORDER BY u DESC, model LIMIT 10",
    "q12_distinct_by_pair": "SELECT phone, model, count(DISTINCT user_id) AS u FROM visits WHERE model <> '' GROUP BY phone, model ORDER BY u DESC, phone, model LIMIT 10",
    "q13_top_strings": "SELECT phrase, count(*) AS c FROM visits WHERE phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "q14_top_strings_by_users": "SELECT phrase, count(DISTINCT user_id) AS u FROM visits WHERE phrase <> '' GROUP BY phrase ORDER BY u DESC, phrase LIMIT 10",
    "q15_top_pairs": "SELECT engine_id, phrase, count(*) AS c FROM visits WHERE phrase <> '' GROUP BY engine_id, phrase ORDER BY c DESC, engine_id, phrase LIMIT 10",
    "q16_top_users": "SELECT user_id, count(*) AS c FROM visits GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "q17_top_user_phrases": "SELECT user_id, phrase, count(*) AS c FROM visits GROUP BY user_id, phrase ORDER BY c DESC, user_id, phrase LIMIT 10",
    "q18_some_user_phrases": "SELECT count(*) AS rows_shown FROM (SELECT user_id, phrase, count(*) AS c FROM visits GROUP BY user_id, phrase LIMIT 10) t",
    "q19_by_minute": "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, phrase, count(*) AS c FROM visits GROUP BY user_id, CAST(extract(minute FROM ts) AS BIGINT), phrase ORDER BY c DESC, user_id, m, phrase LIMIT 10",
    "q20_point": "SELECT user_id FROM visits WHERE user_id = 42",
    "q21_contains": "SELECT count(*) AS n FROM visits WHERE url LIKE '%site3%'",
    "q22_min_string": "SELECT phrase, min(url) AS first_url, count(*) AS c FROM visits WHERE url LIKE '%site3%' AND phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "q23_not_like": "SELECT phrase, min(url) AS first_url, min(title) AS first_title, count(*) AS c, count(DISTINCT user_id) AS u FROM visits WHERE title LIKE '%click%' AND url NOT LIKE '%.site3.%' AND phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "q24_wide_top": "SELECT * FROM visits WHERE url LIKE '%site3%' ORDER BY ts, visit_id LIMIT 10",
    "q25_top_by_time": "SELECT phrase, ts FROM visits WHERE phrase <> '' ORDER BY ts, phrase LIMIT 10",
    "q26_top_by_string": "SELECT phrase FROM visits WHERE phrase <> '' ORDER BY phrase LIMIT 10",
    "q27_top_by_both": "SELECT phrase FROM visits WHERE phrase <> '' ORDER BY ts, phrase LIMIT 10",
    "q28_byte_length": "SELECT site_id, avg([[octet_length|strlen]](url)) AS l, count(*) AS c FROM visits WHERE url <> '' GROUP BY site_id HAVING count(*) > 100 ORDER BY l DESC, site_id LIMIT 25",
    "q29_regexp_host": f"SELECT k, avg([[octet_length|strlen]](referer)) AS l, count(*) AS c, min(referer) AS first_referer FROM (SELECT {_HOST} AS k, referer FROM visits WHERE referer <> '') t GROUP BY k HAVING count(*) > 100 ORDER BY l DESC, k LIMIT 25",
    "q30_many_sums": "SELECT " + ", ".join(f"CAST(sum(width + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM visits",
    "q31_pair_stats": "SELECT engine_id, ip, count(*) AS c, CAST(sum(refresh) AS BIGINT) AS refreshes, avg(width) AS mean_width FROM visits WHERE phrase <> '' GROUP BY engine_id, ip ORDER BY c DESC, engine_id, ip LIMIT 10",
    "q32_key_stats_filtered": "SELECT visit_id, ip, count(*) AS c, CAST(sum(refresh) AS BIGINT) AS refreshes, avg(width) AS mean_width FROM visits WHERE phrase <> '' GROUP BY visit_id, ip ORDER BY c DESC, visit_id, ip LIMIT 10",
    "q33_key_stats": "SELECT visit_id, ip, count(*) AS c, CAST(sum(refresh) AS BIGINT) AS refreshes, avg(width) AS mean_width FROM visits GROUP BY visit_id, ip ORDER BY c DESC, visit_id, ip LIMIT 10",
    "q34_top_urls": "SELECT url, count(*) AS c FROM visits GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "q35_ordinal_key": "SELECT 1 AS one, url, count(*) AS c FROM visits GROUP BY 1, url ORDER BY c DESC, url LIMIT 10",
    "q36_arithmetic_keys": "SELECT ip, ip - 1 AS ip1, ip - 2 AS ip2, ip - 3 AS ip3, count(*) AS c FROM visits GROUP BY ip, ip - 1, ip - 2, ip - 3 ORDER BY c DESC, ip LIMIT 10",
    "q37_site_urls": f"SELECT url, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND hidden = 0 AND refresh = 0 AND url <> '' GROUP BY url ORDER BY views DESC, url LIMIT 10",
    "q38_site_titles": f"SELECT title, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND hidden = 0 AND refresh = 0 AND title <> '' GROUP BY title ORDER BY views DESC, title LIMIT 10",
    "q39_offset": f"SELECT url, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND refresh = 0 AND is_link <> 0 AND download = 0 GROUP BY url ORDER BY views DESC, url LIMIT 10 OFFSET 20",
    "q40_case_key": f"SELECT source_id, engine_id, ad_id, CASE WHEN engine_id = 0 AND ad_id = 0 THEN referer ELSE '' END AS src, url AS dst, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND refresh = 0 GROUP BY source_id, engine_id, ad_id, CASE WHEN engine_id = 0 AND ad_id = 0 THEN referer ELSE '' END, url ORDER BY views DESC, source_id, engine_id, ad_id, src, dst LIMIT 10 OFFSET 30",
    "q41_in_list": f"SELECT url_hash, day, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND refresh = 1 AND source_id IN (-1, 6, 4) AND referer_hash = 5 GROUP BY url_hash, day ORDER BY views DESC, url_hash, day LIMIT 10 OFFSET 1",
    "q42_window_sizes": f"SELECT width, height, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND refresh = 0 AND hidden = 0 GROUP BY width, height ORDER BY views DESC, width, height LIMIT 10 OFFSET 15",
    "q43_minutes": f"SELECT {_MINUTE} AS m, count(*) AS views FROM visits WHERE site_id = 2 AND {_DAYS} AND refresh = 0 AND hidden = 0 GROUP BY {_MINUTE} ORDER BY m LIMIT 10 OFFSET 20",
}

_SPARK, _DUCK = suite({f"visits_{k}": q for k, q in QUERIES.items()}, VISITS)


def queries():
    return _SPARK


def oracle_sql():
    return _DUCK
