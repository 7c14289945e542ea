"""SQL text of the example tables (the DuckDB side of ``fixtures``)."""

VIEWS = {
    "fx_stays": """
        SELECT o_custkey AS subject_id, o_custkey * 10000 + year(o_orderdate) AS hadm_id,
               o_orderkey AS stay_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN r_name || '_URGENT' ELSE n_name END AS unit,
               o_orderdate AS intime, o_totalprice / 120000.0 AS los,
               CAST(o_orderstatus = 'F' AS INTEGER) AS label,
               CASE WHEN o_orderstatus = 'F'
                    THEN o_orderdate + to_hours(CAST(o_orderkey % 240 AS INTEGER)) END AS deathtime,
               o_orderpriority AS admission_type
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_adm": """
        SELECT hadm_id, min(subject_id) AS subject_id, min(intime) AS admittime,
               max(intime) + INTERVAL 48 HOUR AS dischtime, min(deathtime) AS deathtime,
               min(admission_type) AS admission_type, max(label) AS label
        FROM fx_stays GROUP BY hadm_id""",
    "fx_patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               10 + c_custkey % 80 AS anchor_age, 1995 AS anchor_year,
               'G' || (c_custkey % 3) AS year_group
        FROM customer""",
    "fx_cohort": """
        SELECT s.subject_id, s.hadm_id, s.stay_id, s.unit, s.intime, s.los * 24.0 AS los_hours,
               p.anchor_age + (year(s.intime) - p.anchor_year) AS age, p.gender, p.year_group,
               a.admission_type, a.deathtime, a.label
        FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) AS rn
              FROM fx_stays) s
        JOIN fx_adm a ON s.hadm_id = a.hadm_id
        JOIN fx_patients p ON s.subject_id = p.subject_id
        WHERE s.rn = 1 AND p.anchor_age + (year(s.intime) - p.anchor_year) >= 18
          AND s.los * 24.0 >= 24
          AND NOT coalesce(a.deathtime <= s.intime + INTERVAL 24 HOUR, false)""",
    "fx_raw": """
        SELECT event_id, user_id * 100 + day(ts) AS stay_id, user_id, ts AS charttime,
               event_type, value
        FROM events""",
    "fx_sess": """
        SELECT stay_id, any_value(user_id) AS subject_id,
               min(date_trunc('day', charttime)) + to_hours(CAST(min(user_id) % 6 AS INTEGER)) AS intime,
               CAST(min(user_id) % 2 AS INTEGER) AS label
        FROM fx_raw GROUP BY stay_id""",
    "fx_events": """
        SELECT stay_id, event_type AS feature, value,
               date_diff('minute', CAST(date_trunc('day', charttime) AS TIMESTAMP), charttime) / 60.0 AS hours_in
        FROM fx_raw""",
    "fx_bins": """
        SELECT stay_id, feature, CAST(floor(hours_in / 6) AS INTEGER) AS hr,
               CASE WHEN feature = 'purchase' THEN sum(value)
                    WHEN feature IN ('error', 'signup') THEN max(value) ELSE avg(value) END AS value
        FROM fx_events WHERE hours_in >= 0 AND hours_in < 24
        GROUP BY stay_id, feature, floor(hours_in / 6)""",
    "fx_grid": """
        SELECT s.stay_id, f.feature, h.hr, b.value AS raw,
               CAST(b.value IS NOT NULL OR f.feature IN ('error', 'signup') AS INTEGER) AS observed
        FROM fx_sess s
        CROSS JOIN (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup']) AS feature) f
        CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS hr) h
        LEFT JOIN fx_bins b ON b.stay_id = s.stay_id AND b.feature = f.feature AND b.hr = h.hr""",
    "fx_filled": """
        SELECT stay_id, feature, hr, raw,
               CASE WHEN feature IN ('error', 'signup')
                    THEN max(coalesce(raw, 0.0)) OVER w
                    ELSE last_value(raw IGNORE NULLS) OVER w END AS value, observed
        FROM fx_grid
        WINDOW w AS (PARTITION BY stay_id, feature ORDER BY hr
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_dx": """
        SELECT o_custkey * 10000 + year(o_orderdate) AS hadm_id,
               upper(p_type) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS icd_code,
               9 + p_size % 2 AS icd_version
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_rules": """
        SELECT * FROM (VALUES ('a', 1, 9, 'ECONOMY'), ('b', 2, 10, 'SMALL'),
                              ('c', 3, 10, 'PROMO1'), ('c', 3, 9, 'PROMO2'))
        AS t(condition, weight, version, prefix)""",
    "fx_clients": """
        SELECT c.*, c.unit AS client FROM fx_cohort c
        WHERE unit IN (SELECT unit FROM fx_cohort GROUP BY unit HAVING count(*) >= 150)""",
    "fx_split": """
        WITH pat AS (SELECT client, subject_id, max(label) AS any_pos FROM fx_clients GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY client, any_pos
                              ORDER BY md5('42-' || subject_id), subject_id) - 1 AS rk,
                          count(*) OVER (PARTITION BY client, any_pos) AS n FROM pat),
        sized AS (SELECT *, round_even(n * 0.15::DOUBLE, 0) AS k FROM ranked)
        SELECT c.*, CASE WHEN rk < k THEN 'test' WHEN rk < 2 * k THEN 'val' ELSE 'train' END AS split
        FROM fx_clients c JOIN sized s ON c.client = s.client AND c.subject_id = s.subject_id""",
    "fx_pred": """
        SELECT o_orderkey AS id, n_name AS client, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
               round(least(0.999::DOUBLE, greatest(0.001::DOUBLE, 0.2::DOUBLE
                 + 0.3::DOUBLE * CAST(o_orderstatus = 'F' AS INTEGER) * ((o_orderkey * 7919) % 101) / 101.0::DOUBLE
                 + 0.4::DOUBLE * ((o_orderkey * 104729) % 997) / 997.0::DOUBLE)), 3) AS p1,
               round(least(0.999::DOUBLE, greatest(0.001::DOUBLE, o_totalprice / 600000.0::DOUBLE)), 3) AS p2
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_runs": """
        SELECT event_type AS arm, user_id % 25 AS seed, round(avg(value) / 100, 6) AS auprc,
               round(0.5 + avg(value) / 200, 6) AS auroc, round(avg(value) / 100 - 0.24, 6) AS fl_gain,
               length(event_type) * 1000 + user_id % 25 % 5 * 100 AS n_param, count(*) % 7 AS best_round
        FROM events GROUP BY event_type, user_id % 25""",
    "fx_vec": """
        SELECT 'c' || label AS client, i - 1 AS pos, avg(embedding[i]) AS value, count(*) AS weight
        FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i""",
    "fx_global": """
        SELECT pos, avg(value) AS value FROM fx_vec GROUP BY pos""",
    "fx_rounds": """
        SELECT event_type AS run, day(ts) AS round, round(avg(value), 6) AS metric
        FROM events GROUP BY event_type, day(ts)""",
}
