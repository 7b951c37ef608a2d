"""DuckDB twins of the Spark queries (the correctness oracle).

``sql(body, *needs)`` prefixes ``body`` with the CTEs it depends on (transitively,
in dependency order). The CTEs restate the fixture and ingest definitions in plain
SQL: fixture R from lineitem ⋈ orders, ids by ``dense_rank() − 1``, features from
``part``, and the per-user chronological split by ``row_number``.
"""

from __future__ import annotations

from rankloom import config as C

FEATURES = C.RETAIL_CONFIG.feature_cols
THRESH = C.RETAIL_CONFIG.rating_threshold

_feat_values = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))

CTES: dict[str, tuple[list[str], str]] = {
    "R": ([], """
SELECT o_custkey AS user_id, l_partkey AS item_id,
       CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
       CAST(epoch(l_shipdate) AS BIGINT) + (l_orderkey * 7919 + l_linenumber * 3607) % 86400
         AS "timestamp",
       CAST((l_orderkey * 31 + l_partkey * 17) % 601 AS DOUBLE) AS view_time_sec,
       CAST(l_discount >= 0.08 AS INTEGER) AS liked,
       CAST(l_linestatus = 'O' AS INTEGER) AS add_to_cart,
       CAST(l_returnflag <> 'R' AS INTEGER) AS ordered,
       l_orderkey AS _key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "UM": (["R"], """
SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx
FROM (SELECT DISTINCT user_id FROM R)"""),
    "IM": (["R"], """
SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx
FROM (SELECT DISTINCT item_id FROM R)"""),
    "P": (["R", "UM", "IM"], f"""
SELECT R.*, UM.user_idx, IM.item_idx,
       CAST(floor(("timestamp" % 86400) / 3600) AS INTEGER) AS hour,
       CAST((CAST(floor("timestamp" / 86400) AS BIGINT) + 3) % 7 AS INTEGER) AS day_of_week,
       CAST(month(DATE '1970-01-01' + CAST(floor("timestamp" / 86400) AS INTEGER)) - 1
            AS INTEGER) AS month,
       CAST(rating >= {THRESH} AS FLOAT) AS label,
       1.0 + 0.5 * least(greatest(coalesce(CAST(liked AS DOUBLE), 0), 0), 1)
           + 0.7 * least(greatest(coalesce(CAST(add_to_cart AS DOUBLE), 0), 0), 1)
           + 1.0 * least(greatest(coalesce(CAST(ordered AS DOUBLE), 0), 0), 1)
           + 0.5 * least(greatest(coalesce(view_time_sec, 0), 0) / 300.0, 1.0)
         AS interaction_weight
FROM R JOIN UM ON R.user_id = UM.user_id JOIN IM ON R.item_id = IM.item_id"""),
    "S": (["P"], """
SELECT *, CASE WHEN rn <= c2 THEN 'train' WHEN rn <= c1 THEN 'val' ELSE 'test' END AS role,
          CASE WHEN rn <= c1 THEN 'train' ELSE 'test' END AS serve_role
FROM (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS c1,
             CAST(floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS c2
      FROM (SELECT *, row_number() OVER (PARTITION BY user_idx
                                         ORDER BY "timestamp", item_idx, rating) AS rn,
                   count(*) OVER (PARTITION BY user_idx) AS n
            FROM P))"""),
    "TR": (["S"], "SELECT * FROM S WHERE role = 'train'"),
    "VA": (["S"], "SELECT * FROM S WHERE role = 'val'"),
    "TE": (["S"], "SELECT * FROM S WHERE role = 'test'"),
    "SV": (["S"], "SELECT * FROM S WHERE serve_role = 'train'"),
    "SEEN": (["TR"], "SELECT DISTINCT user_idx, item_idx FROM TR"),
    "W": (["TR"], """
SELECT *, greatest(coalesce(interaction_weight, 1.0), 0.1) AS _w,
       greatest(coalesce(interaction_weight, 1.0), 0.1) * rating AS _wr FROM TR"""),
    "MU": (["W"], "SELECT sum(_wr) / sum(_w) AS mu FROM W"),
    "UB": (["W", "MU"], """
SELECT user_idx, (sum(_wr) - (SELECT mu FROM MU) * sum(_w)) / (25.0 + sum(_w)) AS user_bias
FROM W GROUP BY user_idx"""),
    "IB": (["W", "MU"], """
SELECT item_idx, (sum(_wr) - (SELECT mu FROM MU) * sum(_w)) / (25.0 + sum(_w)) AS item_bias,
       ln(1 + sum(_w)) AS pop_prior
FROM W GROUP BY item_idx"""),
    "BR": (["UB", "IB", "MU", "SEEN"], """
SELECT user_idx, item_idx, score,
       CAST(row_number() OVER (PARTITION BY user_idx
                               ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
FROM (SELECT UB.user_idx, IB.item_idx,
             (SELECT mu FROM MU) + UB.user_bias + IB.item_bias + 0.5 * IB.pop_prior AS score
      FROM UB, IB
      WHERE NOT EXISTS (SELECT 1 FROM SEEN s
                        WHERE s.user_idx = UB.user_idx AND s.item_idx = IB.item_idx))"""),
    "PART": ([], """
SELECT p_partkey AS item_id, p_name || ' ' || p_brand AS product_name,
       ['Parts', 'type_' || p_type, 'w_' || split_part(p_name, ' ', 1),
        'w_' || split_part(p_name, ' ', 2)] AS categories
FROM part"""),
    "FEAT": ([], f"SELECT * FROM (VALUES {_feat_values}) AS t(feature_pos, feature)"),
    "ITEMS": (["PART", "IM"], """
SELECT IM.item_idx, PART.item_id, PART.product_name AS name, PART.categories
FROM PART JOIN IM ON PART.item_id = IM.item_id"""),
    "IF": (["ITEMS", "FEAT"], """
SELECT ITEMS.item_idx, FEAT.feature_pos, FEAT.feature
FROM ITEMS JOIN FEAT ON list_contains(list_slice(ITEMS.categories, 2, 4), FEAT.feature)"""),
    # ── content scorer ──
    "IV": (["IF"], """
SELECT item_idx, feature, 1.0 / sqrt(count(*) OVER (PARTITION BY item_idx)) AS value FROM IF"""),
    "IPOP": (["ITEMS", "TR"], """
SELECT ITEMS.item_idx, ln(1 + coalesce(p.p, 0)) AS pop
FROM ITEMS LEFT JOIN (SELECT item_idx, sum(interaction_weight) AS p FROM TR GROUP BY item_idx) p
  ON p.item_idx = ITEMS.item_idx"""),
    "LIKED": (["TR"], """
SELECT * FROM (SELECT *, max(CAST(rating >= 3.5 AS INTEGER)) OVER (PARTITION BY user_idx) AS _any
               FROM TR) WHERE rating >= 3.5 OR _any = 0"""),
    "PROF": (["LIKED", "IV"], """
SELECT user_idx, feature, s / nrm AS value
FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY user_idx)) AS nrm
      FROM (SELECT user_idx, feature,
                   sum(rating * coalesce(interaction_weight, 1.0) * value) AS s
            FROM LIKED JOIN IV USING (item_idx) GROUP BY user_idx, feature))
WHERE nrm > 0"""),
    "CU": (["TR"], "SELECT DISTINCT user_idx FROM TR"),
    "COS": (["PROF", "IV"], """
SELECT p.user_idx, v.item_idx, sum(p.value * v.value) AS cos
FROM PROF p JOIN IV v ON p.feature = v.feature GROUP BY p.user_idx, v.item_idx"""),
    "CR": (["CU", "IPOP", "COS", "SEEN"], """
SELECT user_idx, item_idx, score,
       CAST(row_number() OVER (PARTITION BY user_idx
                               ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
FROM (SELECT CU.user_idx, IP.item_idx, coalesce(COS.cos, 0) + 0.05 * IP.pop AS score
      FROM CU CROSS JOIN IPOP IP
      LEFT JOIN COS ON COS.user_idx = CU.user_idx AND COS.item_idx = IP.item_idx
      WHERE NOT EXISTS (SELECT 1 FROM SEEN s
                        WHERE s.user_idx = CU.user_idx AND s.item_idx = IP.item_idx))"""),
    # ── metrics ──
    "REL": (["TE"], "SELECT DISTINCT user_idx, item_idx FROM TE WHERE rating >= 3.5"),
    "NREL": (["REL"], "SELECT user_idx, count(*) AS n_rel FROM REL GROUP BY user_idx"),
    "KS": ([], "SELECT * FROM (VALUES (5), (10), (20)) AS t(k)"),
    "IDCG": ([], """
SELECT m, sum(1.0 / log2(i + 1)) AS idcg
FROM range(1, 21) AS a(m) JOIN range(1, 21) AS b(i) ON i <= m GROUP BY m"""),
    "RECS": (["BR", "CR"], """
SELECT 'bias' AS model, user_idx, rank, item_idx FROM BR WHERE rank <= 20
UNION ALL
SELECT 'content' AS model, user_idx, rank, item_idx FROM CR WHERE rank <= 20"""),
    "HITS": (["RECS", "REL"], """
SELECT r.model, r.user_idx, r.rank, CASE WHEN rel.item_idx IS NULL THEN 0 ELSE 1 END AS hit
FROM RECS r LEFT JOIN REL rel ON rel.user_idx = r.user_idx AND rel.item_idx = r.item_idx"""),
    "MAGG": (["HITS", "KS"], """
SELECT h.model, h.user_idx, k.k, sum(hit) AS h,
       sum(CASE WHEN hit = 1 THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg,
       min(CASE WHEN hit = 1 THEN rank END) AS first_hit
FROM HITS h JOIN KS k ON h.rank <= k.k GROUP BY h.model, h.user_idx, k.k"""),
    "PUM": (["NREL", "RECS", "KS", "MAGG", "IDCG"], """
SELECT mo.model, n.user_idx, CAST(k.k AS INTEGER) AS k,
       CAST(coalesce(a.h, 0) AS DOUBLE) / k.k AS precision,
       CAST(coalesce(a.h, 0) AS DOUBLE) / n.n_rel AS recall,
       coalesce(a.dcg, 0) / i.idcg AS ndcg,
       coalesce(1.0 / a.first_hit, 0) AS mrr
FROM NREL n CROSS JOIN (SELECT DISTINCT model FROM RECS) mo CROSS JOIN KS k
JOIN IDCG i ON i.m = least(n.n_rel, k.k)
LEFT JOIN MAGG a ON a.model = mo.model AND a.user_idx = n.user_idx AND a.k = k.k"""),
    "EVAL": (["PUM"], """
SELECT model, metric, k, value FROM (
  SELECT model, k, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg,
         avg(mrr) AS mrr FROM PUM GROUP BY model, k)
UNPIVOT (value FOR metric IN (precision, recall, ndcg, mrr))"""),
    "PR": (["CU", "IB", "SEEN"], """
SELECT user_idx, item_idx, score,
       CAST(row_number() OVER (PARTITION BY user_idx
                               ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
FROM (SELECT CU.user_idx, IB.item_idx, IB.pop_prior AS score FROM CU CROSS JOIN IB
      WHERE NOT EXISTS (SELECT 1 FROM SEEN s
                        WHERE s.user_idx = CU.user_idx AND s.item_idx = IB.item_idx))"""),
    "FC": (["BR", "CR", "PR"], """
SELECT 'bias' AS model, user_idx, item_idx, score FROM BR WHERE rank <= 200
UNION ALL SELECT 'content' AS model, user_idx, item_idx, score FROM CR WHERE rank <= 200
UNION ALL SELECT 'popularity' AS model, user_idx, item_idx, score FROM PR WHERE rank <= 200"""),
    "NORMS": (["FC"], """
SELECT model, user_idx, item_idx,
       CASE WHEN mx = mn THEN 0.5 ELSE (score - mn) / (mx - mn) END AS norm
FROM (SELECT *, min(score) OVER (PARTITION BY user_idx, model) AS mn,
             max(score) OVER (PARTITION BY user_idx, model) AS mx FROM FC)"""),
    "WIDE": (["NORMS"], """
SELECT user_idx, item_idx, max(CASE WHEN model = 'bias' THEN norm END) AS n_0,
       max(CASE WHEN model = 'content' THEN norm END) AS n_1,
       max(CASE WHEN model = 'popularity' THEN norm END) AS n_2
FROM NORMS GROUP BY user_idx, item_idx"""),
    # ── explanations / serving ──
    "EP": (["TE"], "SELECT DISTINCT user_idx, item_idx FROM TE"),
    "LK": (["SV"], "SELECT user_idx, item_idx AS liked_idx, rn FROM SV WHERE rating >= 4.0"),
    "CSEEN": (["SV"], "SELECT DISTINCT user_idx, item_idx FROM SV"),
    "FM": (["EP", "IF", "LK"], """
SELECT e.user_idx, e.item_idx, f.feature_pos, f.feature,
       round(coalesce(c.c, 0) / greatest(coalesce(nl.nl, 0), 1), 4) AS share
FROM EP e JOIN IF f ON f.item_idx = e.item_idx
LEFT JOIN (SELECT LK.user_idx, IF.feature, count(*) AS c FROM LK JOIN IF ON IF.item_idx = LK.liked_idx
           GROUP BY LK.user_idx, IF.feature) c ON c.user_idx = e.user_idx AND c.feature = f.feature
LEFT JOIN (SELECT user_idx, count(*) AS nl FROM LK GROUP BY user_idx) nl ON nl.user_idx = e.user_idx"""),
    "SIM": (["EP", "IF", "LK", "ITEMS"], """
SELECT o.user_idx, o.item_idx, CAST(o.pos AS BIGINT) AS pos, o.liked_idx, i.name AS liked_name,
       CAST(o.overlap AS BIGINT) AS overlap
FROM (SELECT *, row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY overlap DESC, rn) AS pos
      FROM (SELECT e.user_idx, e.item_idx, l.liked_idx, l.rn, count(*) AS overlap
            FROM EP e JOIN IF tf ON tf.item_idx = e.item_idx
            JOIN LK l ON l.user_idx = e.user_idx AND l.liked_idx <> e.item_idx
            JOIN IF lf ON lf.item_idx = l.liked_idx AND lf.feature = tf.feature
            GROUP BY e.user_idx, e.item_idx, l.liked_idx, l.rn)) o
JOIN ITEMS i ON i.item_idx = o.liked_idx WHERE o.pos <= 3"""),
    "RAW": (["EP", "UB", "IB", "MU", "COS"], """
SELECT e.user_idx, e.item_idx,
       CASE WHEN UB.user_idx IS NULL OR IB.item_idx IS NULL THEN (SELECT mu FROM MU)
            ELSE least(greatest((SELECT mu FROM MU) + UB.user_bias + IB.item_bias, 1.0), 5.0)
       END / 5.0 AS cf_raw,
       coalesce(COS.cos, 0) AS cbf_raw,
       coalesce(IB.pop_prior, 0) / (SELECT max(pop_prior) FROM IB) AS ncf_raw
FROM EP e LEFT JOIN UB ON UB.user_idx = e.user_idx LEFT JOIN IB ON IB.item_idx = e.item_idx
LEFT JOIN COS ON COS.user_idx = e.user_idx AND COS.item_idx = e.item_idx"""),
    "CON": (["RAW"], """
SELECT user_idx, item_idx, cf_raw, cbf_raw, ncf_raw,
       round(CAST(0.3 AS DOUBLE) * cf_raw / tot, 4) AS cf_contribution,
       round(CAST(0.3 AS DOUBLE) * cbf_raw / tot, 4) AS cbf_contribution,
       round(CAST(0.4 AS DOUBLE) * ncf_raw / tot, 4) AS ncf_contribution,
       round(tot, 4) AS hybrid_score
FROM (SELECT *, CASE WHEN t = 0 THEN 1e-9 ELSE t END AS tot
      FROM (SELECT *, CAST(0.3 AS DOUBLE) * cf_raw + CAST(0.3 AS DOUBLE) * cbf_raw
                      + CAST(0.4 AS DOUBLE) * ncf_raw AS t FROM RAW))"""),
    "CRS": (["CU", "IPOP", "COS", "CSEEN"], """
SELECT user_idx, item_idx, score,
       CAST(row_number() OVER (PARTITION BY user_idx
                               ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
FROM (SELECT CU.user_idx, IP.item_idx, coalesce(COS.cos, 0) + 0.05 * IP.pop AS score
      FROM CU CROSS JOIN IPOP IP
      LEFT JOIN COS ON COS.user_idx = CU.user_idx AND COS.item_idx = IP.item_idx
      WHERE NOT EXISTS (SELECT 1 FROM CSEEN s
                        WHERE s.user_idx = CU.user_idx AND s.item_idx = IP.item_idx))"""),
    "LOOK": (["ITEMS", "IF"], """
SELECT ITEMS.item_idx, ITEMS.item_id, ITEMS.name,
       coalesce(string_agg(IF.feature, ', ' ORDER BY IF.feature_pos), '') AS features
FROM ITEMS LEFT JOIN IF ON IF.item_idx = ITEMS.item_idx
GROUP BY ITEMS.item_idx, ITEMS.item_id, ITEMS.name"""),
    "REQ": (["S"], """
SELECT user_idx, rn, item_idx, rating, interaction_weight AS engagement FROM S WHERE role = 'test'"""),
    "RA": (["REQ", "IV"], """
SELECT *, least(0.6, 0.2 * (rating / 5.0) * greatest(engagement, 0.1)) AS alpha FROM REQ
WHERE item_idx IN (SELECT item_idx FROM IV)"""),
    "PREV": (["RA", "PROF", "IV"], """
SELECT user_idx, rn, feature, m / nrm AS value
FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY user_idx, rn)) AS nrm
      FROM (SELECT user_idx, rn, feature, (1.0 - alpha) * sum(p) + alpha * sum(v) AS m
            FROM (SELECT RA.user_idx, RA.rn, RA.alpha, PROF.feature, PROF.value AS p, 0.0 AS v
                  FROM RA JOIN PROF ON PROF.user_idx = RA.user_idx
                  UNION ALL
                  SELECT RA.user_idx, RA.rn, RA.alpha, IV.feature, 0.0 AS p, IV.value AS v
                  FROM RA JOIN IV ON IV.item_idx = RA.item_idx)
            GROUP BY user_idx, rn, alpha, feature))
WHERE nrm > 0"""),
    "SPROF": (["REQ", "RA", "PREV", "PROF"], """
SELECT user_idx, rn, feature, value FROM PREV
UNION ALL
SELECT REQ.user_idx, REQ.rn, PROF.feature, PROF.value FROM REQ JOIN PROF ON PROF.user_idx = REQ.user_idx
WHERE NOT EXISTS (SELECT 1 FROM RA WHERE RA.user_idx = REQ.user_idx AND RA.rn = REQ.rn)"""),
    "SESS": (["REQ", "SPROF", "IV", "IPOP", "CSEEN"], """
SELECT user_idx, rn, item_idx, score,
       CAST(row_number() OVER (PARTITION BY user_idx, rn
                               ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
FROM (SELECT r.user_idx, r.rn, IP.item_idx, coalesce(c.cos, 0) + 0.05 * IP.pop AS score
      FROM REQ r CROSS JOIN IPOP IP
      LEFT JOIN (SELECT p.user_idx, p.rn, v.item_idx, sum(p.value * v.value) AS cos
                 FROM SPROF p JOIN IV v ON v.feature = p.feature
                 GROUP BY p.user_idx, p.rn, v.item_idx) c
        ON c.user_idx = r.user_idx AND c.rn = r.rn AND c.item_idx = IP.item_idx
      WHERE IP.item_idx <> r.item_idx
        AND NOT EXISTS (SELECT 1 FROM CSEEN s
                        WHERE s.user_idx = r.user_idx AND s.item_idx = IP.item_idx))
QUALIFY rank <= 5"""),
    "EV": ([], """
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
       ts AS event_time, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
       CASE WHEN event_type = 'view' THEN value ELSE 0.0 END AS view_time_sec,
       event_type = 'click' AS clicked, event_type = 'purchase' AS ordered,
       event_type = 'signup' AS liked, false AS wishlist, false AS add_to_cart,
       CASE WHEN event_type = 'purchase' THEN CAST(least(5, 1 + floor(value / 25)) AS DOUBLE)
       END AS rating
FROM events WHERE event_type <> 'error'"""),
    "ENG": (["EV"], """
SELECT *, coalesce(rating, 3.0 + 2.0 * least((engagement - 1.0) / 3.5, 1.0)) AS effective_rating
FROM (SELECT *, 1.0 + CASE WHEN clicked THEN 0.3 ELSE 0.0 END + CASE WHEN liked THEN 0.5 ELSE 0.0 END
                    + CASE WHEN wishlist THEN 0.5 ELSE 0.0 END
                    + CASE WHEN add_to_cart THEN 0.7 ELSE 0.0 END
                    + CASE WHEN ordered THEN 1.0 ELSE 0.0 END
                    + CASE WHEN view_time_sec > 0 THEN 0.5 * least(view_time_sec / 300.0, 1.0)
                           ELSE 0.0 END AS engagement
      FROM EV)"""),
    # ── request tables ──
    "RQ": (["UM", "IM", "ENG"], """
SELECT e.event_id AS request_id, UM.user_idx, ['cf', 'cbf', 'ncf', 'hybrid'][1 + e.event_id % 4] AS model,
       1 + e.event_id % 50 AS n, CAST(hour(e.ts) AS INTEGER) AS hour,
       CAST(CAST(floor(e.value) AS BIGINT) % 7 AS INTEGER) AS dow, e.event_id % 5 <> 0 AS exclude_seen,
       IM.item_idx AS b_item, b.effective_rating AS b_rating, b.engagement AS b_engagement
FROM events e JOIN UM ON UM.user_id = e.user_id
LEFT JOIN ENG b ON b.event_id = e.event_id AND e.event_id % 3 = 0 LEFT JOIN IM ON IM.item_id = b.item_id"""),
    "RQA": (["RQ", "IV"], """
SELECT *, least(0.6, 0.2 * (b_rating / 5.0) * greatest(b_engagement, 0.1)) AS alpha FROM RQ
WHERE b_item IN (SELECT item_idx FROM IV)"""),
    "RQP": (["RQ", "RQA", "PROF", "IV"], """
SELECT request_id, feature, m / nrm AS value
FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY request_id)) AS nrm
      FROM (SELECT request_id, feature, (1.0 - alpha) * sum(p) + alpha * sum(v) AS m
            FROM (SELECT RQA.request_id, RQA.alpha, PROF.feature, PROF.value AS p, 0.0 AS v
                  FROM RQA JOIN PROF ON PROF.user_idx = RQA.user_idx
                  UNION ALL
                  SELECT RQA.request_id, RQA.alpha, IV.feature, 0.0 AS p, IV.value AS v
                  FROM RQA JOIN IV ON IV.item_idx = RQA.b_item)
            GROUP BY request_id, alpha, feature)) WHERE nrm > 0
UNION ALL
SELECT RQ.request_id, PROF.feature, PROF.value FROM RQ JOIN PROF ON PROF.user_idx = RQ.user_idx
WHERE RQ.request_id NOT IN (SELECT request_id FROM RQA)"""),
    "RQS": (["RQ", "RQP", "IV", "IPOP", "IB", "UB", "MU", "CSEEN"], """
SELECT request_id, asked, n, model, item_idx, score,
       row_number() OVER (PARTITION BY request_id, model ORDER BY round(score, 9) DESC, item_idx) AS rank
FROM (
  SELECT r.request_id, r.model AS asked, r.n, r.user_idx, r.exclude_seen, r.b_item, 'cbf' AS model, IP.item_idx,
         coalesce(c.cos, 0) + 0.05 * IP.pop AS score
  FROM RQ r CROSS JOIN IPOP IP
  LEFT JOIN (SELECT p.request_id, v.item_idx, sum(p.value * v.value) AS cos
             FROM RQP p JOIN IV v ON v.feature = p.feature GROUP BY p.request_id, v.item_idx) c
    ON c.request_id = r.request_id AND c.item_idx = IP.item_idx WHERE r.model IN ('cbf', 'hybrid')
  UNION ALL
  SELECT r.request_id, r.model, r.n, r.user_idx, r.exclude_seen, r.b_item, 'cf', IB.item_idx,
         coalesce((SELECT mu FROM MU) + UB.user_bias, 0) + IB.item_bias + 0.5 * IB.pop_prior
  FROM RQ r CROSS JOIN IB LEFT JOIN UB ON UB.user_idx = r.user_idx WHERE r.model IN ('cf', 'hybrid')
  UNION ALL
  SELECT r.request_id, r.model, r.n, r.user_idx, r.exclude_seen, r.b_item, 'ncf', IB.item_idx, IB.pop_prior
  FROM RQ r CROSS JOIN IB WHERE r.model IN ('ncf', 'hybrid')) x
WHERE item_idx IS DISTINCT FROM b_item
  AND NOT (exclude_seen AND EXISTS (SELECT 1 FROM CSEEN s WHERE s.user_idx = x.user_idx AND s.item_idx = x.item_idx))
QUALIFY rank <= CASE WHEN asked = 'hybrid' THEN greatest(200, 5 * n) ELSE n END"""),
    "CTXR": (["ITEMS", "IF", "FSUP", "FTB", "GTB"], """
SELECT t.hour, t.dow, ITEMS.item_idx,
       coalesce(f.ctx, (coalesce(gh.bias, 0) + coalesce(gd.bias, 0)) / 2) AS ctx
FROM ITEMS CROSS JOIN (SELECT h AS hour, d AS dow FROM range(0, 24) a(h), range(0, 7) b(d)) t
LEFT JOIN GTB gh ON gh.kind = 'hour' AND gh.key = t.hour LEFT JOIN GTB gd ON gd.kind = 'dow' AND gd.key = t.dow
LEFT JOIN (
  SELECT t.hour, t.dow, IF.item_idx, avg((coalesce(h.bias, 0) + coalesce(d.bias, 0)) / 2) AS ctx
  FROM IF JOIN FSUP ON IF.feature = FSUP.feature
  CROSS JOIN (SELECT h AS hour, d AS dow FROM range(0, 24) a(h), range(0, 7) b(d)) t
  LEFT JOIN FTB h ON h.feature = IF.feature AND h.kind = 'hour' AND h.key = t.hour
  LEFT JOIN FTB d ON d.feature = IF.feature AND d.kind = 'dow' AND d.key = t.dow
  GROUP BY t.hour, t.dow, IF.item_idx) f ON f.item_idx = ITEMS.item_idx AND f.hour = t.hour AND f.dow = t.dow"""),
    "RQH": (["RQ", "RQS", "CTXR"], """
SELECT request_id, item_idx, score,
       row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_idx) AS rank
FROM (
  SELECT w.request_id, w.item_idx,
         CAST(0.3 AS DOUBLE) * coalesce(n_0, 0) + CAST(0.3 AS DOUBLE) * coalesce(n_1, 0)
         + CAST(0.4 AS DOUBLE) * coalesce(n_2, 0) + CAST(0.15 AS DOUBLE) * coalesce(c.ctx, 0) AS score
  FROM (SELECT request_id, item_idx, max(CASE WHEN model = 'cf' THEN norm END) AS n_0,
               max(CASE WHEN model = 'cbf' THEN norm END) AS n_1, max(CASE WHEN model = 'ncf' THEN norm END) AS n_2
        FROM (SELECT *, CASE WHEN mx = mn THEN 0.5 ELSE (score - mn) / (mx - mn) END AS norm
              FROM (SELECT *, min(score) OVER (PARTITION BY request_id, model) AS mn,
                           max(score) OVER (PARTITION BY request_id, model) AS mx FROM RQS WHERE asked = 'hybrid'))
        GROUP BY request_id, item_idx) w
  JOIN RQ ON RQ.request_id = w.request_id
  LEFT JOIN CTXR c ON c.item_idx = w.item_idx AND c.hour = RQ.hour AND c.dow = RQ.dow)"""),
    # ── validation / preparation ──
    "DR0": (["R"], """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
       CASE WHEN _key % 97 = 0 THEN 'bad' ELSE CAST(rating AS VARCHAR) END AS rating,
       CASE WHEN _key % 101 = 0 THEN NULL ELSE CAST("timestamp" AS VARCHAR) END AS "timestamp",
       CASE WHEN _key % 107 = 0 THEN '-1' ELSE CAST(view_time_sec AS VARCHAR) END AS view_time_sec,
       CAST(liked AS VARCHAR) AS liked,
       CASE WHEN _key % 103 = 0 THEN '2' ELSE CAST(add_to_cart AS VARCHAR) END AS add_to_cart,
       CAST(ordered AS VARCHAR) AS ordered, _key
FROM R"""),
    "DR": (["DR0"], "SELECT * FROM DR0 UNION ALL SELECT * FROM DR0 WHERE _key % 109 = 0"),
    "DITEMS": (["PART"], "SELECT * FROM PART WHERE item_id % 50 <> 0"),
    # ── streaming (fixture E) ──
    "DV": (["IM", "FEAT", "IV"], """
SELECT IM.item_id, list(coalesce(IV.value, 0.0) ORDER BY FEAT.feature_pos) AS vec
FROM IM CROSS JOIN FEAT
LEFT JOIN IV ON IV.item_idx = IM.item_idx AND IV.feature = FEAT.feature
WHERE IM.item_idx IN (SELECT item_idx FROM IV) GROUP BY IM.item_id"""),
    "BP": (["UM", "FEAT", "PROF"], """
SELECT UM.user_id, list(coalesce(PROF.value, 0.0) ORDER BY FEAT.feature_pos) AS base
FROM UM CROSS JOIN FEAT
LEFT JOIN PROF ON PROF.user_idx = UM.user_idx AND PROF.feature = FEAT.feature
WHERE UM.user_idx IN (SELECT user_idx FROM PROF) GROUP BY UM.user_id"""),
    "EVX": (["ENG", "DV"], """
SELECT e.user_id, e.event_id,
       row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_time, e.event_id) AS rn,
       dv.vec,
       CASE WHEN dv.vec IS NULL THEN 0.0
            ELSE least(0.6, 0.2 * (e.effective_rating / 5.0) * greatest(e.engagement, 0.1)) END
         AS alpha
FROM ENG e LEFT JOIN DV dv ON dv.item_id = e.item_id"""),
    # ── context scorer ──
    "CMU": (["TR"], "SELECT avg(rating) AS mu FROM TR"),
    "GTB": (["TR", "CMU"], """
SELECT 'hour' AS kind, hour AS key, avg(rating) - (SELECT mu FROM CMU) AS bias
FROM TR GROUP BY hour
UNION ALL
SELECT 'dow' AS kind, day_of_week AS key, avg(rating) - (SELECT mu FROM CMU) AS bias
FROM TR GROUP BY day_of_week"""),
    "TRF": (["TR", "IF"], """
SELECT TR.rating, TR.hour, TR.day_of_week, IF.feature FROM TR JOIN IF USING (item_idx)"""),
    "FSUP": (["TRF"], "SELECT feature FROM TRF GROUP BY feature HAVING count(*) >= 10"),
    "FTB": (["TRF", "FSUP", "CMU"], """
SELECT feature, 'hour' AS kind, hour AS key, avg(rating) - (SELECT mu FROM CMU) AS bias
FROM TRF WHERE feature IN (SELECT feature FROM FSUP) GROUP BY feature, hour
UNION ALL
SELECT feature, 'dow' AS kind, day_of_week AS key, avg(rating) - (SELECT mu FROM CMU) AS bias
FROM TRF WHERE feature IN (SELECT feature FROM FSUP) GROUP BY feature, day_of_week"""),
    "CTX": (["ITEMS", "IF", "FSUP", "FTB", "GTB"], """
SELECT ITEMS.item_idx,
       coalesce(f.ctx, (coalesce((SELECT bias FROM GTB WHERE kind = 'hour' AND key = 12), 0)
                       + coalesce((SELECT bias FROM GTB WHERE kind = 'dow' AND key = 2), 0)) / 2)
         AS ctx
FROM ITEMS LEFT JOIN (
  SELECT IF.item_idx, avg((coalesce(h.bias, 0) + coalesce(d.bias, 0)) / 2) AS ctx
  FROM IF JOIN FSUP ON IF.feature = FSUP.feature
  LEFT JOIN FTB h ON h.feature = IF.feature AND h.kind = 'hour' AND h.key = 12
  LEFT JOIN FTB d ON d.feature = IF.feature AND d.kind = 'dow' AND d.key = 2
  GROUP BY IF.item_idx) f ON f.item_idx = ITEMS.item_idx"""),
}


def _order(needs: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str):
        if name in out:
            return
        for dep in CTES[name][0]:
            visit(dep)
        out.append(name)

    for n in needs:
        visit(n)
    return out


def sql(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the needed CTEs (plus ``extra`` ones, appended in order) then ``body``."""
    parts = [f"{name} AS ({CTES[name][1].strip()})" for name in _order(needs)]
    for name, text in (extra or {}).items():
        parts.append(f"{name} AS ({text.strip()})")
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
