"""The working views once more, in plain SQL, for the oracle side only."""

VIEWS: dict[str, str] = {
    "px": """
        SELECT label AS session, vec_id AS frame, CAST((i - 1) // 8 AS INTEGER) AS y,
               CAST((i - 1) % 8 AS INTEGER) AS x, CAST(e AS DOUBLE) AS v
        FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i
              FROM embeddings)""",
    "frank": "SELECT label AS session, vec_id AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rk FROM embeddings",
    "px2": """
        SELECT p.session, p.frame AS parent, c.frame AS candidate, p.y, p.x, p.v AS pv, c.v AS cv
        FROM frank a JOIN frank b ON a.session = b.session AND b.rk = a.rk + 1
        JOIN px p ON p.session = a.session AND p.frame = a.frame
        JOIN px c ON c.session = b.session AND c.frame = b.frame AND c.y = p.y AND c.x = p.x""",
    "rgb": """
        SELECT p.session, rk // 3 AS img, y, x,
               max(CASE WHEN rk % 3 = 0 THEN v END) + 0.5 AS r, max(CASE WHEN rk % 3 = 1 THEN v END) + 0.5 AS g,
               max(CASE WHEN rk % 3 = 2 THEN v END) + 0.5 AS b
        FROM px p JOIN frank f ON p.session = f.session AND p.frame = f.frame
        GROUP BY 1, 2, 3, 4 HAVING count(*) = 3""",
    "rgb_long": """
        SELECT session, img, y, x, 'r' AS channel, r AS v FROM rgb
        UNION ALL SELECT session, img, y, x, 'g', g FROM rgb
        UNION ALL SELECT session, img, y, x, 'b', b FROM rgb""",
    "rgb2": """
        SELECT a.*, c.r AS cr, c.g AS cg, c.b AS cb FROM rgb a
        JOIN rgb c ON c.session = a.session AND c.img = a.img + 1 AND c.y = a.y AND c.x = a.x""",
    "meas": """
        SELECT l_orderkey AS frame, l_linenumber AS line, l_returnflag AS layer, l_linestatus AS profile,
               l_quantity / 10 AS fwhmx, l_quantity / 10 * (1 - l_discount) AS fwhmy,
               l_extendedprice AS flux, l_partkey AS star, l_suppkey AS panel, l_tax AS tax, l_shipdate AS ts
        FROM lineitem""",
    "frames": """
        SELECT o_orderkey AS frame, o_orderpriority AS session, o_orderstatus AS filter, o_custkey AS target,
               o_totalprice / 1000 AS background, o_orderdate AS ts, nstars, fwhm, roundness,
               fwhm * (1 + 1.0::DOUBLE / nstars) AS wfwhm
        FROM orders JOIN (SELECT frame, count(*) AS nstars, median(fwhmx) AS fwhm, avg(fwhmy / fwhmx) AS roundness
                          FROM meas GROUP BY frame) ON o_orderkey = frame""",
    "stars_a": """
        SELECT p_partkey AS id, p_type AS layer, p_brand AS brand,
               p_partkey % 50 + (p_partkey % 7) * 0.1::DOUBLE AS x,
               p_partkey // 50 + (p_partkey % 5) * 0.1::DOUBLE AS y,
               p_size / 10.0::DOUBLE AS fwhm, p_size >= 48 AS sat, p_retailprice AS flux
        FROM part""",
    "stars_b": """
        SELECT id + 100000 AS id, layer, brand, x + (id % 4) * 0.25::DOUBLE AS x, y,
               fwhm * 1.1::DOUBLE AS fwhm, sat, flux * 0.97::DOUBLE AS flux
        FROM stars_a WHERE id % 9 <> 0""",
    "light": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS gain, c_acctbal AS temp, c_mktsegment AS filter FROM customer",
    "master": """
        SELECT s_suppkey AS mid, s_name AS mname, s_nationkey AS gain, s_acctbal AS temp,
               CASE s_suppkey % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'flat' ELSE 'bias' END AS kind,
               CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS filter
        FROM supplier""",
    "panels": """
        SELECT s_suppkey AS id, s_nationkey AS target,
               (s_suppkey * 37.0::DOUBLE + s_acctbal / 100) - 360 * floor((s_suppkey * 37.0::DOUBLE + s_acctbal / 100) / 360) AS ra,
               (s_suppkey % 61) * 2.0::DOUBLE - 60 AS dec
        FROM supplier""",
    "ev": """
        SELECT event_id AS id, ts, user_id AS target, event_type AS kind, value, props,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "labelled": """
        SELECT l.doc_id AS sample, source, lang, CAST(n_chars AS DOUBLE) AS value,
               CASE WHEN quality = 1 THEN 'healthy' ELSE 'degraded' END AS label, toxic = 1 AS flagged
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "ledger": "SELECT conv_id AS run, turn AS step, role AS actor, text FROM conversations",
}
