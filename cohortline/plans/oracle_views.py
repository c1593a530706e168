"""SQL text of the study views over the test tables, and assembly of oracle statements."""

from __future__ import annotations

import re

from cohortline.sources.driver_views import CODEBOOK

_SOURCE = """CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN '1.IP'
            WHEN o_orderpriority LIKE '3%' THEN '2.AE' WHEN o_orderpriority LIKE '4%' THEN '3.SO' ELSE '4.GO' END"""

VIEWS = {
    "v_patients": """
SELECT c_custkey AS patient_id,
       CAST(16 + (c_custkey % 7) * 10 AS INTEGER) AS age,
       CASE WHEN c_custkey % 50 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS vaccinated,
       CASE WHEN c_custkey % 3 = 1 THEN 'BrandA' WHEN c_custkey % 3 = 2 THEN 'BrandB'
            WHEN c_custkey % 9 = 0 THEN 'BrandA' END AS brand_1st,
       CASE WHEN c_custkey % 40 = 1 THEN 'BrandB' WHEN c_custkey % 3 = 1 THEN 'BrandA'
            WHEN c_custkey % 3 = 2 THEN 'BrandB' END AS brand_2nd,
       CAST(DATE '1999-01-01' + CAST(c_custkey % 120 AS INTEGER) AS DATE) AS index_date,
       CAST(DATE '1999-01-22' + CAST(c_custkey % 120 + c_custkey % 10 AS INTEGER) AS DATE) AS index_date2,
       CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 9 = 0
            THEN CAST(DATE '1999-01-01' + CAST(c_custkey % 120 + CASE WHEN c_custkey % 9 = 0 THEN 200 ELSE 0 END AS INTEGER) AS DATE) END AS date_1st,
       CASE WHEN c_custkey % 3 <> 0
            THEN CAST(DATE '1999-01-22' + CAST(c_custkey % 120 + c_custkey % 10 AS INTEGER) AS DATE) END AS date_2nd,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(DATE '1999-01-15' + CAST(c_custkey % 700 AS INTEGER) AS DATE) END AS death_date
FROM customer""",
    "v_dx": f"""
SELECT o_custkey AS patient_id, l_orderkey * 10 + l_linenumber AS rec_id,
       CAST(l_shipdate AS DATE) AS date,
       lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS code,
       {_SOURCE} AS source,
       CASE WHEN l_linenumber <= 3 THEN 'P' WHEN l_linenumber = 4 THEN 'PS' ELSE 'S' END AS ranking
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_dx_hist": """
SELECT patient_id, rec_id, code, source, ranking, strftime(date, '%Y-%m') AS date_ym
FROM v_dx WHERE date < DATE '1996-01-01'""",
    "v_dx_recent": "SELECT * FROM v_dx WHERE date >= DATE '1996-01-01'",
    "v_rx_dense": """
SELECT o_custkey AS patient_id, l_orderkey * 10 + l_linenumber AS rec_id,
       CASE l_partkey % 8 WHEN 0 THEN 'ISON01' WHEN 1 THEN 'RIFA01' WHEN 2 THEN 'RIFI01' WHEN 3 THEN 'PYRA03'
            WHEN 4 THEN 'ETHA02' WHEN 5 THEN 'STRE01' WHEN 6 THEN 'RIFA05' ELSE 'rifa05' END AS item_cd,
       '5.1.9' AS bnf, CAST(l_quantity AS INTEGER) AS days, CAST(l_shipdate AS DATE) AS disp_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_rx": """
SELECT patient_id, rec_id, item_cd, days, disp_date,
       CASE WHEN rec_id % 97 < 2 THEN '5.1.9' ELSE '2.' || CAST(rec_id % 13 AS VARCHAR) END AS bnf
FROM v_rx_dense""",
    "v_enc": f"""
SELECT o_custkey AS patient_id, o_orderkey AS rec_id, CAST(o_orderdate AS DATE) AS date, {_SOURCE} AS source
FROM orders""",
    "v_lab": """
SELECT user_id AS patient_id, event_id AS rec_id, CAST(CAST(ts AS DATE) - 9000 AS DATE) AS date,
       CAST(210 + event_id % 10 AS VARCHAR) AS t_num,
       CASE WHEN event_type = 'error' THEN 'detected' ELSE 'not detected' END AS result
FROM events""",
    "v_codebook": "SELECT * FROM (VALUES " + ", ".join(f"('{r.name}','{r.regex}')" for r in CODEBOOK) + ") t(name, regex)",
    "v_cohort": """
SELECT * REPLACE (CAST(age - 1 AS INTEGER) AS age) FROM v_patients
WHERE NOT coalesce(death_date < index_date2, false) AND age - 1 >= 18""",
    "v_analysis": """
SELECT patient_id, age, sex, CASE WHEN vaccinated = 0 THEN 'None' WHEN brand_1st = brand_2nd THEN brand_1st END AS arm,
       index_date2, event_date, death_date, censor_date,
       CAST(date_diff('day', index_date2, censor_date) + 1 AS INTEGER) AS time,
       CAST(coalesce(event_date = censor_date, false) AS INTEGER) AS status,
       CAST(coalesce(death_date > index_date2, false) AS INTEGER) AS death,
       CAST(0.5 + (patient_id % 10) * 0.1 AS DOUBLE) AS w
FROM (SELECT *, least(study_end, event_date, death_date, crossover_date) AS censor_date
      FROM (SELECT p.*, ev.event_date, DATE '1999-12-31' AS study_end,
                   CASE WHEN vaccinated = 0 AND brand_1st IS NOT NULL THEN date_1st END AS crossover_date
            FROM v_patients p LEFT JOIN (
                SELECT p.patient_id, min(d.date) AS event_date FROM v_patients p JOIN v_dx d
                ON d.patient_id = p.patient_id AND d.date >= p.index_date2 AND regexp_matches(d.code, '^0[0-4]')
                GROUP BY 1) ev USING (patient_id)
            WHERE NOT coalesce(death_date < index_date2, false)))""",
}


def _needed(text: str) -> list[str]:
    """Views a statement refers to, with the views those refer to, in definition order."""
    found = set()
    queue = [text]
    while queue:
        part = queue.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", part):
                found.add(name)
                queue.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def oracle(body: str) -> str:
    """Prefix a statement with the views it uses."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(body))
    body = body.strip()
    if not views:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"
