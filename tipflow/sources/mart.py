"""Domain tables derived from the driver's TPC-H-style parquet tables.

The reference keeps its data in PostgreSQL tables (tenants, collaborators,
batches, credits, invoices, redemptions, ...).  The test data is a generic
star schema, so each domain table is *derived* from it by a mapping that
only shapes rows into the domain schema; no query logic lives here.

Each mapping is one SQL statement written in the subset of SQL that both
Spark SQL and DuckDB accept, so the DuckDB oracle reads exactly the same
domain rows as the Spark jobs.  In Spark the ``{name}`` placeholders are
bound to DataFrames through ``spark.sql(sql, **frames)``; for DuckDB they
become CTE names (see :func:`duckdb_prelude`).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the reference: status ids and labels (constants.js).
STATUS_ROWS = "(1, 'ATIVO'), (2, 'BLOQUEADO'), (3, 'CANCELADO')"

_SEGMENT_NO = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
  WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"""

# a tenant's month has more batches, and each batch more credits, the more orders there are
_BATCH_OF_ORDER = """CAST(c_nationkey AS BIGINT) * 1000
  + (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1
  + CAST(floor(sqrt(o_orderkey) / 24) AS BIGINT) * 1000001"""

# name -> (sql, driver tables used, domain tables used)
MART: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "tenant": ("""
SELECT CAST(n_nationkey AS BIGINT) AS cli_id,
       n_name AS trade_name,
       n_name || ' SERVICOS LTDA' AS legal_name,
       lpad(CAST(n_nationkey % 23 + 1 AS STRING), 14, '0') AS cnpj,
       CASE WHEN n_nationkey % 10 = 9 THEN 2 ELSE 1 END AS sit_id,
       CASE WHEN n_nationkey % 12 = 11 THEN NULL
            ELSE CAST(n_nationkey % 11 AS DECIMAL(9,4)) END AS fee_rate,
       CASE WHEN n_nationkey % 3 = 0 THEN 'A' WHEN n_nationkey % 3 = 1 THEN 'D'
            WHEN n_nationkey % 6 = 2 THEN '' ELSE NULL END AS fee_type,
       CASE WHEN n_nationkey % 8 = 7 THEN NULL
            ELSE CAST(100 + 10 * n_nationkey AS DECIMAL(18,2)) END AS pix_limit,
       CAST(DATE '2019-01-01' + CAST(n_nationkey AS INTEGER) AS TIMESTAMP) AS created_at
FROM {nation}""", ("nation",), ()),

    "collaborator": (f"""
SELECT usr_id, usr_name, cli_id,
       CASE WHEN usr_id % 2 = 1
            THEN substr(p, 1, 3) || '.' || substr(p, 4, 3) || '.' || substr(p, 7, 3) || '-' || substr(p, 10, 2)
            ELSE p END AS cpf,
       lower(replace(usr_name, '#', '.')) || '@mail.test' AS email,
       '119' || lpad(CAST(usr_id AS STRING), 8, '0') AS phone,
       CASE WHEN usr_id % 9 = 0 THEN NULL
            ELSE DATE '1960-01-01' + CAST(usr_id * 37 % 15000 AS INTEGER) END AS birth_date,
       CASE WHEN usr_id % 9 = 0 THEN DATE '1970-01-01' + CAST(usr_id % 9000 AS INTEGER)
            ELSE NULL END AS birth_date_legacy,
       CASE WHEN usr_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
       CASE WHEN acctbal < 0 THEN 2 ELSE 1 END AS sit_id,
       CASE WHEN usr_id % 4 = 0 THEN NULL ELSE cli_id * 5 + seg END AS set_id,
       CAST(DATE '2020-01-01' + CAST(usr_id % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
       usr_id % 2 = 0 AS closed_arrangement,
       usr_id % 3 = 0 AS open_arrangement,
       CASE WHEN usr_id % 5 = 0 THEN NULL ELSE CAST(abs(acctbal) AS DECIMAL(18,2)) END AS day_value,
       CASE WHEN usr_id % 7 = 0 THEN NULL ELSE CAST(floor(abs(acctbal)) AS DECIMAL(18,2)) END AS night_value
FROM (SELECT c_custkey AS usr_id, c_name AS usr_name, CAST(c_nationkey AS BIGINT) AS cli_id,
             c_acctbal AS acctbal, {_SEGMENT_NO} AS seg,
             lpad(CAST(c_custkey AS STRING), 11, '0') AS p
      FROM {{customer}}) AS c""", ("customer",), ()),

    # the same people under Portuguese names, in both cases
    "collaborator_pt": ("""
SELECT cli_id, usr_id,
       CASE usr_id % 12 WHEN 0 THEN 'Álvaro' WHEN 1 THEN 'alvaro' WHEN 2 THEN 'Ana' WHEN 3 THEN 'Âmbar' WHEN 4 THEN 'Érica'
            WHEN 5 THEN 'erica' WHEN 6 THEN 'Estêvão' WHEN 7 THEN 'Estevao' WHEN 8 THEN 'Conceição' WHEN 9 THEN 'conceicao'
            WHEN 10 THEN 'Zoé' ELSE 'Ünder' END
       || CASE WHEN usr_id % 5 = 0 THEN '' WHEN usr_id % 5 = 1 THEN ' ' ELSE '-' END
       || CASE usr_id % 7 WHEN 0 THEN 'Luís' WHEN 1 THEN 'luis' WHEN 2 THEN 'Sá' WHEN 3 THEN 'Sa' WHEN 4 THEN 'Assunção'
            WHEN 5 THEN 'Órfão' ELSE 'orfao' END AS usr_name
FROM {collaborator}""", (), ("collaborator",)),

    "batch": (f"""
SELECT batch_id, cli_id, min(min(o_orderdate)) OVER (PARTITION BY batch_id % 1000001) AS imported_at,
       'user' || CAST(batch_id % 5 AS STRING) AS created_by,
       CASE WHEN batch_id % 7 = 0 THEN 'C' WHEN batch_id % 7 = 1 THEN 'E' ELSE NULL END AS batch_status,
       'Remessa ' || CAST(batch_id AS STRING) AS title
FROM (SELECT CAST({_BATCH_OF_ORDER} AS BIGINT) AS batch_id,
             CAST(c_nationkey AS BIGINT) AS cli_id, o_orderdate
      FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey) AS b
GROUP BY batch_id, cli_id""", ("orders", "customer"), ()),

    "credit": (f"""
SELECT cre_id, usr_id, batch_id, cli_id, credit_value, credit_date, sit_id,
       CASE WHEN batch_id % 5 <> 0 THEN batch_id + 1000000 ELSE NULL END AS not_id,
       import_date, cpf, 201 AS product_id, 'user' || CAST(batch_id % 5 AS STRING) AS created_by
FROM (SELECT CAST(l_orderkey * 1000 + l_linenumber AS BIGINT) AS cre_id,
             o_custkey AS usr_id,
             CAST({_BATCH_OF_ORDER} AS BIGINT) AS batch_id,
             CAST(c_nationkey AS BIGINT) AS cli_id,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS credit_value,
             CAST(l_shipdate AS DATE) AS credit_date,
             CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sit_id,
             CAST(o_orderdate AS DATE) AS import_date,
             lpad(CAST(o_custkey AS STRING), 11, '0') AS cpf
      FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
                        JOIN {{customer}} ON c_custkey = o_custkey) AS x
WHERE batch_id % 17 <> 0""", ("lineitem", "orders", "customer"), ()),

    "invoice": ("""
SELECT not_id, cli_id, issue_date, due_date, gross_value,
       CAST(CASE WHEN fee_type = 'A' THEN gross_value + service_value ELSE gross_value END AS DECIMAL(18,2)) AS invoice_value,
       service_value,
       CAST(CASE WHEN fee_type = 'A' THEN gross_value ELSE gross_value - service_value END AS DECIMAL(18,2)) AS movement_value,
       CASE WHEN situation = 'BT'
            THEN CAST(CASE WHEN fee_type = 'A' THEN gross_value + service_value ELSE gross_value END AS DECIMAL(18,2))
            ELSE NULL END AS paid_value,
       CASE WHEN situation = 'BT' THEN due_date ELSE NULL END AS settled_on,
       situation,
       CASE WHEN batch_id % 6 = 5 THEN NULL ELSE 'ch' || CAST(not_id AS STRING) END AS charge_id,
       '34191' || lpad(CAST(not_id AS STRING), 42, '0') AS barcode,
       '34191.' || CAST(not_id AS STRING) AS barcode_line,
       '00020126' || CAST(not_id AS STRING) AS pix_qrcode,
       'https://pay.example/' || CAST(not_id AS STRING) || '.pdf' AS pdf_url,
       'https://pay.example/' || CAST(not_id AS STRING) || '.png' AS qrcode_url,
       charge_status,
       CASE WHEN batch_id % 6 = 5 THEN NULL ELSE imported_at + INTERVAL 12 DAY END AS status_updated_at,
       CASE WHEN situation = 'C' THEN issue_date + 20 ELSE NULL END AS cancelled_on,
       CASE WHEN situation = 'C' THEN 'admin' ELSE NULL END AS cancelled_by,
       CAST(1 AS BIGINT) AS ctb_id
FROM (SELECT g.batch_id, g.batch_id + 1000000 AS not_id, g.cli_id,
             CAST(b.imported_at AS DATE) AS issue_date,
             CAST(b.imported_at AS DATE) + 10 AS due_date,
             b.imported_at,
             g.gross_value,
             CAST(round(g.gross_value * coalesce(t.fee_rate, CAST(0 AS DECIMAL(9,4))) * 0.01, 2) AS DECIMAL(18,2)) AS service_value,
             t.fee_type,
             CASE WHEN g.batch_id % 11 = 0 THEN 'C' WHEN g.batch_id % 6 = 0 THEN 'BT' ELSE 'A' END AS situation,
             CASE WHEN g.batch_id % 6 = 0 THEN 'paid' WHEN g.batch_id % 6 = 1 THEN 'settled'
                  WHEN g.batch_id % 6 = 2 THEN 'waiting' WHEN g.batch_id % 6 = 3 THEN 'EXPIRED'
                  WHEN g.batch_id % 6 = 4 THEN 'canceled' ELSE NULL END AS charge_status
      FROM (SELECT batch_id, cli_id, CAST(sum(credit_value) AS DECIMAL(18,2)) AS gross_value
            FROM {credit} WHERE batch_id % 5 <> 0 GROUP BY batch_id, cli_id) AS g
      JOIN {batch} AS b ON b.batch_id = g.batch_id
      JOIN {tenant} AS t ON t.cli_id = g.cli_id) AS i""", (), ("credit", "batch", "tenant")),

    "redemption": ("""
SELECT event_id AS tra_id, ts - INTERVAL 25 YEAR AS tra_at, user_id AS usr_id,
       CAST(c_nationkey AS BIGINT) AS cli_id, CAST(value AS DECIMAL(18,2)) AS tra_value,
       CASE WHEN event_type IN ('purchase', 'signup') THEN event_id + 1 ELSE CAST(0 AS BIGINT) END AS authorization_id
FROM {events} JOIN {customer} ON c_custkey = user_id
WHERE event_type IN ('purchase', 'signup', 'error')""", ("events", "customer"), ()),

    "category": (f"""
SELECT DISTINCT CAST(c_nationkey AS BIGINT) * 5 + {_SEGMENT_NO} AS set_id,
       c_mktsegment AS set_name, CAST(c_nationkey AS BIGINT) AS cli_id
FROM {{customer}}""", ("customer",), ()),

    "collab_category": (f"""
SELECT c_custkey AS usr_id, CAST(c_nationkey AS BIGINT) * 5 + {_SEGMENT_NO} AS set_id
FROM {{customer}} WHERE c_custkey % 7 <> 0
UNION ALL
SELECT c_custkey AS usr_id, CAST(c_nationkey AS BIGINT) * 5 + {_SEGMENT_NO} % 5 + 1 AS set_id
FROM {{customer}} WHERE c_custkey % 3 = 0""", ("customer",), ()),

    "schedule": ("""
SELECT c_custkey AS sched_id, c_custkey AS usr_id FROM {customer} WHERE c_custkey % 10 = 0""",
                 ("customer",), ()),

    "status_lookup": (f"""
SELECT CAST(sit_id AS INTEGER) AS sit_id, sit_name FROM (VALUES {STATUS_ROWS}) AS s(sit_id, sit_name)""",
                      (), ()),

    "portal_user": ("""
SELECT c_custkey AS usr_code,
       CASE WHEN c_custkey % 100 = 0 THEN 'User' ELSE 'user' END || CAST(c_custkey AS STRING) AS login,
       c_name AS user_name,
       'U' || CAST(c_custkey AS STRING) || '@Portal.test' AS email,
       '5511' || lpad(CAST(c_custkey AS STRING), 9, '9') AS phone,
       CASE WHEN c_custkey % 150 = 0 THEN 'S' ELSE 'N' END AS is_admin,
       CASE WHEN c_custkey % 200 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS legacy_cli_id,
       c_custkey % 100 <> 0 AS terms_accepted,
       CASE WHEN c_custkey % 100 <> 0 THEN TIMESTAMP '2021-03-01 10:00:00' ELSE NULL END AS terms_accepted_at,
       CASE WHEN c_custkey % 250 = 0 THEN 'N' ELSE 'S' END AS can_access,
       CASE WHEN c_custkey % 3 = 0 THEN 'D' WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'N' END AS pwd_expiry_type,
       CAST(90 AS INTEGER) AS pwd_days,
       DATE '1999-06-01' + CAST(c_custkey % 300 AS INTEGER) AS pwd_start,
       DATE '1999-09-01' + CAST(c_custkey % 200 AS INTEGER) AS pwd_until,
       'hash' || CAST(c_custkey AS STRING) AS pwd_hash
FROM {customer}""", ("customer",), ()),

    "user_role": ("""
SELECT c_custkey AS usr_code, CAST((c_nationkey + 0) % 25 AS BIGINT) AS cli_id
FROM {customer} WHERE c_custkey % 100 <> 0
UNION ALL
SELECT c_custkey AS usr_code, CAST((c_nationkey + 1) % 25 AS BIGINT) AS cli_id
FROM {customer} WHERE c_custkey % 100 <> 0 AND c_custkey % 3 >= 1
UNION ALL
SELECT c_custkey AS usr_code, CAST((c_nationkey + 2) % 25 AS BIGINT) AS cli_id
FROM {customer} WHERE c_custkey % 100 <> 0 AND c_custkey % 3 = 2""",
                  ("customer",), ()),

    "status_feed": ("""
SELECT 1000000 + user_id AS not_id,
       CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'view' THEN 'waiting' WHEN 'click' THEN 'active'
                       WHEN 'error' THEN 'expired' ELSE 'canceled' END AS new_status,
       ts AS changed_at, event_id AS seq
FROM {events}""", ("events",), ()),

    "request_log": ("""
SELECT event_id AS req_id, CASE WHEN event_id % 6 = 0 THEN CAST(0 AS BIGINT) ELSE user_id END AS client_id,
       CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-01-05 10:00:30' ELSE ts END AS req_at,
       CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'reset' ELSE 'api' END AS route,
       user_id AS usr_code,
       CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id % 25 AS BIGINT) END AS asked_cli_id,
       CASE WHEN event_type = 'view' THEN 1000000 + user_id ELSE NULL END AS asked_not_id
FROM {events}""", ("events",), ()),

    "credit_sheet": ("""
SELECT CAST(c_nationkey AS BIGINT) AS cli_id, c_custkey + 2 AS line,
       CASE WHEN c_custkey % 13 = 1 THEN '' WHEN c_custkey % 13 = 9 THEN NULL
            WHEN c_custkey % 13 = 10 THEN '  ' || lower(c_name) || '  ' ELSE c_name END AS nome,
       CASE WHEN c_custkey % 13 = 2 THEN substr(lpad(CAST(c_custkey AS STRING), 11, '0'), 1, 8) || '12345'
            WHEN c_custkey % 13 = 11 THEN CAST(c_custkey AS STRING)
            WHEN c_custkey % 2 = 1 THEN lpad(CAST(c_custkey AS STRING), 11, '0')
            ELSE substr(lpad(CAST(c_custkey AS STRING), 11, '0'), 1, 3) || '.' || substr(lpad(CAST(c_custkey AS STRING), 11, '0'), 4, 3) || '.'
                 || substr(lpad(CAST(c_custkey AS STRING), 11, '0'), 7, 3) || '-' || substr(lpad(CAST(c_custkey AS STRING), 11, '0'), 10, 2) END AS cpf,
       CASE WHEN c_custkey % 13 = 3 THEN '0' WHEN c_custkey % 13 = 4 THEN '12abc'
            WHEN c_custkey % 13 = 5 THEN '-5' WHEN c_custkey % 13 = 6 THEN '2000000'
            WHEN c_custkey % 13 = 7 THEN '1.234,56' WHEN c_custkey % 13 = 12 THEN 'abc'
            ELSE CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS STRING) END AS valor,
       CASE WHEN c_custkey % 13 = 8 THEN NULL WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) || ' noite'
            ELSE c_mktsegment END AS categoria
FROM {customer}""", ("customer",), ()),

    "collab_sheet": ("""
SELECT CAST(c_nationkey AS BIGINT) AS cli_id, c_custkey + 2 AS line,
       CASE WHEN c_custkey % 11 = 1 THEN '' ELSE c_name END AS nome,
       CASE WHEN c_custkey % 11 = 7 AND c_custkey > 0 THEN lpad(CAST(c_custkey - 1 AS STRING), 11, '0')
            WHEN c_custkey % 11 = 2 THEN CAST(c_custkey AS STRING)
            ELSE lpad(CAST(c_custkey AS STRING), 11, '0') END AS cpf,
       CASE WHEN c_custkey % 4 = 1 THEN CAST(20000 + c_custkey * 7 % 9000 AS STRING)
            WHEN c_custkey % 4 = 2 THEN lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/'
                 || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '/' || CAST(1950 + c_custkey % 50 AS STRING)
            WHEN c_custkey % 4 = 3 THEN CAST(c_custkey % 28 + 1 AS STRING) || '/' || CAST(c_custkey % 12 + 1 AS STRING)
                 || '/' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')
            WHEN c_custkey % 44 = 0 THEN '31/02/1990'
            ELSE NULL END AS nascimento,
       CASE WHEN c_custkey % 11 = 5 THEN 'X' WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'M' END AS sexo,
       CASE WHEN c_custkey % 11 = 6 THEN 'sem-arroba' ELSE lower(replace(c_name, '#', '.')) || '@Mail.test' END AS email,
       CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE '(11) 9' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS celular
FROM {customer}""", ("customer",), ()),

    "cancel_request": ("""
SELECT batch_id, cli_id, 'operador.' || created_by || '.backoffice' AS actor
FROM {batch} WHERE batch_id % 4 = 0""", (), ("batch",)),

    "charge_reply": ("""
SELECT 1000000 + user_id AS not_id, ts AS fetched_at, event_id AS seq,
       CASE WHEN event_type = 'error' THEN '{{"error": "not found"}}'
            ELSE '{{"data": {{"charge_id": ' || CAST(event_id AS STRING) || ', "status": "'
                 || CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'view' THEN 'waiting'
                                    WHEN 'click' THEN 'active' ELSE 'canceled' END
                 || '", "payment": {{"banking_billet": {{"barcode": "34191.' || lpad(CAST(event_id AS STRING), 5, '0')
                 || ' 00000.000000 ' || CAST(user_id AS STRING) || '"'
                 || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "pix": {{"qrcode": "000201' || CAST(event_id AS STRING) || '"}}' END
                 || CASE WHEN event_id % 2 = 0 THEN ', "pdf": {{"charge": "https://pay.example/c' || CAST(event_id AS STRING) || '.pdf"}}'
                         ELSE ', "billet_link": "https://pay.example/b' || CAST(event_id AS STRING) || '"' END
                 || '}}}}}}}}' END AS reply
FROM {events}""", ("events",), ()),
    "category_change": ("""
SELECT c_custkey AS usr_id, k.set_id
FROM {customer} JOIN {category} AS k ON k.cli_id = CAST(c_nationkey AS BIGINT)
WHERE c_custkey % 6 = 0 AND k.set_name IN ('AUTOMOBILE', 'MACHINERY')""", ("customer",), ("category",)),

    "category_delete": ("""
SELECT set_id, cli_id FROM {category} WHERE set_name = 'FURNITURE' AND cli_id % 4 = 0""", (), ("category",)),

    "collab_change": ("""
SELECT usr_id, cli_id,
       CASE WHEN usr_id % 8 = 0 THEN 'status' ELSE 'update' END AS op,
       CASE WHEN usr_id % 8 = 0 THEN 3 - sit_id ELSE NULL END AS new_sit_id,
       CASE WHEN usr_id % 8 = 4 THEN '  ' || lower(usr_name) || ' ' ELSE NULL END AS new_name,
       CASE WHEN usr_id % 8 = 4 AND usr_id % 40 <> 4 THEN upper(email) ELSE NULL END AS new_email,
       CASE WHEN usr_id % 32 = 12 THEN '111.111.111-11' WHEN usr_id % 64 = 20 THEN NULL ELSE '529.982.247-25' END AS new_cpf,
       CASE WHEN usr_id % 80 = 4 THEN '2999-01-01' WHEN usr_id % 48 = 4 THEN NULL
            ELSE '1990-02-' || lpad(CAST(usr_id % 28 + 1 AS STRING), 2, '0') END AS new_birth,
       CASE WHEN usr_id % 16 = 4 THEN '' ELSE 'F' END AS new_sex,
       CASE WHEN usr_id % 24 = 4 THEN CAST((cli_id + 1) % 25 AS BIGINT) ELSE NULL END AS new_cli_id,
       CASE WHEN usr_id % 8 = 4 THEN '(11) 9' || substr(phone, 4, 8) ELSE NULL END AS new_phone
FROM {collaborator} WHERE usr_id % 4 = 0""", (), ("collaborator",)),

    "limit_change": ("""
SELECT cli_id, pix_limit AS old_limit,
       CASE WHEN cli_id % 5 = 0 THEN pix_limit + 50 WHEN cli_id % 5 = 1 THEN NULL
            ELSE CAST(pix_limit - 60 AS DECIMAL(18,2)) END AS new_limit
FROM {tenant}""", (), ("tenant",)),

    "limit_feed": ("""
SELECT CAST(user_id % 25 AS BIGINT) AS cli_id,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE CAST(40 + 10 * (user_id % 25) + event_id * 37 % 120 AS DECIMAL(18,2)) END AS new_limit,
       ts AS changed_at, event_id AS seq
FROM {events} WHERE event_type = 'signup'""", ("events",), ()),

    "login_attempt": ("""
SELECT event_id AS attempt_id,
       CASE WHEN user_id % 2 = 0 THEN 'USER' || CAST(user_id AS STRING)
            ELSE 'u' || CAST(user_id AS STRING) || '@portal.TEST' END AS identifier,
       ts AS attempted_at
FROM {events} WHERE event_type = 'signup'""", ("events",), ()),
    "credit_request": ("""
SELECT request_id, cli_id, line_no,
       CASE WHEN request_id % 4 = 1 AND line_no % 5 = 0 THEN NULL ELSE line_no END AS ref_id,
       CASE WHEN line_no % 53 = 0 THEN '123'
            WHEN line_no % 2 = 1 THEN substr(p, 1, 3) || '.' || substr(p, 4, 3) || '.' || substr(p, 7, 3) || '-' || substr(p, 10, 2)
            ELSE p END AS cpf,
       nome,
       CASE WHEN line_no % 97 = 5 THEN '0' WHEN line_no % 89 = 7 THEN '2000000' ELSE valor END AS valor,
       CASE WHEN request_id % 5 = 0
            THEN '   Gorjeta da semana ' || CAST(request_id AS STRING) || ' - turno da noite e fim de semana   '
            ELSE 'Gorjeta ' || CAST(request_id AS STRING) END AS titulo,
       CASE WHEN request_id % 6 = 0 THEN NULL WHEN request_id % 6 = 1 THEN 'not-a-date'
            ELSE '1999-' || lpad(CAST(request_id % 12 + 1 AS STRING), 2, '0') || '-10' END AS data
FROM (SELECT CAST(c_nationkey AS BIGINT) * 100000000 + CAST(floor(c_custkey / 300) AS BIGINT) * 3 + c_custkey % 3 AS request_id, CAST(c_nationkey AS BIGINT) AS cli_id,
             c_custkey AS line_no, c_name AS nome, lpad(CAST(c_custkey AS STRING), 11, '0') AS p,
             CAST(CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) * 0.1 AS DECIMAL(18,2)) AS STRING) AS valor
      FROM {customer}) AS r""", ("customer",), ()),
    "collab_insert": ("""
SELECT ord, cli_id, nome, cpf, email, celular, nascimento, sexo
FROM (SELECT c_custkey AS ord,
             CASE WHEN c_custkey % 10 = 7 THEN CAST(c_nationkey AS BIGINT)
                  ELSE CAST((c_nationkey + 1) % 25 AS BIGINT) END AS cli_id,
             CASE WHEN c_custkey % 40 = 3 THEN ' ' ELSE '  ' || lower(c_name) || ' novo ' END AS nome,
             CASE WHEN c_custkey % 10 = 7 THEN lpad(CAST(c_custkey AS STRING), 11, '0')
                  WHEN c_custkey % 30 = 13 THEN '111.111.111-11'
                  ELSE b || CAST(d1 AS STRING) || CAST((CAST(substr(b || CAST(d1 AS STRING), 1, 1) AS INT) * 11 + CAST(substr(b || CAST(d1 AS STRING), 2, 1) AS INT) * 10 + CAST(substr(b || CAST(d1 AS STRING), 3, 1) AS INT) * 9 + CAST(substr(b || CAST(d1 AS STRING), 4, 1) AS INT) * 8 + CAST(substr(b || CAST(d1 AS STRING), 5, 1) AS INT) * 7 + CAST(substr(b || CAST(d1 AS STRING), 6, 1) AS INT) * 6 + CAST(substr(b || CAST(d1 AS STRING), 7, 1) AS INT) * 5 + CAST(substr(b || CAST(d1 AS STRING), 8, 1) AS INT) * 4 + CAST(substr(b || CAST(d1 AS STRING), 9, 1) AS INT) * 3 + CAST(substr(b || CAST(d1 AS STRING), 10, 1) AS INT) * 2) * 10 % 11 % 10 AS STRING) END AS cpf,
             CASE WHEN c_custkey % 20 = 3 THEN 'sem-arroba' ELSE ' Novo' || CAST(c_custkey AS STRING) || '@Mail.test ' END AS email,
             '(21) 9' || lpad(CAST(c_custkey AS STRING), 8, '0') AS celular,
             CASE WHEN c_custkey % 25 = 3 THEN '2999-01-01' ELSE '1985-05-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') END AS nascimento,
             CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo
      FROM (SELECT c_custkey, c_nationkey, c_name, b, (CAST(substr(b, 1, 1) AS INT) * 10 + CAST(substr(b, 2, 1) AS INT) * 9 + CAST(substr(b, 3, 1) AS INT) * 8 + CAST(substr(b, 4, 1) AS INT) * 7 + CAST(substr(b, 5, 1) AS INT) * 6 + CAST(substr(b, 6, 1) AS INT) * 5 + CAST(substr(b, 7, 1) AS INT) * 4 + CAST(substr(b, 8, 1) AS INT) * 3 + CAST(substr(b, 9, 1) AS INT) * 2) * 10 % 11 % 10 AS d1
            FROM (SELECT c_custkey, c_nationkey, c_name,
                         lpad(CAST((c_custkey % 1000 * 7919 + 12345) % 1000000000 AS STRING), 9, '0') AS b
                  FROM {customer} WHERE c_custkey % 10 IN (3, 7)) AS x) AS y
      UNION ALL
      SELECT c_custkey + 1000000000 AS ord, CAST((c_nationkey + 1) % 25 AS BIGINT) AS cli_id,
             c_name AS nome, b || CAST(d1 AS STRING) || CAST((CAST(substr(b || CAST(d1 AS STRING), 1, 1) AS INT) * 11 + CAST(substr(b || CAST(d1 AS STRING), 2, 1) AS INT) * 10 + CAST(substr(b || CAST(d1 AS STRING), 3, 1) AS INT) * 9 + CAST(substr(b || CAST(d1 AS STRING), 4, 1) AS INT) * 8 + CAST(substr(b || CAST(d1 AS STRING), 5, 1) AS INT) * 7 + CAST(substr(b || CAST(d1 AS STRING), 6, 1) AS INT) * 6 + CAST(substr(b || CAST(d1 AS STRING), 7, 1) AS INT) * 5 + CAST(substr(b || CAST(d1 AS STRING), 8, 1) AS INT) * 4 + CAST(substr(b || CAST(d1 AS STRING), 9, 1) AS INT) * 3 + CAST(substr(b || CAST(d1 AS STRING), 10, 1) AS INT) * 2) * 10 % 11 % 10 AS STRING) AS cpf,
             NULL AS email, NULL AS celular, NULL AS nascimento, NULL AS sexo
      FROM (SELECT c_custkey, c_nationkey, c_name, b, (CAST(substr(b, 1, 1) AS INT) * 10 + CAST(substr(b, 2, 1) AS INT) * 9 + CAST(substr(b, 3, 1) AS INT) * 8 + CAST(substr(b, 4, 1) AS INT) * 7 + CAST(substr(b, 5, 1) AS INT) * 6 + CAST(substr(b, 6, 1) AS INT) * 5 + CAST(substr(b, 7, 1) AS INT) * 4 + CAST(substr(b, 8, 1) AS INT) * 3 + CAST(substr(b, 9, 1) AS INT) * 2) * 10 % 11 % 10 AS d1
            FROM (SELECT c_custkey, c_nationkey, c_name,
                         lpad(CAST((c_custkey % 1000 * 7919 + 12345) % 1000000000 AS STRING), 9, '0') AS b
                  FROM {customer} WHERE c_custkey % 20 = 3) AS x) AS y) AS z""", ("customer",), ()),
}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _order(names) -> list[str]:
    """Names plus their domain dependencies, dependencies first."""
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in MART[n][2]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def duckdb_prelude(names) -> str:
    """``WITH`` clause defining the given domain tables for the oracle."""
    parts = []
    for n in _order(names):
        sql, drivers, deps = MART[n]
        binds = {d: d for d in drivers} | {d: d for d in deps}
        parts.append(f"{n} AS ({sql.format(**binds)})")
    return "WITH " + ",\n".join(parts) + "\n"


class Mart:
    """Domain DataFrames for one data folder, built once per session.

    Each domain table is derived with ``spark.sql`` and, unless disabled
    (``TIPFLOW_MATERIALIZE=0``), written once as parquet under the shared
    checkpoint folder (``spark.checkpoint.dir``) and read back: the queries
    then scan stored domain tables with column pruning and filter pushdown,
    as they would scan the production tables, and the derivation does not
    repeat per query.  The path carries the application id, so a new
    session never reads another session's tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        if materialize is None:
            materialize = os.environ.get("TIPFLOW_MATERIALIZE", "1") != "0"
        self.materialize = materialize
        self._frames: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in MART:
            raise AttributeError(name)
        return self.table(name)

    def _store(self) -> str:
        from tipflow.session import app_id, checkpoint_dir
        app = re.sub(r"[^A-Za-z0-9_-]", "_", app_id(self.spark))
        src = re.sub(r"[^A-Za-z0-9_-]", "_", self.sf_dir)
        return f"{checkpoint_dir(self.spark).rstrip('/')}/tipflow-mart/{app}/{src}"

    def derive(self, name: str) -> DataFrame:
        """The domain table as a plan over the driver tables (no materialization)."""
        sql, drivers, deps = MART[name]
        binds = {d: self.driver(d) for d in drivers}
        binds.update({d: self.table(d) for d in deps})
        return self.spark.sql(sql, **binds)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            df = self.derive(name)
            if self.materialize:
                # plain parquet, no bucketing: a bucketed scan cannot split a bucket, so one hot
                # key (a batch holding a third of the credits) would become one task; the
                # shuffle path keeps partial aggregation and AQE skew splitting instead
                path = f"{self._store()}/{name}"
                df.write.mode("overwrite").parquet(path)
                df = self.spark.read.parquet(path)
            self._frames[name] = df
        return self._frames[name]


_CACHE: dict[tuple[str, str], Mart] = {}


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    from tipflow.session import app_id
    key = (app_id(spark), sf_dir.rstrip("/"))  # an application's tables are its own
    if key not in _CACHE:
        _CACHE[key] = Mart(spark, sf_dir)
    return _CACHE[key]
