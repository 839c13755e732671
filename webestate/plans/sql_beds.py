"""The derived inputs of beds.py once more, as SQL common table expressions."""

B2 = """b2 AS (
  SELECT event_id AS seq, 'obs-' || event_id AS observation_id, user_id AS portal_id,
    'https://p' || user_id || '.example.org/' || CASE WHEN event_type IN ('error','click') THEN '' ELSE event_type END AS requested_url,
    CASE WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'http://other.example.net/'
         WHEN event_type = 'click' AND event_id % 10 = 1 THEN 'http://p' || user_id || '.example.org/' END AS final_url,
    ts AS checked_at, CAST(1 + event_id % 3 AS BIGINT) AS attempt,
    CASE WHEN event_id % 25 = 0 THEN 'browser' ELSE 'http' END AS fetch_mode,
    CASE WHEN event_type = 'error' AND user_id % 10 IN (0,1,5,7,8) THEN NULL
         WHEN event_type = 'error' AND user_id % 10 = 2 THEN 503 WHEN event_type = 'error' AND user_id % 10 = 3 THEN 404
         WHEN event_type = 'error' AND user_id % 10 = 4 THEN 403 WHEN event_type = 'error' AND user_id % 10 = 6 THEN 401
         ELSE 200 END AS http_status,
    CASE WHEN event_type = 'error' THEN CASE user_id % 10 WHEN 0 THEN 'DNS_FAILURE' WHEN 1 THEN 'CONNECT_TIMEOUT'
      WHEN 2 THEN 'HTTP_SERVER_ERROR' WHEN 3 THEN 'HTTP_CLIENT_ERROR' WHEN 4 THEN 'HTTP_CLIENT_ERROR' WHEN 5 THEN 'AUTOMATION_BLOCKED'
      WHEN 6 THEN 'AUTH_REQUIRED' WHEN 7 THEN 'TLS_CERT_EXPIRED' WHEN 8 THEN 'TLS_HOST_MISMATCH' END END AS error_code,
    CASE WHEN event_id % 6 = 0 THEN 'application/pdf' ELSE 'text/HTML; charset=utf-8' END AS content_type
  FROM events WHERE event_type <> 'view')"""

SKIPS = """skips AS (
  SELECT user_id AS portal_id, CASE event_id % 4 WHEN 0 THEN 'robots_disallowed' WHEN 1 THEN 'maxPagesPerPortal reached'
    WHEN 2 THEN 'matches excluded route category "login"'
    ELSE 'hostname "x.example.net" is not a registered hostname for this portal' END AS reason
  FROM events WHERE event_type = 'view')"""

B3 = """b3 AS (
  SELECT l_suppkey AS portal_id, l_orderkey AS source_page, l_partkey % 50 AS destination,
    CASE l_returnflag WHEN 'R' THEN CASE WHEN l_suppkey % 10 IN (4,5,6,9) THEN 'pass'
       WHEN l_linenumber % 5 = 0 THEN 'not_assessable' ELSE 'fail' END
     WHEN 'A' THEN 'not_applicable' ELSE 'pass' END AS status,
    1 + l_linenumber % 3 AS attempts, l_shipdate AS checked_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linestatus
  FROM lineitem)"""

PORTALS = """portals AS (
  SELECT s_suppkey AS portal_id, s_name AS name, 'https://p' || s_suppkey || '.example.org/' AS canonical_url,
    'p' || s_suppkey || '.example.org' AS host,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS department,
    CASE s_suppkey % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'information' ELSE 'unknown' END AS portal_type,
    CASE WHEN r_regionkey <= 1 OR s_suppkey % 7 = 0 THEN 'verified' ELSE 'unverified' END AS official_status,
    r_regionkey, 'src-' || r_regionkey AS source_id, 'Supplier register ' || r_name AS source_name,
    'https://dir' || r_regionkey || '.example.org/list' AS source_url,
    CASE r_regionkey WHEN 0 THEN 'official_directory' WHEN 1 THEN 'official_page' ELSE 'manual_verified' END AS source_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ENTRY = """entry AS (SELECT b2.*, p.canonical_url FROM b2 JOIN portals p ON b2.portal_id = p.portal_id AND b2.requested_url = p.canonical_url)"""

B4 = """subs AS (
  SELECT o_orderkey AS submission_id, o_custkey AS portal_id, o_orderdate + to_minutes(o_orderkey % 1440) AS created_at,
    CASE o_orderkey % 3 WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS occurred_on,
    (['apply_for_scheme_or_benefit','check_application_or_case_status','download_or_view_document','make_a_payment','find_information',
      'register_a_complaint_or_grievance','renew_license_or_certificate','create_or_update_account','other'])[o_orderkey % 9 + 1] AS task_type,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'partially_completed' WHEN '3' THEN 'not_completed'
      WHEN '4' THEN 'information_only' ELSE 'other' END AS outcome,
    [th[o_orderkey % 13 + 1], th[o_orderkey % 7 + 1]] AS themes,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1 + o_orderkey % 5 AS INTEGER) END AS rating,
    o_orderkey % 10 <> 0 AS consent, 'Report  on order ' || (o_orderkey % 50) || ' ' AS free_text,
    CASE WHEN o_orderkey % 8 = 0 THEN 'kiosk' WHEN o_orderkey % 2 = 0 THEN 'mobile' END AS device_type,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 1440) + to_days(2) END AS moderated_at
  FROM orders, (SELECT ['availability','navigation','content_clarity','outdated_information','login_or_otp','form_or_validation',
    'payment','document_upload','mobile_usability','language','accessibility','support','other'] AS th) t)"""

B6 = """req AS (
  SELECT event_id AS request_id, user_id AS key, event_type AS portal_id, user_id % 3 AS task_type, ts AS created_at,
    'note ' || (event_id % 2) AS free_text, ts + to_hours(24) AS expires_at FROM events)"""

B1 = """cand AS (
  SELECT page_id AS seq, url AS raw_url, regexp_extract(url, '^(https?://[^/]+/[^/?#]+)', 1) AS url,
    nullif(CASE WHEN length(t) > 200 THEN left(t, 199) || '…' ELSE t END, '') AS name,
    CASE page_id % 4 WHEN 0 THEN 'dir' WHEN 1 THEN 'page' WHEN 2 THEN 'man' ELSE 'dir2' END AS source_id,
    CASE page_id % 4 WHEN 0 THEN 'official_directory' WHEN 1 THEN 'official_page' WHEN 2 THEN 'manual_verified' ELSE 'official_directory' END AS source_type,
    CASE WHEN page_id % 5 = 0 THEN ' ' ELSE 'DEPT_' || (page_id % 7) END AS department,
    regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS tag,
    CASE page_id % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'outbound_link' ELSE 'manual' END AS discovery_method
  FROM (SELECT *, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)),
canon AS (
  SELECT *, regexp_replace(url, '/$', '') AS normalized,
    CASE WHEN url LIKE 'http://m.%' THEN 'https' || substr(url, 5) ELSE url END AS canonical,
    regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM cand)"""

# Review bed.
B7 = """rf AS (
  SELECT doc_id AS finding_id, doc_id % 50 AS portal_id, rules[doc_id % 14 + 1] AS rule_id,
    CASE WHEN doc_id % 9 = 0 THEN 'possible_overlap' ELSE cats[doc_id % 14 + 1] END AS category,
    CASE n_chars % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'significant' ELSE 'advisory' END AS severity,
    CASE n_chars % 4 WHEN 0 THEN 'repair' WHEN 1 THEN 'manual_assessment' WHEN 2 THEN 'maintain' ELSE 'review_consolidation' END AS suggested_action,
    CASE WHEN doc_id % 9 = 0 AND doc_id % 27 <> 0 THEN 'cmp-' || (doc_id % 120) END AS comparison_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 100000) AS last_observed_at
  FROM documents, (SELECT ['availability.unavailable.v1','availability.server-error.v1','availability.not-found.v1','redirect.cross-domain.v1',
    'availability.automation-blocked.v1','availability.access-restricted.v1','broken_link.repeated-failure.v1','https.certificate-failure.v1',
    'https.no-tls-upgrade.v1','freshness.no-signal.v1','crawl_coverage.summary.v1','directory_mismatch.unavailable-destination.v1',
    'directory_mismatch.listed-vs-observed.v1','directory_mismatch.official-portal-not-listed.v1'] AS rules,
    ['availability','availability','availability','availability','availability','availability','broken_link','https','https','freshness',
     'crawl_coverage','directory_mismatch','directory_mismatch','directory_mismatch'] AS cats) r),
art AS (SELECT 'e' || doc_id || '-' || n AS artifact_id, doc_id, n, doc_id % 35 = 0 OR doc_id % 5 <> 0 AS reviewed, doc_id % 35 = 0 AS own_flag
  FROM documents, (SELECT unnest([1, 2]) AS n) WHERE NOT (doc_id % 17 = 0 AND n = 2)),
dec AS (SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id + 1000000 ELSE doc_id END AS finding_id,
    CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'publish' ELSE 'needs_more_evidence' END AS decision,
    CASE WHEN doc_id % 13 = 0 THEN 'advisory' END AS overridden_severity,
    CASE WHEN doc_id % 11 = 0 THEN 'review_retirement' END AS overridden_action FROM labels),
rp AS (SELECT DISTINCT doc_id % 50 AS portal_id, 'Portal ' || (doc_id % 50) AS name FROM documents WHERE doc_id % 50 <> 49),
refs AS (SELECT finding_id, 'e' || finding_id || '-' || n AS ref, n FROM rf, (SELECT unnest([1, 2]) AS n)),
cmp AS (SELECT 'cmp-' || s_suppkey AS comparison_id, CASE WHEN s_suppkey % 13 = 0 THEN 'run-0' ELSE 'run-1' END AS run_id,
    s_suppkey % 53 AS portal_a, (s_suppkey + 9) % 50 AS portal_b, CASE WHEN s_suppkey % 11 = 0 THEN 'draft' ELSE 'completed' END AS status,
    CASE s_suppkey % 3 WHEN 0 THEN 'possible_overlap' WHEN 1 THEN 'distinct' ELSE 'insufficient_evidence' END AS conclusion,
    s_suppkey * 3 AS doc FROM supplier),
cref AS (SELECT comparison_id, 'e' || doc || '-' || n AS ref FROM cmp, (SELECT unnest([1, 2]) AS n))"""
