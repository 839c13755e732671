"""Check-result taxonomy, ranks and the values of the record model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error taxonomy and the network codes that map to it.
ERROR_CODES = (
    "DNS_FAILURE", "CONNECT_TIMEOUT", "READ_TIMEOUT", "TLS_CERT_EXPIRED", "TLS_HOST_MISMATCH",
    "TOO_MANY_REDIRECTS", "HTTP_CLIENT_ERROR", "HTTP_SERVER_ERROR", "ROBOTS_DISALLOWED",
    "AUTOMATION_BLOCKED", "AUTH_REQUIRED", "UNSUPPORTED_CONTENT", "RESPONSE_TOO_LARGE",
    "PARSER_FAILURE", "INTERNAL_AUDIT_ERROR", "SSRF_BLOCKED", "SCOPE_EXCLUDED",
    "BROWSER_AUTOMATION_FAILURE",
)
NETWORK_CODES = {
    "ENOTFOUND": "DNS_FAILURE", "EAI_AGAIN": "DNS_FAILURE",
    "EAI_NODATA": "DNS_FAILURE", "EAI_NONAME": "DNS_FAILURE",
    "ECONNREFUSED": "CONNECT_TIMEOUT", "ECONNRESET": "CONNECT_TIMEOUT",
    "EHOSTUNREACH": "CONNECT_TIMEOUT", "ENETUNREACH": "CONNECT_TIMEOUT",
    "UND_ERR_CONNECT_TIMEOUT": "CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT": "CONNECT_TIMEOUT",
    "CERT_HAS_EXPIRED": "TLS_CERT_EXPIRED", "ERR_TLS_CERT_HAS_EXPIRED": "TLS_CERT_EXPIRED",
    "ERR_TLS_CERT_ALTNAME_INVALID": "TLS_HOST_MISMATCH", "HOSTNAME_MISMATCH": "TLS_HOST_MISMATCH",
    "ERR_TLS_HANDSHAKE_TIMEOUT": "TLS_HOST_MISMATCH",
}
# Record enumerations.
OFFICIAL_STATUS = ("verified", "unverified", "disputed")
HEALTH = ("healthy", "degraded", "unavailable", "not_assessable")
SEVERITY = ("critical", "significant", "advisory")
ACTIONS = ("maintain", "repair", "review_consolidation", "review_retirement", "manual_assessment")
CONTINUING_ROLES = ("distinct", "possible_overlap", "unclear", "not_reviewed")
CONFIDENCE = ("high", "medium", "low")
REVIEW_STATUS = ("automated_observation", "pending_review", "reviewed", "rejected", "not_assessable")
CHECK_STATUS = ("pass", "fail", "warning", "not_applicable", "not_assessable")
OUTCOMES = ("completed", "partially_completed", "not_completed", "information_only")
EXPERIENCE_STATUS = ("pending", "approved", "rejected", "needs_redaction")
THEMES = (
    "availability", "navigation", "content_clarity", "outdated_information", "login_or_otp",
    "form_or_validation", "payment", "document_upload", "mobile_usability", "language",
    "accessibility", "support", "other",
)
DEVICES = ("mobile", "desktop", "tablet", "other")
SUBMISSION_SOURCES = ("public_form", "research_interview")
TASK_TYPES = (
    "apply_for_scheme_or_benefit", "check_application_or_case_status", "download_or_view_document",
    "make_a_payment", "find_information", "register_a_complaint_or_grievance",
    "renew_license_or_certificate", "create_or_update_account", "other",
)
VERIFYING_SOURCE_TYPES = ("official_directory", "official_page")

# Orders of urgency.
SEVERITY_ORDER = ("critical", "significant", "advisory")
HEALTH_ORDER = ("unavailable", "degraded", "not_assessable", "healthy")
ACTION_ORDER = ("review_retirement", "repair", "review_consolidation", "manual_assessment", "maintain")

# Blocked IPv4 ranges as (first address, prefix length).
BLOCKED_IPV4 = (
    ("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16),
    ("169.254.0.0", 16), ("100.64.0.0", 10), ("0.0.0.0", 8),
)


def rank(value: Column, order: tuple[str, ...], missing: int | None = None) -> Column:
    """Position of a value in an order; unknown values get ``missing``."""
    pos = F.array_position(F.array(*(F.lit(v) for v in order)), value).cast("int")
    return F.when(pos > 0, pos - 1).otherwise(F.lit(missing).cast("int"))


def classify_http_status(status: Column) -> Column:
    return (
        F.when(status == 401, "AUTH_REQUIRED")
        .when((status >= 400) & (status < 500), "HTTP_CLIENT_ERROR")
        .when(status >= 500, "HTTP_SERVER_ERROR")
    )


def classify_network_code(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in NETWORK_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.lit("INTERNAL_AUDIT_ERROR"))


def is_html_content_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))


def final_url(final: Column, redirect_chain: Column) -> Column:
    return F.coalesce(final, F.try_element_at(redirect_chain, F.lit(-1))["url"])


def observation_summary() -> Column:
    """Comma-joined parts of the current observation row."""
    return F.concat_ws(
        ", ",
        F.concat(F.lit("attempt "), F.col("attempt")),
        F.concat(F.lit("checkedAt "), F.col("checked_at").cast("string")),
        F.concat(F.lit("fetchMode "), F.col("fetch_mode")),
        F.concat(F.lit("httpStatus "), F.col("http_status")),
        F.concat(F.lit("errorCode "), F.col("error_code")),
        F.concat(F.lit("errorMessage "), F.col("error_message")),
    )


def highest_severity(critical: Column, significant: Column, advisory: Column) -> Column:
    return (
        F.when(critical > 0, "critical").when(significant > 0, "significant").when(advisory > 0, "advisory")
    )


def ipv4_number(ip: Column) -> Column:
    """Address as a bigint, null unless it is four octets of at most 255."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.cast("bigint"))
    shaped = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(shaped, F.when(F.forall(octets, lambda o: o <= 255), value))


def _blocked_number(number: Column) -> Column:
    out = F.lit(False)
    for first, bits in BLOCKED_IPV4:
        low = 0
        for octet in first.split("."):
            low = low * 256 + int(octet)
        out = out | number.between(low, low + 2 ** (32 - bits) - 1)
    return out


def is_blocked_ip(ip: Column) -> Column:
    """Loopback, private, link-local or unreadable addresses."""
    flat = F.lower(F.trim(ip))
    mapped = F.regexp_extract(flat, r"^::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    v6 = (
        flat.isin("::1", "::")
        | flat.rlike(r"^fe[89ab][0-9a-f]:")  # first ten bits of a link-local address
        | F.split(flat, ":")[0].rlike(r"^f[cd][0-9a-f]{2}$")
        | ((mapped != "") & F.coalesce(_blocked_number(ipv4_number(mapped)), F.lit(False)))
    )
    return F.when(flat.contains(":"), v6).otherwise(
        F.coalesce(_blocked_number(ipv4_number(flat)), F.lit(True))
    )
