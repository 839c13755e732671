"""Titles and summaries of findings. {names} stand for columns or expressions."""

TITLES = {
    "unavailable": "Portal entry point unavailable",
    "server_error": "Repeated server errors on entry point",
    "server_error_sustained": "Sustained server errors on entry point",
    "not_found": "Entry URL not found",
    "cross_domain": "Redirect leaves the portal's registered hosts",
    "blocked": "Automated check was blocked",
    "restricted": "Entry page requires authentication or restricts access",
    "broken_link": "Broken link destination",
    "certificate_expired": "Certificate expired",
    "certificate_mismatch": "Certificate hostname mismatch",
    "no_tls": "Entry page is not served over HTTPS",
    "no_freshness": "No freshness signal detected",
    "coverage": "Crawl coverage summary",
    "directory_unavailable": "Directory entry points to an unavailable destination",
    "directory_disagrees": "Directory listing disagrees with observed destination",
    "directory_absent": "Verified portal absent from official directory",
}

SUMMARIES = {
    "unavailable": "Unavailable during {count} checks on {failed_dates}.",
    "server_error": "The entry page returned a server error (5xx) on {count} of {entries} check(s) ({server_dates}).",
    "not_found": "The official entry URL returned {missing_first.http_status} on {count} of {entries} check(s) ({missing_dates}).",
    "cross_domain": "The entry URL {requested_url} finally resolved to {target}, outside the portal's registered hostnames.",
    "blocked": "The automated crawler was blocked (bot-block or CAPTCHA) while checking {canonical_url}; this is not evidence the page is broken for a human visitor.",
    "restricted": "The entry page returned {shown} while checking {canonical_url}; this may reflect a legitimate access restriction rather than a broken page.",
    "broken_link": "The destination {destination} failed from {source_pages} source page(s) on this portal ({codes}).",
    "certificate": "Accessing {canonical_url} produced a certificate error ({tls_first.error_code}) as observed by the client.",
    "no_tls": "The final destination for {requested_url} ({target}) does not use HTTPS.",
    "no_freshness": "No recent update signal was detected in the sampled pages.",
    "coverage_pages": "{pages_observed} page(s) observed (configured maximum: {max_pages}).",
    "coverage_budget": "The per-portal page budget was reached; deeper coverage was not attempted.",
    "coverage_depth": "The configured maximum crawl depth ({max_depth}) was reached.",
    "coverage_robots": "{robots_skips} URL(s) were not fetched because robots.txt disallowed them.",
    "coverage_skips": "{skipped} URL(s) in total were not fetched this run (see evidence for reasons).",
    "directory_unavailable": "The official directory linked to a destination that returned an availability failure ({rules}).",
    "directory_disagrees": "The official directory listing for this portal disagrees with what was observed: {why}.",
    "directory_name": 'the directory\'s listed name "{s.source_name}" shares no significant word with the portal\'s recorded name "{name}"',
    "directory_host": "the directory's listed URL host ({listed}) differs from the portal's canonical URL host ({own})",
    "directory_seen": "the directory's listed URL host ({listed}) differs from where the portal's entry page was ultimately observed ({seen})",
    "directory_absent": "{name} is a verified official portal but is not backed by any official_directory-typed source in this inventory.",
}
