"""Record shapes and their constraints.

``FIELDS`` states, per entity, each field's type, whether it is required and its
value constraints. Reader schemas and validity checks both come from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from webestate.functions import checks

# Formats.
STABLE_ID = r"^[A-Za-z0-9._~-]+$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
CATEGORIES = (
    "availability", "broken_link", "https", "freshness", "crawl_coverage", "directory_mismatch", "possible_overlap",
)
EVIDENCE_TYPES = (
    "http_response_snapshot", "screenshot", "text_excerpt", "redirect_chain", "certificate_detail",
    "directory_listing", "link_check_result", "manual_note",
)
PORTAL_TYPES = ("information", "transactional", "directory", "mixed", "unknown")
SOURCE_TYPES = ("official_directory", "official_page", "manual_verified")


@dataclass(frozen=True)
class Field:
    type: str = "string"
    required: bool = True
    enum: tuple = ()
    pattern: str = ""
    low: float | None = None
    high: float | None = None
    max_length: int | None = None


def req(type: str = "string", **k) -> Field:  # noqa: A002
    return Field(type, True, **k)


def opt(type: str = "string", **k) -> Field:  # noqa: A002
    return Field(type, False, **k)


ID = req(pattern=STABLE_ID)
AT = req("timestamp", pattern=TIMESTAMP)
COUNT = req("bigint", low=0)

FIELDS: dict[str, dict[str, Field]] = {
    "inventory_source": {
        "id": ID, "schemaVersion": req(), "name": req(), "authorityName": req(), "url": req(pattern=URL),
        "sourceType": req(enum=SOURCE_TYPES), "retrievedAt": AT, "evidencePath": opt(), "notes": opt(),
    },
    "portal": {
        "id": ID, "schemaVersion": req(), "name": req(), "canonicalUrl": req(pattern=URL), "alternateUrls": req("array<string>"),
        "hostnames": req("array<string>"), "description": opt(), "department": opt(), "geography": req(),
        "portalType": req(enum=PORTAL_TYPES), "officialStatus": req(enum=checks.OFFICIAL_STATUS), "sourceRefs": req("array<string>"),
        "discovery": req("array<struct<discoveredAt:timestamp,discoveredFromUrl:string,discoveryMethod:string>>"),
        "tags": req("array<string>"), "crawlProfile": opt(),
    },
    "page_observation": {
        "id": ID, "schemaVersion": req(), "runId": ID, "portalId": ID, "requestedUrl": req(pattern=URL), "finalUrl": opt(pattern=URL),
        "discoveredFrom": opt(), "checkedAt": AT, "attempt": req("bigint", low=1), "fetchMode": req(enum=("http", "browser")),
        "httpStatus": opt("bigint"), "redirectChain": req("array<struct<url:string,status:int>>"), "contentType": opt(),
        "durationMs": opt("double", low=0), "title": opt(), "canonical": opt(), "language": opt(), "bodyDigest": opt(),
        "errorCode": opt(), "errorMessage": opt(),
        "robotsDecision": req(enum=("allowed", "disallowed", "not_checked")), "artifactRefs": req("array<string>"),
    },
    "link_observation": {
        "id": ID, "schemaVersion": req(), "runId": ID, "portalId": ID, "sourcePageUrl": req(pattern=URL), "destinationUrl": req(),
        "normalizedDestinationUrl": req(), "anchorText": opt(), "relationship": req(enum=("internal", "external")), "context": opt(),
        "checkedAt": AT, "status": req(enum=checks.CHECK_STATUS), "httpStatus": opt("bigint"), "errorCode": opt(), "attempts": COUNT,
    },
    "finding": {
        "id": ID, "schemaVersion": req(), "runId": ID, "portalId": ID, "ruleId": req(), "category": req(enum=CATEGORIES), "title": req(),
        "summary": req(), "severity": req(enum=checks.SEVERITY), "confidence": req(enum=checks.CONFIDENCE),
        "checkStatus": req(enum=checks.CHECK_STATUS), "reviewStatus": req(enum=checks.REVIEW_STATUS), "firstObservedAt": AT,
        "lastObservedAt": AT, "evidenceRefs": req("array<string>"), "affectedUrls": req("array<string>"), "suggestionRuleId": req(),
        "suggestedAction": req(enum=checks.ACTIONS), "overlapComparisonId": opt(), "reviewerRationale": opt(), "limitations": req("array<string>"),
    },
    "evidence_artifact": {
        "id": ID, "schemaVersion": req(), "runId": ID, "portalId": ID, "type": req(enum=EVIDENCE_TYPES), "capturedAt": AT,
        "sourceUrl": opt(), "relatedObservationId": opt(), "storagePath": req(), "contentDigest": req(), "mimeType": opt(),
        "description": req(), "privacyReviewed": req("boolean"), "privacyReviewedAt": opt("timestamp"), "privacyReviewer": opt(),
        "redactions": opt("array<string>"),
    },
    "evidence_privacy_review": {
        "schemaVersion": req(), "artifactId": ID, "privacyReviewed": req("boolean"), "privacyReviewedAt": AT, "privacyReviewer": req(),
        "redactions": opt("array<string>"), "note": opt(),
    },
    "review_decision": {
        "schemaVersion": req(), "findingId": ID, "decision": req(enum=("publish", "reject", "needs_more_evidence")), "reviewedAt": AT,
        "reviewer": req(), "rationale": req(), "overriddenSeverity": opt(enum=checks.SEVERITY), "overriddenAction": opt(enum=checks.ACTIONS),
    },
    "overlap_comparison": {
        "id": ID, "schemaVersion": req(), "runId": ID, "portalIdA": ID, "portalIdB": ID, "status": req(), "reviewedAt": AT, "reviewer": req(),
        "intendedUserA": req(), "intendedUserB": req(), "serviceOrTaskA": req(), "serviceOrTaskB": req(), "jurisdictionA": opt(),
        "jurisdictionB": opt(), "transactionStageA": opt(), "transactionStageB": opt(), "responsibleAuthorityA": opt(),
        "responsibleAuthorityB": opt(), "linksOrRedirectsBetween": req("boolean"), "materialSimilarities": req("array<string>"),
        "materialDifferences": req("array<string>"), "conclusion": req(enum=("distinct", "possible_overlap", "insufficient_evidence")),
        "uncertaintyNote": req(), "evidenceRefs": req("array<string>"),
    },
    "audit_run": {
        "id": ID, "geography": req(), "startedAt": AT, "completedAt": opt("timestamp", pattern=TIMESTAMP),
        "status": req(enum=("running", "completed", "partial", "failed")), "methodologyVersion": req(), "schemaVersion": req(),
        "codeRevision": opt(), "nodeVersion": req(), "packageVersionsDigest": req(), "sourceRegistryDigest": req(), "crawlPolicyDigest": req(),
        "checkConfigDigest": req(), "enabledChecks": req("array<string>"), "portalCount": COUNT, "portalsSucceeded": COUNT,
        "portalsFailed": COUNT, "portalsPartial": COUNT, "limitations": req("array<string>"),
    },
    "experience_submission": {
        "id": ID, "schemaVersion": req(), "portalId": ID, "createdAt": AT, "occurredOn": opt(), "taskType": req(),
        "taskDescription": opt(max_length=280), "outcome": req(enum=checks.OUTCOMES), "themes": req("array<string>", enum=checks.THEMES),
        "deviceType": opt(enum=checks.DEVICES), "experienceRating": opt("bigint", low=1, high=5), "freeText": opt(max_length=1000),
        "consentToPublish": req("boolean"), "source": req(enum=checks.SUBMISSION_SOURCES), "privacyFlags": req("array<string>"),
        "duplicateOf": opt(), "seedKey": opt(),
    },
    "experience_request": {
        "portalId": ID, "occurredOn": opt(), "taskType": req(enum=checks.TASK_TYPES), "taskDescription": opt(max_length=280),
        "outcome": req(enum=checks.OUTCOMES), "themes": req("array<string>", enum=checks.THEMES), "deviceType": opt(enum=checks.DEVICES),
        "experienceRating": opt("bigint", low=1, high=5), "freeText": opt(max_length=1000), "consentToPublish": req("boolean"),
        "website": opt(max_length=200),
    },
}


def ddl(entity: str) -> str:
    return ", ".join(f"`{name}` {f.type}" for name, f in FIELDS[entity].items())
