"""Scan settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# The switchable detectors, sensitivities and profiles.
DETECTORS = (
    "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "IBAN", "PASSPORT",
    "API_KEY", "PERSON", "ORGANIZATION", "LOCATION",
)
SENSITIVITIES = ("light", "balanced", "strict")
PROFILES = {
    "work": ("strict", DETECTORS),
    "personal": ("balanced", ("EMAIL", "PHONE", "SSN")),
    "medical": ("strict", DETECTORS),
}


@dataclass(frozen=True)
class Policy:
    """What a scan looks for.  A detector that is not listed is on."""

    enabled: bool = True
    sensitivity: str = "balanced"
    detectors: Mapping[str, bool] = field(default_factory=dict)
    semantic_scrubbing: bool = True
    synthetic_mode: bool = False
    timing_jitter: bool = False
    audit_retention_days: int = 30
    clipboard_guard: bool = True

    def allows(self, kind: str) -> bool:
        return self.detectors.get(kind) is not False

    def with_profile(self, name: str) -> Policy:
        """Switch sensitivity and detectors to a named profile; unknown names change nothing."""
        if name not in PROFILES:
            return self
        sensitivity, on = PROFILES[name]
        return replace(self, sensitivity=sensitivity, detectors={d: d in on for d in DETECTORS})
