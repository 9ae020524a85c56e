"""Detection rules: the built-in patterns, and which of them a policy keeps."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from maskwright.dialect import BOUNDARY, ENDS_WORD, SPACE, STARTS_WORD, to_jvm, translate
from maskwright.policy import Policy

HIGH, MEDIUM = "high", "medium"
DIGIT = "digit"


@dataclass(frozen=True)
class Rule:
    """One pattern.

    ``pattern`` is the rule as published; ``jvm`` is what Spark runs (translated
    from ``pattern`` when not given).  ``needs`` names something every match
    must contain: ``DIGIT``, or any one of several literals.  Texts without it
    skip the pattern.
    """

    type: str
    pattern: str
    confidence: str = HIGH
    custom: bool = False
    ignore_case: bool = False
    jvm: str = ""
    needs: str | tuple[str, ...] = ()
    reason: str = ""

    @property
    def regex(self) -> str:
        """The pattern in the JVM dialect."""
        return self.jvm or ("(?i)" if self.ignore_case else "") + to_jvm(self.pattern)

    @property
    def can_be_empty(self) -> bool:
        """The pattern can match nothing; such matches do not count."""
        return not self.jvm and translate(self.pattern).can_be_empty

    @property
    def visible(self) -> str | None:
        """A pattern that matches the same but nothing empty; None if none is known, "" if there are no such matches."""
        found = self.regex if self.jvm else translate(self.pattern).visible
        return "(?i)" + found if found and self.ignore_case and not self.jvm else found

    @property
    def re2(self) -> str:
        """The pattern in the RE2 dialect."""
        return ("(?i)" if self.ignore_case else "") + self.pattern


# Published patterns of the ten built-in detectors, in rule order.
_EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
_PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
_CREDIT_CARD = r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[- ]?\d{4}[- ]?\d{4}[- ]?\d{0,4}\b"
_IP_ADDRESS = (
    r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
)
_IP_ADDRESS_V6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
    r"|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b"
)
_DATE_OF_BIRTH = (
    r"(?:born\s+(?:on\s+)?|dob[:\s]+|date\s+of\s+birth[:\s]+|birthday[:\s]+)"
    r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\w+ \d{1,2},?\s*\d{4})"
)
_IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"
_PASSPORT = r"\b[A-Z]{1,2}\d{6,9}\b"
_API_KEY = r"\b(?:sk-|ghp_|gho_|github_pat_)[a-zA-Z0-9_\-]{10,}\b"


def _edges(pattern: str, first: str = STARTS_WORD, last: str = ENDS_WORD) -> str:
    """JVM form of a pattern whose only boundaries are at its two ends."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return (
        (first if pattern.startswith(r"\b") else "")
        + to_jvm(body)
        + (last if pattern.endswith(r"\b") else "")
    )


BUILT_IN = (
    Rule("EMAIL", _EMAIL, jvm=_edges(_EMAIL, first=BOUNDARY), needs=("@",)),
    Rule("PHONE", _PHONE, jvm=_edges(_PHONE), needs=DIGIT),
    Rule("SSN", _SSN, jvm=_edges(_SSN), needs=DIGIT),
    # The last atom may be a separator, so the closing boundary stays general.
    Rule("CREDIT_CARD", _CREDIT_CARD, jvm=_edges(_CREDIT_CARD, last=BOUNDARY), needs=DIGIT),
    Rule("IP_ADDRESS", _IP_ADDRESS, jvm=_edges(_IP_ADDRESS), needs=DIGIT),
    Rule(
        "IP_ADDRESS_V6",
        _IP_ADDRESS_V6,
        jvm="|".join(_edges(branch) for branch in _IP_ADDRESS_V6.split("|")),
        needs=(":",),
    ),
    Rule("DATE_OF_BIRTH", _DATE_OF_BIRTH, ignore_case=True, needs=DIGIT),
    Rule("IBAN", _IBAN, MEDIUM, jvm=_edges(_IBAN), needs=DIGIT),
    Rule("PASSPORT", _PASSPORT, MEDIUM, jvm=_edges(_PASSPORT), needs=DIGIT),
    # May end in "-", so the closing boundary stays general.
    Rule(
        "API_KEY", _API_KEY, jvm=_edges(_API_KEY, last=BOUNDARY),
        needs=("sk-", "ghp_", "gho_", "github_pat_"),
    ),
)

# Published patterns and reasons of the seven indirect identifiers.
HINTS = tuple(
    Rule(kind, pattern, ignore_case=True, jvm="(?i)" + _edges(pattern), reason=reason)
    for kind, pattern, reason in (
        (
            "FAMILY_RELATION",
            r"\bmy\s+(daughter|son|wife|husband|mother|father|sister|brother|child|kids?|grandma|grandpa"
            r"|grandparent|nephew|niece|uncle|aunt|cousin|in-law)\b",
            "Mentions a family member — could be used to re-identify you",
        ),
        (
            "WORK_RELATION",
            r"\bmy\s+(boss|colleague|coworker|co-worker|manager|supervisor|employee|assistant"
            r"|direct\s+report|team(?:\s+member)?)\b",
            "Mentions a work relationship — may identify your workplace",
        ),
        (
            "LOCATION_HINT",
            r"\b(?:I\s+live|I\s+reside|my\s+(?:home|house|apartment|flat|address)\s+is?)\b",
            "Hints at your home location",
        ),
        (
            "EMPLOYER_HINT",
            r"\b(?:I\s+work\s+(?:at|for)|I(?:'m|\s+am)\s+employed\s+(?:at|by)"
            r"|my\s+(?:company|employer|workplace|firm|startup))\b",
            "Hints at your employer",
        ),
        (
            "SCHOOL_HINT",
            r"\b(?:I\s+(?:study|go|attend)\s+(?:at|to)|my\s+(?:school|university|college|campus))\b",
            "Hints at your educational institution",
        ),
        (
            "ORIGIN_HINT",
            r"\b(?:I(?:'m|\s+am)\s+from|I\s+(?:was\s+)?born\s+in|I\s+grew\s+up\s+in|my\s+hometown)\b",
            "Reveals geographic origin",
        ),
        (
            "MEDICAL_HINT",
            r"\b(?:I\s+have\s+(?:been\s+diagnosed|a\s+condition)"
            r"|my\s+(?:doctor|therapist|psychiatrist|diagnosis|medication|prescription))\b",
            "May reveal medical history",
        ),
    )
)
# Every indirect identifier opens with one of these words and a space.
HINT_OPENING = rf"(?i){STARTS_WORD}(?:my|i|i'm){SPACE}"

# Rule types an answer is scanned for, and the types that call for a decision.
RESPONSE_TYPES = ("EMAIL", "SSN", "CREDIT_CARD", "IBAN", "PASSPORT")
HIGH_RISK_TYPES = ("SSN", "PASSPORT", "IBAN", "CREDIT_CARD")


def score(confidence: str) -> float:
    """Numeric confidence of a rule."""
    return 0.95 if confidence == HIGH else 0.65


def active_rules(policy: Policy, custom: Iterable[Rule] = ()) -> tuple[Rule, ...]:
    """Rules a policy leaves on, in rule order: built-in first, then custom.

    Pruning happens here, on the driver, so a rule that is off never reaches a plan.
    """
    return tuple(
        r
        for r in (*BUILT_IN, *custom)
        if policy.allows(r.type) and not (r.confidence == MEDIUM and policy.sensitivity == "light")
    )
