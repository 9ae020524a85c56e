import random
import string

import brute
import pytest
from pyspark.sql import functions as F

from maskwright.dialect import literal, to_jvm
from maskwright.operators.detect import detect, detect_type, explode_detections
from maskwright.policy import DETECTORS, Policy
from maskwright.rules import BUILT_IN, HINTS, Rule, active_rules

LETTERS, DIGITS = string.ascii_lowercase, string.digits
#: Digits that no card number begins with.
DULL = "012789"


class Made:
    """Texts made from the grammar of a pattern, and the same with one part of it broken."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def some(self, of, low, high=None):
        return "".join(self.rng.choices(of, k=self.rng.randint(low, high or low)))

    def one(self, *of):
        return self.rng.choice(of)

    def email(self):
        name, host, top = self.some(LETTERS + DIGITS + "._%+-", 1, 9) + "q", self.some(LETTERS + DIGITS, 1, 8), self.some(LETTERS, 2, 5)
        return f"{name}@{host}.{top}", [f"{name}{host}.{top}", f"{name}@.{top[0]}", f"{name}@{host}{top}", f"{name}@{host}.{top[0]}", f"{name} @{host}.{top}"]

    def phone(self):
        area, mid, end, gap = self.some(DIGITS, 3), self.some(DIGITS, 3), self.some(DIGITS, 4), self.one("", "-", ".", " ")
        head = self.one("", "+" + self.some(DIGITS, 1, 3) + " ")
        return f"{head}{self.one(area, f'({area})')}{gap}{mid}{gap}{end}", [f"{area}{gap}{mid}", f"{area[1:]}{gap}{mid}{gap}{end}", f"{area}-{mid}-x{end}"]

    def ssn(self):
        parts = [self.some(DIGITS, k) for k in (3, 2, 4)]
        longer = ["-".join([*parts[:k], parts[k] + "0", *parts[k + 1 :]]) for k in range(3)]
        shorter = ["-".join([*parts[:k], parts[k][1:], *parts[k + 1 :]]) for k in range(3)]
        return "-".join(parts), [*longer, *shorter, "".join(parts)]

    def credit_card(self):
        first = self.one("4" + self.some(DULL, 3), "5" + self.one(*"12345") + self.some(DULL, 2), "6011", "3" + self.one(*"47") + self.some(DULL, 2))
        gap, groups = self.one("", "-", " "), [self.some(DULL, 4) for _ in range(2)] + [self.some(DULL, 0, 4)]
        rest = gap.join(groups[:2]) + (gap + groups[2] if groups[2] else "")
        return f"{first}{gap}{rest}", [f"1{first[1:] if first != '6011' else '000'}{gap}{rest}", f"{first}{gap}{groups[0]}", f"7{first}{gap}{rest}"]

    def ip_address(self):
        parts = [str(self.rng.randint(0, 255)) for _ in range(4)]
        k = self.rng.randrange(4)
        over = [*parts[:k], str(self.rng.randint(256, 999)), *parts[k + 1 :]]
        return ".".join(parts), [".".join(over), ".".join(parts[:3]), ".".join([*parts[:2], "x", parts[3]])]

    def ip_address_v6(self):
        groups = [self.some(DIGITS + "abcdefABCDEF", 1, 4) for _ in range(8)]
        short = groups[: self.rng.randint(1, 6)]
        return self.one(":".join(groups), "::" + ":".join(short)), [":".join(groups[:7]), ":".join([*groups[:7], "g"]), "::"]

    def date_of_birth(self):
        intro = self.one("born ", "Born on ", "dob: ", "DOB ", "date of birth: ", "Birthday ")
        d, m, y, gap = self.rng.randint(1, 28), self.rng.randint(1, 12), self.rng.randint(1920, 2020), self.one(*"/-.")
        date = self.one(f"{m}{gap}{d}{gap}{y}", f"{self.some(LETTERS, 3, 9)} {d}, {y}")
        return intro + date, [date, intro + self.some(LETTERS, 4), f"seen {date}"]

    def iban(self):
        country, check, rest = self.some(LETTERS.upper(), 2), self.some(DIGITS, 2), self.some(LETTERS.upper() + DIGITS, 4, 30)
        return country + check + rest, [country + check + rest[:3], country[0] + check + rest[:3], check + self.some(DIGITS, 8), (country + check + rest).lower() + "_"]

    def passport(self):
        letters, digits = self.some(LETTERS.upper(), 1, 2), self.some(DIGITS, 6, 9)
        return letters + digits, [letters + digits[:5], "QQQ" + digits, letters + self.some(DIGITS, 10), digits, letters.lower() + digits]

    def api_key(self):
        start, rest = self.one("sk-", "ghp_", "gho_", "github_pat_"), self.some(LETTERS + DIGITS, 10, 30)
        return start + rest, [start, start + rest[:9], rest, "x" + start + rest]


@pytest.mark.parametrize("kind", [r.type for r in BUILT_IN])
def test_samples(texts, kind):
    made = [getattr(Made(seed), kind.lower())() for seed in range(40)]
    good = [value.join(around) for value, _ in made for around in (("", ""), ("see ", " there"), ("<", ">"))]
    bad = [value for _, broken in made for value in broken]
    rows = detect_type(texts(*good, *bad), kind).orderBy("id").collect()
    wrong = [(r.text, r.id < len(good)) for r in rows if (len(r.detections) > 0) != (r.id < len(good))]
    assert not wrong


def test_random_texts_equal_plain_python(texts):
    values = brute.random_texts(600)
    for row in detect(texts(*values)).collect():
        got = [(d.start, d.end, d.type, d.value, d.confidence) for d in row.detections]
        want = [(s, e, k, v, c) for s, _, e, k, v, c in brute.detect(values[row.id])]
        assert got == want, values[row.id]


def test_short_boundaries_equal_general_ones(texts):
    df = texts(*brute.random_texts(600, seed=2))
    for rule in (*BUILT_IN, *HINTS):
        general = ("(?i)" if rule.ignore_case else "") + to_jvm(rule.pattern)
        differing = df.where(
            F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
            != F.regexp_extract_all("text", F.lit(general), F.lit(0))
        )
        assert differing.count() == 0, rule.type


def test_accented_letters_are_no_word_characters(texts):
    (row,) = detect(texts("éa@b.com")).collect()
    assert row.detections[0].value == "a@b.com"


def test_fields_order_and_dedup(texts):
    (row,) = detect(texts("SSN: 123-45-6789, mail z@z.com, z@z.com and 123-45-6789")).collect()
    assert [(d.type, d.start, d.end, d.confidence, d.source) for d in row.detections] == [
        ("SSN", 5, 16, 0.95, "regex"),
        ("EMAIL", 23, 30, 0.95, "regex"),
    ]
    (row,) = detect(texts("SSN: 123-45-6789 and 123-45-6789"), occurrences="all").collect()
    assert [d.start for d in row.detections] == [5, 21]


def test_empty_and_null(texts):
    rows = detect(texts("", None, "The weather is nice")).orderBy("id").collect()
    assert [r.detections for r in rows] == [[], None, []]


def test_toggles_sensitivity_and_profiles(texts):
    def types(text, policy):
        return {d.type for d in detect(texts(text), policy=policy).first().detections}

    assert types("a@b.com", Policy(detectors={"EMAIL": False})) == set()
    assert "PASSPORT" in types("AB1234567", Policy())
    assert types("AB1234567", Policy(sensitivity="light")) == set()
    everything = "a@b.com 123-45-6789 10.0.0.1 ::1:2"
    # The address type without a switch stays on in every profile.
    assert types(everything, Policy().with_profile("personal")) == {"EMAIL", "SSN", "IP_ADDRESS_V6"}
    assert Policy().with_profile("work").sensitivity == "strict"
    assert all(Policy().with_profile("medical").allows(d) for d in DETECTORS)
    assert Policy().with_profile("unknown") == Policy()


def test_custom_rules_run_last_and_share_types(texts):
    custom = [Rule("EMAIL", r"\bnick\w+", custom=True), Rule("CODE", r"[A-Z]{3}\d", "medium", custom=True)]
    assert [r.type for r in active_rules(Policy(), custom)][-2:] == ["EMAIL", "CODE"]
    (row,) = detect(texts("nickname nick@x.org ABC1 nick"), custom=custom).collect()
    assert [(d.type, d.value) for d in row.detections] == [
        ("EMAIL", "nickname"),
        ("EMAIL", "nick@x.org"),
        ("CODE", "ABC1"),
    ]
    (row,) = detect(texts("ABC1"), policy=Policy(sensitivity="light"), custom=custom).collect()
    assert row.detections == []


def test_no_rules_left(texts):
    off = Policy(detectors={r.type: False for r in BUILT_IN})
    assert detect(texts("a@b.com"), policy=off).first().detections == []


@pytest.mark.parametrize("n", [63, 64, 65, 400])
def test_many_matches_in_one_text(texts, n):
    value = " ".join(f"u{i % 300}@x.org {i:03d}-45-6789" for i in range(n))
    (row,) = detect(texts(value)).collect()
    assert [(d.start, d.value) for d in row.detections] == [(h[0], h[4]) for h in brute.detect(value)]


def test_explode_numbers_detections(texts):
    rows = explode_detections(detect(texts("a@b.com 10.0.0.1", "none")), ["id"]).orderBy("seq").collect()
    assert [(r.id, r.seq, r.type) for r in rows] == [(0, 0, "EMAIL"), (0, 1, "IP_ADDRESS")]


def test_dialect():
    assert to_jvm(r"[^]x[]$") == r"[\s\S]x(?!)\z"
    assert to_jvm(r"[a[b&&c]") == r"[a\[b\&\&c]"
    assert to_jvm(r"\.[.$]") == r"\.[.$]"
    assert literal("a.b(c)") == r"a\.b\(c\)"
