"""The row jobs once more, one text at a time in plain Python, to compare with."""

import random
import re

from maskwright.rules import BUILT_IN, score


def compiled(rule):
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    return re.compile(rule.pattern, flags)


def hits(text, rules=BUILT_IN):
    return [
        (m.start(), order, m.end(), rule.type, m.group(0), score(rule.confidence))
        for order, rule in enumerate(rules)
        for m in compiled(rule).finditer(text)
    ]


def detect(text, rules=BUILT_IN):
    seen, kept = set(), []
    for h in hits(text, rules):
        if (h[3], h[4]) not in seen:
            seen.add((h[3], h[4]))
            kept.append(h)
    return sorted(kept, key=lambda h: (h[0], h[1]))


def redact(text, found):
    counters, out, cursor, tokens = {}, "", 0, {}
    for start, _, end, kind, value, _ in found:
        counters[kind] = counters.get(kind, 0) + 1
        token = f"[{kind}_{counters[kind]:02d}]"
        tokens[token] = value
        out += text[cursor:start] + token if start > cursor else token
        cursor = end
    return out + text[cursor:], tokens


def redact_safe(text, rules=BUILT_IN):
    merged = []
    for start, order, end, kind, value, _ in sorted(hits(text, rules), key=lambda h: (h[0], -h[2], h[1])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    names, counters, out, cursor = {}, {}, "", 0
    for start, end, kind in merged:
        key = (kind, text[start:end])
        if key not in names:
            counters[kind] = counters.get(kind, 0) + 1
            names[key] = f"[{kind}_{counters[kind]:02d}]"
        out += text[cursor:start] + names[key]
        cursor = end
    return out + text[cursor:], names


PIECES = (
    "a@b.com", "z.y+x@mail.example.org", "5551234567@example.com", "(555) 123-4567", "+1-800-555-0100", "555.123.4567",
    "123-45-6789", "123-45-67890", "4111 1111 1111 1111", "4111111111111111", "3714-4963-5398-431", "10.0.0.1", "256.1.1.1",
    "1.2.3.4.5", "::1:2", "2001:0db8:0:0:0:0:0:1", "DOB: 01/15/1990", "born on 3-4-85", "birthday: June 5, 1990",
    "GB29NWBK60161331926819", "AB1234567", "X123456", "sk-TESTONLY_abcdef-", "ghp_TESTONLY1234567890", "sk-", "é", "_", "-", " ",
    "x", "@", ".", "Été", "12", "7", ":", "(", ")", "+", "the", "\n",
)


def random_texts(n, seed=1, pieces=PIECES):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) + rng.choice(("", " ", " ")) for _ in range(rng.randint(0, 14))) for _ in range(n)]
