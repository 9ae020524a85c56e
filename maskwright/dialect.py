"""Rewriting of rule patterns into the JVM's regular-expression dialect.

Rules are written in the browser dialect.  A pattern is read atom by atom, which
also shows whether it is valid and whether it can match nothing.  What differs:

* ``\\b`` and ``\\B`` look at ASCII word characters only, ``[\\b]`` is a backspace;
* ``\\s`` and ``\\S`` include the Unicode spaces;
* ``.`` stops at four line terminators, ``$`` matches at the very end only;
* ``[`` and ``&&`` have no special meaning inside a character class;
* braces that are no quantifier stand for themselves, as do letters behind a backslash that mean nothing;
* group names may hold any letters, digits and ``_``;
* atomic groups, possessive quantifiers and inline flags do not exist.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The whitespace of the browser dialect.
SPACE_SET = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_SET}]"

BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
NOT_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# Shorter forms for a boundary whose neighbour inside the match is a word character.
STARTS_WORD = r"(?<![A-Za-z0-9_])"
ENDS_WORD = r"(?![A-Za-z0-9_])"

_OPENING = re.compile(r"\((?:\?(?::|=|!|<=|<!|<(?P<name>[^>]*)>))?")
_REPEAT = re.compile(r"(?:[*+?]|\{(?P<low>\d+)(?:,(?P<high>\d*))?\})\??")
_ESCAPED = re.compile(r"\\(?:c[A-Za-z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|k<[^>]*>|[1-9]\d*|.)", re.DOTALL)
_NAME = re.compile(r"[^\W\d][\w$]*")
# A class of word characters only.
_WORD_CLASS = re.compile(r"\[(?:[a-z](?:-[a-z])?|[A-Z](?:-[A-Z])?|[0-9](?:-[0-9])?|_|\\[dw])+\]")
_SAME = set("dDwWfnrt")


class InvalidPattern(ValueError):
    """The pattern is no valid pattern of the browser dialect."""


class Untranslatable(ValueError):
    """The pattern is valid but says something that the JVM cannot."""


@dataclass(frozen=True)
class Translated:
    regex: str
    can_be_empty: bool
    #: A pattern with the same matches but the empty ones: "" if there are no others, None if none is known.
    visible: str | None = None


def translate(pattern: str) -> Translated:
    """The pattern on the JVM, where it matches the same strings, and whether it can match the empty string."""
    reader = _Reader(pattern)
    empty = reader.alternatives()
    if reader.at < len(pattern):
        raise InvalidPattern("unmatched )")
    if reader.most_referred > reader.groups:
        raise Untranslatable("a number behind a backslash that is no group")
    regex = "".join(reader.out)
    return Translated(regex, empty, _visible(pattern, reader.consumes) if empty else regex)


def _visible(pattern: str, consumes: bool) -> str | None:
    if not consumes:
        return ""
    reader = _Reader(pattern)
    reader.term()
    if reader.at < len(pattern) or reader.repeat is None or reader.optional_nothing:
        return None
    # One thing that may be left out, with nothing behind it: taken wherever it is there, or never if that comes first.
    repeat, atom = reader.repeat, "".join(reader.out[:-1])
    lazy, high = len(repeat[0]) > 1 and repeat[0][-1] == "?", repeat["high"]
    if lazy or (repeat["low"] is not None and not int(high or 0) and high != ""):
        return ""
    return atom + {"?": "", "*": "+"}.get(repeat[0], f"{{1,{high}}}")


def to_jvm(pattern: str) -> str:
    """Translate one pattern; the result matches the same strings on the JVM."""
    return translate(pattern).regex


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.text, self.at, self.out = pattern, 0, []
        self.groups = self.most_referred = 0
        self.names: dict[str, str] = {}
        # Whether what was read last ends with a word character; None if that depends on the text.
        self.word: bool | None = None
        self.consumes = False  # anything but assertions has been read
        # The quantifier read last, and whether what it repeats can match the empty string.
        self.repeat: re.Match[str] | None = None
        self.optional_nothing = False

    def alternatives(self) -> bool:
        """Reads up to a closing parenthesis or the end; true if it can match the empty string."""
        empty, sequence = False, True
        self.word = None
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.out.append("|")
                self.at += 1
                empty, sequence = empty or sequence, True
                self.word = None
            else:
                sequence &= self.term()
        return empty or sequence

    def term(self) -> bool:
        begin, c, consumes = self.at, self.text[self.at], self.consumes
        fixed = False  # an assertion, which cannot be repeated
        if c == "(":
            empty, fixed = self.group()
        elif c == "[":
            self.character_class()
            empty = False
        elif c == "\\":
            empty, fixed = self.escape()
        elif c in "^$":
            self.out.append(r"\z" if c == "$" else "^")
            self.at += 1
            empty = fixed = True
        elif c in "*+?" or _REPEAT.match(self.text, self.at):
            raise InvalidPattern("nothing to repeat")
        else:
            self.literal()
            empty = False
        asserts = c in "^$" or self.text.startswith((r"\b", r"\B", "(?=", "(?!", "(?<=", "(?<!"), begin)
        self.consumes = consumes or not asserts
        kind = None if empty else self.word_at(begin, self.at)
        empty = self.repeated(empty, fixed)
        self.word = None if empty else kind
        return empty

    def word_at(self, begin: int, end: int) -> bool | None:
        """Whether an atom matches word characters only (True) or none of them (False)."""
        atom = self.text[begin:end]
        if len(atom) == 1 and atom not in "(.":
            return bool(re.fullmatch("[A-Za-z0-9_]", atom))
        if _WORD_CLASS.fullmatch(atom) or atom in (r"\d", r"\w"):
            return True
        if atom in (r"\s", r"\W") or re.fullmatch(r"\\[!-/:-@\[-^`{-~]", atom):
            return False
        return None

    def boundary(self) -> str:
        """A word boundary in the shortest form; what comes next is looked at first, as it seldom fits."""
        if self.word is not None:
            return ENDS_WORD if self.word else "(?=[A-Za-z0-9_])"
        rest = self.text[self.at : self.at + 1]
        if rest and rest not in "|()*+?^$.{":
            ahead = _Reader(self.text)
            ahead.at = self.at
            if rest == "[":
                ahead.character_class()
            elif rest == "\\":
                ahead.escape(plain=True)
            else:
                ahead.literal()
            kind, found = self.word_at(self.at, ahead.at), _REPEAT.match(self.text, ahead.at)
            if kind is not None and (found is None or not _may_be_none(found)):
                return f"(?={''.join(ahead.out)})" + (STARTS_WORD if kind else "(?<=[A-Za-z0-9_])")
        return BOUNDARY

    def literal(self) -> None:
        c = self.text[self.at]
        self.out.append(r"[^\n\r\u2028\u2029]" if c == "." else "\\" + c if c in "{}]" else c)
        self.at += 1

    def repeated(self, empty: bool, fixed: bool) -> bool:
        found = _REPEAT.match(self.text, self.at)
        self.repeat, self.optional_nothing = found, empty
        if not found:
            return empty
        if fixed:
            raise InvalidPattern("an assertion is repeated")
        low, high = found["low"], found["high"]
        if low and high and int(low) > int(high):
            raise InvalidPattern("numbers out of order")
        self.out.append(found[0])
        self.at = found.end()
        return empty or _may_be_none(found)

    def group(self) -> tuple[bool, bool]:
        opening = _OPENING.match(self.text, self.at)
        if self.text.startswith("(?", self.at) and len(opening[0]) == 1:
            raise InvalidPattern("unknown group")
        self.at, name = opening.end(), opening["name"]
        if name is not None:
            if not _NAME.fullmatch(name) or name in self.names:
                raise InvalidPattern("bad group name")
            self.names[name] = f"named{len(self.names)}"
            self.groups += 1
            self.out.append(f"(?<{self.names[name]}>")
        else:
            self.groups += opening[0] == "("
            self.out.append(opening[0])
        empty = self.alternatives()
        if not self.text.startswith(")", self.at):
            raise InvalidPattern("missing )")
        self.out.append(")")
        self.at += 1
        looks = opening[0] in ("(?=", "(?!", "(?<=", "(?<!")
        return empty or looks, opening[0] in ("(?<=", "(?<!")

    def escape(self, plain: bool = False) -> tuple[bool, bool]:
        """Reads an escape; with ``plain`` only if it stands for a character or class."""
        found = _ESCAPED.match(self.text, self.at)
        if not found:
            raise InvalidPattern("\\ at the end")
        self.at, atom = found.end(), found[0]
        rest = atom[1:]
        if plain and (rest in ("b", "B") or rest[0] in "123456789" or rest.startswith("k<")):
            return False, False
        if rest in ("b", "B"):
            self.out.append(self.boundary() if rest == "b" else NOT_BOUNDARY)
            return True, True
        if rest[0] in "123456789":
            self.most_referred = max(self.most_referred, int(rest))
            self.out.append(f"(?:{atom})")
            return True, False
        if rest.startswith("k<"):
            if rest[2:-1] not in self.names:
                raise Untranslatable("a reference to a name that comes later or not at all")
            self.out.append(rf"\k<{self.names[rest[2:-1]]}>")
            return True, False
        self.out.append(SPACE if rest == "s" else f"[^{SPACE_SET}]" if rest == "S" else _character(atom))
        return False, False

    def character_class(self) -> None:
        text = self.text
        if text.startswith("[^]", self.at):
            # "[]" never matches and "[^]" matches anything in the browser dialect.
            self.out.append(r"[\s\S]")
            self.at += 3
            return
        if text.startswith("[]", self.at):
            self.out.append(r"(?!)")
            self.at += 2
            return
        parts = ["["]
        self.at += 1
        if text.startswith("^", self.at):
            parts.append("^")
            self.at += 1
        while not text.startswith("]", self.at):
            if self.at >= len(text):
                raise InvalidPattern("missing ]")
            if text[self.at] != "\\":
                parts.append("\\" + text[self.at] if text[self.at] in "[&^" else text[self.at])
                self.at += 1
                continue
            found = _ESCAPED.match(text, self.at)
            if not found:
                raise InvalidPattern("\\ at the end")
            self.at, atom = found.end(), found[0]
            rest = atom[1:]
            if rest[0] in "123456789":
                raise Untranslatable("an octal number in a class")
            if rest.startswith("k<"):
                self.at -= len(rest) - 1
                atom = rest = "\\k"
            special = {"s": SPACE_SET, "S": f"[^{SPACE_SET}]", "b": r"\x08"}
            parts.append(special.get(rest, _character(atom)))
        self.at += 1
        self.out.append("".join(parts) + "]")


def _may_be_none(repeat: re.Match[str]) -> bool:
    """A quantifier that allows for no repetition at all."""
    return repeat[0][0] in "*?" or (repeat["low"] is not None and int(repeat["low"]) == 0)


def _character(atom: str) -> str:
    """An escaped character or class outside of what differs by place."""
    rest = atom[1:]
    if rest in _SAME or rest[0] in "xu" and len(rest) > 1:
        return atom
    if rest == "v":
        return r"\x0B"
    if rest == "0":
        return r"\x00"
    if rest[0] == "c" and len(rest) == 2:
        return rf"\x{ord(rest[1]) % 32:02x}"
    if rest == "c":
        return r"\\c"
    # Anything else stands for itself.
    return rest if rest.isalnum() or ord(rest) > 127 or rest in "_\n" else "\\" + rest


def literal(text: str) -> str:
    """A pattern that matches ``text`` as it stands (JVM and RE2)."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text)
