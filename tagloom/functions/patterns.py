"""Regular expressions: one reading of a pattern on every Java version.

Rules are written in the usual (Perl-like, Unicode-aware) syntax. Java needs the
Unicode flag stated for ``\\b``, ``\\w`` and case folding, and unix-lines mode so that
``.`` stops only at a newline.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# All white space but the blank, spelled out: the ASCII separators are not in Java's class.
_LATIN_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_FAR_SPACES = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[ {_LATIN_SPACES}{_FAR_SPACES}]"
_ANY_SPACE = "".join(filter(re.compile(WS).match, map(chr, range(0x3001))))


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Add the flags that make Java read ``pattern`` in the Unicode-aware way."""
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[len("(?i)") :], True
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where ``pattern`` is found anywhere in ``col``; null stays null."""
    return F.rlike(col, F.lit(java_regex(pattern, ignore_case)))


def sql_text(value: str) -> str:
    """A string literal for ``F.expr``."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def matches_sql(column: str, pattern: str, ignore_case: bool = False) -> str:
    """The test of ``matches`` as text, for long rule lists parsed in one go."""
    return f"rlike({column}, {sql_text(java_regex(pattern, ignore_case))})"


def replace(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, java_regex(pattern), replacement)


def collapse_spaces(col: Column) -> Column:
    """One blank for every run of white space, none at the ends.

    Spaces outside Latin-1 are looked for only in texts that can hold them. A lone blank
    is no match, so ordinary text is hardly rewritten, and a letter is tested once.
    """
    may_be_far = (F.octet_length(col) != F.length(col)) & F.rlike(col, F.lit(r"[\u1680-\u3000]"))
    near = F.when(may_be_far, replace(col, f"[{_FAR_SPACES}]", " ")).otherwise(col)
    space = f"[ {_LATIN_SPACES}]"
    runs = f"{space}(?:(?<! )|(?={space})){space}*"
    return F.trim(replace(near, runs, " "))


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks; only the ends are read."""
    return F.trim(col, F.lit(_ANY_SPACE))


# Does a pattern begin / end on a word character, looking through one group bracket?
_STARTS_IN_WORD = re.compile(r"(?:\(\?:)?\w", re.ASCII)
_ENDS_IN_WORD = re.compile(r"\w(?:\)[?*+]?)?\Z", re.ASCII)


def whole_word(pattern: str) -> str:
    """Anchor a dictionary pattern with ``\\b`` on each side that is a word character.

    A side that already carries ``\\b`` is left alone. ``Node(?:\\.js)?`` is anchored on
    the right, because its group ends in a letter; ``C\\+\\+`` is not.
    """
    edge = r"\b"
    open_left = _STARTS_IN_WORD.match(pattern) and not pattern.startswith(edge)
    open_right = _ENDS_IN_WORD.search(pattern) and not pattern.endswith(edge)
    return f"{edge if open_left else ''}{pattern}{edge if open_right else ''}"


def _alternatives(body: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in body:
        depth += (char == "(") - (char == ")")
        if char == "|" and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


def _leading_literal(pattern: str) -> tuple[str, str]:
    """Plain characters a pattern begins with, and the rest of it."""
    literal, rest = "", pattern
    while step := re.match(r"[A-Za-z0-9 /#-]|\\[.+]", rest):
        literal += step.group()[-1]
        rest = rest[step.end() :]
    if rest[:1] in ("?", "*", "{"):
        return literal[:-1], literal[-1:] + rest
    return literal, rest


@dataclass(frozen=True)
class LeadWord:
    """A word that every match of a pattern begins with (after any signs).

    ``whole`` tells that the word ends there; otherwise longer words may begin with it.
    """

    text: str
    whole: bool
    literal: str


def lead_words(pattern: str) -> list[LeadWord] | None:
    """Lead words of an anchored pattern, of which each match has one.

    None means that they cannot be read off the pattern, or that one is so short that
    it would begin too many words; such a pattern has to be tried on every text.
    """
    right_anchored = pattern.endswith(r"\b")
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    optional_prefix = re.match(r"\(\?:([^()]*)\)\?", body)
    options = []
    if optional_prefix:
        options.append(optional_prefix.group(1))
        body = body[optional_prefix.end() :]
    if body.startswith("(?:") and body.endswith(")"):
        body = body[3:-1]
    words = []
    for option in [*options, *_alternatives(body)]:
        literal, rest = _leading_literal(option)
        word = re.match(r"[^A-Za-z0-9]*([A-Za-z0-9]+)", literal)
        if word is None:
            return None
        followed = literal[word.end() :] != "" or rest.startswith(r"\s+")
        whole = followed or (rest == "" and right_anchored and option not in options)
        if len(word.group(1)) < 3 and not whole:
            return None
        words.append(LeadWord(word.group(1).lower(), whole, literal))
    return words


def _begins(words: set[tuple[str, bool]]) -> str:
    """A regex for the beginnings of words, letter by letter, so that each letter is read once."""
    if ("", False) in words:
        return ""
    by_letter: dict[str, set[tuple[str, bool]]] = {}
    for text, whole in words - {("", True)}:
        by_letter.setdefault(text[0], set()).add((text[1:], whole))
    parts = [letter + _begins(rest) for letter, rest in sorted(by_letter.items())]
    if ("", True) in words:
        parts.append("(?![a-z0-9])")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def first_letter_first(pattern: str) -> str:
    """``pattern`` behind a test of the letter its matches begin with.

    That is cheaper at each place of a text than the test for the edge of a word.
    """
    words = lead_words(pattern)
    if not words:
        return pattern
    letters = "".join(sorted({re.escape(w.literal[0]) for w in words}))
    return f"(?=[{letters}]){pattern}"


def lead_word_regex(words: list[LeadWord]) -> str:
    """Finds, in lower-cased text, each word that is one of ``words`` or begins with an open-ended one.

    The word is group 1; the sign before it is read as well, so a text must not begin with a word.
    """
    begun = {(w.text, w.whole) for w in words}
    first = "".join(sorted({text[0] for text, _ in begun}))
    return f"[^a-z0-9](?=[{first}])(?={_begins(begun)})([a-z0-9]+)"
