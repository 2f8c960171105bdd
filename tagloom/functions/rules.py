"""Rules as data, compiled to Column expressions while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import patterns
from tagloom.functions.text import clean_markup


@dataclass(frozen=True)
class Rule:
    """When ``pattern`` is found in column ``field``, the value is ``value``."""

    field: str
    pattern: str
    value: object


@dataclass(frozen=True)
class Keyword:
    """One dictionary entry: a tag name and the pattern that signals it."""

    tag: str
    pattern: str
    case_sensitive: bool = False

    @property
    def anchored(self) -> str:
        return patterns.whole_word(self.pattern)


def _literal(value: object) -> str:
    if value is None or isinstance(value, bool):
        return "NULL" if value is None else str(value).upper()
    return patterns.sql_text(str(value))


def first_match(rules: Sequence[Rule], default: object = None, dtype: str = "string") -> Column:
    """Value of the first rule that matches, else ``default``.

    A rule value may be null; it still ends the search. A null field matches nothing.
    """
    cases = " ".join(
        f"WHEN {patterns.matches_sql(f'`{r.field}`', r.pattern)} THEN {_literal(r.value)}"
        for r in rules
    )
    chosen = f"CASE {cases} ELSE {_literal(default)} END" if rules else _literal(default)
    return F.expr(f"CAST({chosen} AS {dtype})")


def _folded(text: Column) -> Column:
    """Lower case as a case-blind match sees it: also for long s, dotless and dotted i."""
    folded = lower = F.lower(text)
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    # a text of single bytes holds none of them
    return F.when(F.octet_length(text) == F.length(text), lower).otherwise(folded)


class _Finder:
    """Cheap tests that come before the regex of a dictionary entry.

    A text is read once and only the lead words of the dictionary are kept.
    The regex of an entry runs on texts that have one of its lead words.
    """

    def __init__(self, dictionary: Sequence[Keyword]):
        self.dictionary = list(dictionary)
        self.lead = {entry: patterns.lead_words(entry.anchored) for entry in dictionary}
        words = [w for found in self.lead.values() for w in found or []]
        self.whole = sorted({w.text for w in words if w.whole})

    def words(self, folded: Column) -> Column:
        known = F.array(*[F.lit(w) for w in self.whole]).cast("array<string>")
        return F.array_intersect(F.split(folded, "[^a-z0-9]+"), known)

    def found(self, folded: Column) -> Column:
        """The words of a text that are lead words or begin with one that may go on.

        One regex reads the text once; most words end at their first or second letter.
        """
        words = [w for found in self.lead.values() for w in found or []]
        if not words:
            return F.array().cast("array<string>")
        text = F.concat(F.lit(" "), folded)
        return F.array_distinct(F.regexp_extract_all(text, F.lit(patterns.lead_word_regex(words)), F.lit(1)))

    def entries(self, found: str) -> Column:
        """Places in the dictionary, ascending, of the entries whose regex is worth a try on a text.

        ``found`` has the text's lead words: one look-up for each that is whole; an entry with a
        lead word that may go on is tried where one holds it, one without lead words always.
        """
        by_word: dict[str, list[int]] = {}
        others = []
        joined = f"array_join({found}, ' ')"
        for place, words in enumerate(map(self.lead.get, self.dictionary)):
            open_ended = [w for w in words or [] if not w.whole]
            for word in words or []:
                if word.whole:
                    by_word.setdefault(word.text, []).append(place)
            if words is None:
                others.append(str(place))
            elif open_ended:
                held = " OR ".join(f"contains({joined}, {patterns.sql_text(w.text)})" for w in open_ended)
                others.append(f"CASE WHEN {held} THEN {place} END")
        pairs = ", ".join(f"{patterns.sql_text(w)}, array({', '.join(map(str, at))})" for w, at in by_word.items())
        tried = f"array_compact(CAST(array({', '.join(others)}) AS array<int>))"
        if by_word:
            known = f"map({pairs})"
            words = f"array_intersect({found}, map_keys({known}))"
            tried = f"concat(flatten(transform({words}, w -> {known}[w])), {tried})"
        return F.expr(f"array_sort(array_distinct({tried}))")

    def test(self, entry: Keyword, text: str, folded: str, words: str) -> str:
        regex = patterns.matches_sql(text, entry.anchored, ignore_case=not entry.case_sensitive)
        if self.lead[entry] is None:
            return regex
        guards = []
        for word in self.lead[entry]:
            wanted = patterns.sql_text(word.text)
            guard = (
                f"array_contains({words}, {wanted})"
                if word.whole
                else f"contains({folded}, {wanted})"
            )
            if entry.case_sensitive:
                guard = f"({guard} AND contains({text}, {patterns.sql_text(word.literal)}))"
            guards.append(guard)
        return f"(({' OR '.join(guards)}) AND {regex})"


def with_keyword_tags(
    df: DataFrame,
    fields: Sequence[str],
    dictionary: Sequence[Keyword],
    out: str,
    markup: bool = True,
) -> DataFrame:
    """Add array column ``out``: tags of all entries found in the joined ``fields``.

    Tags come in dictionary order; two entries with the same tag may both appear. The
    cleaned text is projected once, so that each entry only tests it.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    if markup:
        parts = [clean_markup(p) for p in parts]
    finder = _Finder(dictionary)
    cleaned = df.withColumn("__text", F.concat_ws(" ", *parts))
    cleaned = cleaned.withColumn("__found", finder.found(_folded(F.col("__text"))))
    cleaned = cleaned.withColumn("__entries", finder.entries("__found"))
    tried = [patterns.first_letter_first(e.anchored) for e in dictionary]
    regexes = [patterns.java_regex(r, ignore_case=not e.case_sensitive) for r, e in zip(tried, dictionary)]
    listed = {
        name: f"array({', '.join(map(patterns.sql_text, values))})"
        for name, values in (("regexes", regexes), ("tags", [e.tag for e in dictionary]))
    }
    found = f"filter(__entries, i -> rlike(__text, {listed['regexes']}[i]))" if dictionary else "__entries"
    tags = F.expr(f"CAST(transform({found}, i -> {listed['tags']}[i]) AS array<string>)")
    return cleaned.withColumn(out, tags).drop("__text", "__found", "__entries")


def _evidence(finder: _Finder, entry: Keyword, fields: Sequence[str], context: int) -> str:
    """Struct for the first field in which the entry is found, else null."""
    regex = patterns.java_regex(entry.anchored, ignore_case=not entry.case_sensitive)
    cases = []
    for i, field in enumerate(fields):
        text = f"__f{i}"
        # p holds the text before and after the first match
        around = f"split({text}, {patterns.sql_text(regex)}, 2)"
        shown = (
            f"substring({text}, greatest(length(p[0]) - {context}, 0) + 1, least(length(p[0]), "
            f"{context}) + length({text}) - length(p[0]) - length(p[1]) + {context})"
        )
        cases.append(
            f"WHEN {finder.test(entry, text, f'__g{i}', f'__w{i}')} THEN named_struct("
            f"'tag', {patterns.sql_text(entry.tag)}, 'field', {patterns.sql_text(field)}, "
            f"'snippet', get(transform(array({around}), p -> {shown}), 0), "
            f"'pattern', {patterns.sql_text(entry.pattern)}, "
            f"'effective_pattern', {patterns.sql_text(entry.anchored)})"
        )
    return f"CASE {' '.join(cases)} END"


def keyword_evidence(
    df: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    dictionary: Sequence[Keyword],
    markup: bool = True,
    context: int = 40,
) -> DataFrame:
    """One row per (row, entry) hit: the first field that matches and a snippet of it.

    An entry whose match spans two fields has no single field to show and yields no row.
    """
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    texts = df.select(
        *key,
        *[(clean_markup(v) if markup else v).alias(f"__f{i}") for i, v in enumerate(values)],
    )
    finder = _Finder(dictionary)
    at = range(len(fields))
    texts = texts.select("*", *[_folded(F.col(f"__f{i}")).alias(f"__g{i}") for i in at])
    texts = texts.select("*", *[finder.words(F.col(f"__g{i}")).alias(f"__w{i}") for i in at])
    records = ", ".join(_evidence(finder, entry, fields, context) for entry in dictionary)
    found = texts.select(*key, F.explode(F.expr(f"array_compact(array({records}))")).alias("e"))
    snippet = F.concat(F.lit("..."), patterns.strip(F.col("e.snippet")), F.lit("..."))
    return found.select(
        *key, "e.tag", "e.field", snippet.alias("snippet"), "e.pattern", "e.effective_pattern"
    )


@dataclass(frozen=True)
class AtLeast:
    """At least ``k`` of ``names`` are in the tag array."""

    names: tuple[str, ...]
    k: int = 1

    def test(self, tags: Column) -> Column:
        names = F.array(*[F.lit(n) for n in self.names])
        if self.k == 1:
            return F.arrays_overlap(tags, names)
        return F.size(F.array_intersect(tags, names)) >= self.k


def any_of(*names: str) -> AtLeast:
    return AtLeast(names)


def at_least(k: int, *names: str) -> AtLeast:
    return AtLeast(names, k)


def segment(
    tags: Column, rules: Sequence[tuple[str, Sequence[Sequence[AtLeast]]]]
) -> Column:
    """First segment with a case whose conditions all hold; null when there is none.

    ``rules`` lists ``(segment, cases)`` in priority order; a case is a list of
    conditions that must hold together, and one true case is enough.
    """
    present = F.coalesce(tags, F.array().cast("array<string>"))
    result = F.lit(None).cast("string")
    for name, cases in reversed(rules):
        holds = reduce(or_, [reduce(and_, [c.test(present) for c in case]) for case in cases])
        result = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(result)
    return result
