"""Parsing of glossary lines: predicates, cleaners, extractors and splitters; all are column expressions.

A splitter is a list of rules.  Each rule gives a (term, definition) pair or null,
and the first pair wins; what no rule splits is a term without a definition.  The
layouts differ only in their rules' limits, so the rules are data here.

Results for odd input: null and empty texts have no term and no definition; a
predicate of null is null; an extractor finds nothing in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import SHAD, TIBETAN, TSEK

#: fixed values: what ends a term, words that ask for it, and marks
COMPLETION = "རྐྱེན།"
ASKING = ["པའི་", "པའེ་", "བའི་", "བའེ་"]
ASKING_PATTERN = "[པབ]འ[ིེ]་$"
MARKS = ["།", "༎", "༏", "ལ་གོ།", "ཞེས་བྱ།"]
STROKES = ["།", "༏", "༎", "༑"]
SYLLABLE_ENDS = ["།", "པའི", "པའེ", "བའི", "རྐྱེན"]
#: fixed values: words of headers that are no terms
HEADERS = ["abbreviations", "glossary", "terms", "page", "tibetan"]
#: fixed values: an English term, a subject, Tibetan text, and scripts other than Latin
ENGLISH = r"[a-zA-Z][a-zA-Z\s'-]*"
SUBJECT, SUBJECTS = "[a-z]{2,6}", "[a-z]{2,6}(?:,[a-z]{2,6})*"
BODY = r"[ༀ-࿿][ༀ-࿿\s་།]*"
OTHER_SCRIPTS = "[ༀ-࿿一-鿿֐-׿Ѐ-ӿ]"
#: fixed values: the extractors' patterns, of whole pages, line by line
EXTRACTORS = {
    "main": rf"(?m)^([a-zA-Z][a-zA-Z\s'-]+?)\s+({SUBJECT})\s+({BODY})",
    "abbreviation": rf"(?m)^([a-zA-Z]+\.)\s+([A-Za-z][A-Za-z\s'-]+?)\s+({BODY})",
    "failed": r"(?m)^([a-zA-Z][a-zA-Z\s'-]+?)\s+([a-z]+(?:,\s*[a-z]+)*)\s+([A-Za-z0-9\s]{5,})",
    "two_lines": rf"([a-zA-Z][a-zA-Z\s'-]+?)\s*\n([a-zA-Z][a-zA-Z\s'-]*?)\s+([a-z]+(?:,\s*[a-z]+)*)\s+({BODY})",
    "free": rf"([a-zA-Z][a-zA-Z\s'-]+?)\s+([a-z]+(?:[.,]\s*[a-z]+)*)\s+({BODY})",
}
FOUR_COLUMNS = {
    "abbreviation": r"(?m)^([a-zA-Z]+\.)\s+([A-Za-z][A-Za-z\s'-]+?)\s+([ༀ-࿿][ༀ-࿿\s]+)",
    "main": rf"([a-zA-Z][a-zA-Z\s'-]*?)(?:\s*\n([a-zA-Z][a-zA-Z\s'-]*?))?\s+({SUBJECT})\s+([ༀ-࿿][ༀ-࿿\s.]+)",
}


def strip(c: Column) -> Column:
    """Without white space and control characters at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def matches(c: Column, pattern: str) -> Column:
    """Whether the whole text is of the pattern."""
    return c.rlike(rf"\A(?:{pattern})\z")


def words(c: Column) -> Column:
    return F.split(strip(c), r"\s+")


def from_place(c: Column, start: Column) -> Column:
    """The text from a place (from 0) on."""
    return F.substr(c, start + 1, F.greatest(F.length(c) - start, F.lit(0)))


def spaced(parts: Column, first, n) -> Column:
    """``n`` of the words, from ``first`` (from 1) on, with spaces between them."""
    return F.array_join(F.slice(parts, first, F.greatest(n, F.lit(0))), " ")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n)))


# cleaners


def clean_page(c: Column) -> Column:
    """A page's text without a lone page number, rules and wide blanks."""
    for pattern, to in ((r"\A\d+\s*\z", ""), ("[─━═-]{3,}", ""), (r"\s{3,}", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def clean_english(c: Column) -> Column:
    return F.lower(F.regexp_replace(squeeze(c), r"^[^a-zA-Z]+|[^a-zA-Z\s'-]+$", ""))


def clean_english_column(c: Column) -> Column:
    """As ``clean_english``, but case stays, other characters become blanks, and a last ``x`` or number goes."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+x\s*$", ""), r"\s+[0-9]+\s*$", "")
    return squeeze(F.regexp_replace(c, r"[^a-zA-Z\s'-]", " "))


def clean_tibetan(c: Column) -> Column:
    return strip(F.regexp_replace(squeeze(c), "།{2,}$", "།"))


def clean_tibetan_column(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"\s+x\s*$", ""))


def clean_entry(c: Column) -> Column:
    return F.lower(F.regexp_replace(squeeze(c), r"^[^a-zA-Zༀ-࿿]+|[^a-zA-Zༀ-࿿\s'-]+$", ""))


def without_english(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"\b[a-zA-Z]+\b", ""))


# predicates


def starts_with_english(c: Column) -> Column:
    return c.rlike(r"\A[a-zA-Z]")


def starts_with_lower_case(c: Column) -> Column:
    return c.rlike(r"\A[a-z]")


def completes(c: Column) -> Column:
    """Whether a line may complete a term: Tibetan text before a shad."""
    return c.rlike(f"{TIBETAN}{SHAD}")


def is_subject(c: Column) -> Column:
    return matches(c, SUBJECT)


def is_english(c: Column) -> Column:
    return matches(c, ENGLISH)


def is_english_word(c: Column) -> Column:
    """Two letters or more, among any other characters."""
    return F.length(F.regexp_replace(c, "[^a-zA-Z'-]", "")) >= 2


def is_term(c: Column) -> Column:
    return (F.length(c) >= 3) & c.rlike("[a-zA-Z]")


def is_column_english(c: Column) -> Column:
    return matches(strip(c), ENGLISH) & (F.length(strip(c)) >= 3)


def has_other_script(c: Column) -> Column:
    return c.rlike(OTHER_SCRIPTS)


def has_content(c: Column) -> Column:
    return (F.length(strip(c)) > 3) & c.rlike("[a-zA-Zༀ-࿿]")


def valid_pair(english: Column, tibetan: Column) -> Column:
    return F.length(english).between(2, 100) & (F.length(tibetan) >= 2) & (tibetan.rlike(TIBETAN) | tibetan.startswith("[Tibetan OCR failed")) & is_english(english)


def valid_english(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.length(t).between(2, 50) & is_english(t) & ~t.isin(HEADERS)


def valid_entry(english: Column, tibetan: Column) -> Column:
    return F.length(english).between(3, 50) & (F.length(tibetan) >= 2) & tibetan.rlike(TIBETAN) & is_english(english) & ~english.isin([*HEADERS, "serial"])


def valid_column_entry(english: Column, tibetan: Column) -> Column:
    return F.length(english).between(2, 100) & (F.length(strip(english)) >= 2) & (F.length(strip(tibetan)) >= 2) & tibetan.rlike(TIBETAN) & is_english(english)


# splitters


@dataclass(frozen=True)
class Completed:
    """The word before the completion, with it, is the term: the last word that asks for it, else the last one if ``fallback``.

    ``whole``: the term is all up to the completion; ``near``: only the last two words are looked at.
    """

    first: int = 0
    whole: bool = False
    near: bool = False
    asking: str | None = None
    holding: str | None = None
    fallback: bool = False
    term: int = 0
    definition: int = 0

    def pair(self, c: Column) -> Column:
        at = F.instr(c, COMPLETION)
        before, after = F.substring_index(c, COMPLETION, 1), from_place(c, at - 1 + len(COMPLETION))
        way = self._whole(before, after) if self.whole else let(words(before), lambda own: self._near(own, after) if self.near else self._back(own, after))
        return F.when(at > self.first, way)

    def _whole(self, before: Column, after: Column) -> Column:
        return let(_pair(strip(F.concat(before, F.lit(COMPLETION))), strip(after)), lambda p: F.when((F.length(p["term"]) >= self.term) & (F.length(p["definition"]) >= self.definition), p))

    def _asks(self, w: Column) -> Column:
        return (w.rlike(self.asking) if self.asking else F.lit(False)) | (w.contains(self.holding) if self.holding else F.lit(False))

    def _near(self, own: Column, after: Column) -> Column:
        n = F.size(own)

        def cut(asked: Column) -> Column:
            place = F.when(asked, n - 1).otherwise(n)
            kept = F.concat_ws(" ", spaced(own, 1, place - 1), F.when(asked, F.element_at(own, -1)), after)
            return _pair(F.concat(F.element_at(own, place), F.lit(COMPLETION)), strip(kept))

        return F.when(n >= 2, let(self._asks(F.element_at(own, F.when(n > 1, -2).otherwise(-1))), cut))

    def _back(self, own: Column, after: Column) -> Column:
        back = F.array_position(F.transform(F.reverse(own), self._asks), True).cast("int")
        place = F.when(back > 0, F.size(own) - back + 1).otherwise(F.size(own) if self.fallback else F.lit(0))

        def cut(at: Column) -> Column:
            kept = F.concat(F.when(at > 1, F.concat(spaced(own, 1, at - 1), F.lit(" "))).otherwise(""), strip(after))
            return F.when(at > 0, _pair(F.concat(F.element_at(own, F.greatest(at, F.lit(1))), F.lit(COMPLETION)), strip(kept)))

        return let(place, cut)


@dataclass(frozen=True)
class AtMark:
    """The text ends its term with the first of the marks that stands far enough from both ends and leaves parts of fitting lengths.

    ``earliest``: the mark that stands first decides, not the first in the list.
    """

    marks: tuple[str, ...]
    after: int
    before_end: int
    term: tuple[int, int] = (0, 10**9)
    definition: int = 0
    earliest: bool = False

    def pair(self, c: Column) -> Column:
        far = lambda m: let(F.instr(c, m) - 1, lambda p: F.when((p > self.after) & (p < F.length(c) - self.before_end), p + len(m)))
        ends = [far(m) for m in self.marks]
        if self.earliest:
            ends = [F.array_min(F.array(*ends))]
        return F.coalesce(*[let(end, lambda e: self._cut(c, e)) for end in ends])

    def _cut(self, c: Column, end: Column) -> Column:
        fits = lambda p: F.length(p["term"]).between(*self.term) & (F.length(p["definition"]) >= self.definition)
        return let(_pair(strip(F.left(c, end)), strip(from_place(c, end))), lambda p: F.when(end.isNotNull() & fits(p), p))


@dataclass(frozen=True)
class AtSpaces:
    """``least`` blanks or more end the term; the other parts are joined."""

    least: int
    each: int = 0

    def pair(self, c: Column) -> Column:
        def cut(parts: Column) -> Column:
            rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
            return let(_pair(strip(F.get(parts, 0)), rest), lambda p: F.when((F.size(parts) >= 2) & (F.length(p["term"]) >= self.each) & (F.length(p["definition"]) >= self.each), p))

        return let(F.split(c, rf"\s{{{self.least},}}"), cut)


@dataclass(frozen=True)
class ByWords:
    """Of ``least`` words or more the first ``most`` are the term, or a ``share`` of all if that is less; a word that ends as one of ``ends`` may end it sooner or later."""

    least: int
    most: int
    share: int = 0
    ends: tuple[str, ...] = ()
    upto: int = 0

    def pair(self, c: Column) -> Column:
        return let(words(c), lambda own: F.when(F.size(own) >= self.least, let(self._count(own), lambda cut: _pair(spaced(own, 1, cut), spaced(own, cut + 1, F.size(own) - cut)))))

    def _count(self, own: Column) -> Column:
        n = F.size(own)
        cut = F.least(F.lit(self.most), F.floor(n / self.share).cast("int")) if self.share else F.lit(self.most)
        for i in range(self.upto, self.most - 1, -1):
            ending = F.lit(False)
            for e in self.ends:
                ending = ending | F.get(own, F.lit(i - 1)).endswith(e)
            cut = F.when((n >= i) & ending, F.lit(i)).otherwise(cut)
        return cut


def _pair(term: Column, definition: Column) -> Column:
    return F.struct(term.alias("term"), definition.alias("definition"))


def _pair_if(condition: Column, term: Column, definition: Column) -> Column:
    return F.when(condition, _pair(term, definition))


#: fixed values: the layouts' rules
FOUR_COLUMN_RULES = (Completed(1, near=True, asking="(?:པའི་|པའེ་)$"), AtMark((SHAD,), 0, 1, (5, 30), 6), AtSpaces(3), ByWords(5, 3, ends=tuple(SYLLABLE_ENDS), upto=5))
LINE_RULES = (Completed(asking="(?:པའི་|པའེ་|བའི་|བའེ་)$", fallback=True), AtMark((SHAD,), 0, 1, (3, 50), 6), ByWords(4, 3))
COORDINATE_RULES = (Completed(whole=True), AtMark((SHAD,), 0, 3), ByWords(5, 3, share=3))
CHAIN_RULES = (Completed(whole=True, term=5, definition=3), AtMark(tuple(MARKS[:4]), 5, 5, (3, 10**9), 3), ByWords(7, 3), ByWords(4, 3, share=2))
SMART_RULES = (Completed(1, asking=ASKING_PATTERN, holding="མིན་པ"), AtMark(tuple(MARKS), 5, 5, (3, 50), 3), AtMark(tuple(STROKES), 8, 8, (3, 10**9), 3), ByWords(7, 4, share=3))
CONTENT_RULES = (AtMark((SHAD, ".", "!", "?", ";"), 0, 1, (3, 50), 4, earliest=True), AtSpaces(2), ByWords(5, 3))
REBUILT_RULES = (Completed(asking=ASKING_PATTERN, holding="མིན་པའ", fallback=True), AtMark(tuple(STROKES), 5, 5, (3, 50), 3), AtSpaces(2, 3), ByWords(5, 3, share=3))


def split_term(c: Column, rules: tuple) -> Column:
    """(term, definition) by the first rule that fits."""
    return let(strip(F.coalesce(c, F.lit(""))), lambda t: F.coalesce(*[r.pair(t) for r in rules], _pair(t, F.lit(""))))


def split_tsv_term(c: Column) -> Column:
    """(term, definition) of a word-table cell: at a shad, at two tseks, or of a long one at a syllable from place 25 to 39."""

    def split(t: Column) -> Column:
        rest = lambda at: strip(from_place(t, at + 1))
        at_shad = let(F.instr(t, SHAD) - 1, lambda at: _pair_if((at > 0) & (at < 50) & (F.length(rest(at)) > 10), F.left(t, at + 1), rest(at)))
        at_two = let(F.instr(t, TSEK + TSEK) - 1, lambda at: _pair_if((at > 10) & (at < 50), F.left(t, at), from_place(t, at + 2)))
        syllable = F.length(F.regexp_extract(F.substring(t, 26, 15), f"^[^{SHAD}{TSEK}]*[{SHAD}{TSEK}]", 0))
        long = let(syllable, lambda n: F.when(n > 0, _pair(F.left(t, n + 25), from_place(t, n + 25))).otherwise(_pair(F.concat(F.left(t, F.lit(30)), F.lit(SHAD)), from_place(t, F.lit(30)))))
        return F.coalesce(at_shad, at_two, F.when(F.length(t) > 60, long), _pair(t, F.lit("")))

    return let(F.coalesce(c, F.lit("")), split)


def split_chain_term(c: Column) -> Column:
    return split_term(clean_tibetan_column(c), CHAIN_RULES)


def split_by_position(c: Column, width: int = 25) -> Column:
    """(term, definition): near the end of a term column of ``width`` places at a mark or blank, else by ``SMART_RULES``."""

    def place(head: Column) -> Column:
        last = lambda m: F.when(head.contains(m), F.length(head) - F.instr(F.reverse(head), m))
        marks = [F.when(last(m) > width - 10, last(m) + 1) for m in MARKS[:3]]
        return F.coalesce(F.when(head.endswith(COMPLETION), F.lit(width)), *marks, F.when(last(" ") > width - 8, last(" ")))

    def split(t: Column) -> Column:
        cut = F.when(F.length(t) > width, let(F.left(t, F.lit(width)), place))
        return F.coalesce(let(cut, lambda n: _pair_if(n > 0, strip(F.left(t, n)), strip(from_place(t, n)))), split_term(t, SMART_RULES))

    return let(strip(F.coalesce(c, F.lit(""))), split)


# lines


def entry(english: Column, subject: Column, pair: Column) -> Column:
    return let(pair, lambda p: F.struct(english.alias("english"), subject.alias("subject"), p["term"].alias("term"), p["definition"].alias("definition")))


def line_boundaries(line: Column) -> Column:
    """Places where columns end: around a first subject, else before Tibetan text, else at every run of blanks."""
    known = r"(?s)^(.*?) ([a-z]{2,6}|[a-z]+,[a-z]+)(?: |$)"

    def at_runs(runs: Column) -> Column:
        return F.transform(running(F.transform(runs, F.length)), lambda e, i: e - F.length(F.regexp_extract(F.get(runs, i), "( +)$", 1)))

    def places(t: Column) -> Column:
        around = F.struct(F.length(F.regexp_extract(t, known, 1)).alias("first"), F.length(F.regexp_extract(t, known, 2)).alias("size"))
        at_subject = lambda p: F.when(p["size"] > 0, F.filter(F.array(p["first"], p["first"] + 1 + p["size"]), lambda x: x < F.length(t)))
        at_blank = let(F.regexp_extract(t, "(?s)^([^ༀ-࿿]*)[ༀ-࿿]", 1), lambda head: F.when(head.contains(" "), F.array(F.length(head) - F.instr(F.reverse(head), " "))))
        return F.coalesce(let(around, at_subject), at_blank, let(F.regexp_extract_all(t, F.lit("[^ ]+( +)"), F.lit(0)), at_runs))

    return let(line, places)


def parse_line(line: Column) -> Column:
    """(english, subject, term, definition) of a line by its columns' boundaries; a line without a blank has no English."""

    def parsed(t: Column, at: Column) -> Column:
        place = lambda i: F.get(at, F.lit(i))
        piece = lambda i, j: strip(F.substr(t, place(i) + 1, place(j) - place(i)))
        n = F.size(at)
        pair = F.when(n >= 3, _pair(piece(1, 2), strip(from_place(t, place(2))))).when(n == 2, split_term(from_place(t, place(1)), LINE_RULES)).otherwise(_pair(F.lit(""), F.lit("")))
        return entry(F.when(n >= 1, strip(F.left(t, place(0)))).otherwise(""), F.when(n >= 2, piece(0, 1)).otherwise(""), pair)

    return let(strip(line), lambda t: let(line_boundaries(t), lambda at: parsed(t, at)))


def _leading_english(own: Column) -> Column:
    """How many of the words, from the first on, are English."""
    return let(F.array_position(F.transform(own, is_english_word), False).cast("int"), lambda stop: F.when(stop > 0, stop - 1).otherwise(F.size(own)))


def by_pattern(line: Column) -> Column:
    """English, a subject and Tibetan text in this order; null if a part is missing."""

    def english(t: Column) -> Column:
        ahead = F.regexp_extract(t, rf"^([a-zA-Z][a-zA-Z\s'-]*?)(?=\s+[a-z]{{2,6}}\s|\s+[ༀ-࿿])", 1)
        lead = let(F.split(t, r"\s+"), lambda own: spaced(own, 1, _leading_english(own)))
        return let(ahead, lambda a: F.when(a != "", clean_english_column(a)).otherwise(lead))

    def found(t: Column, e: Column) -> Column:
        body = lambda rest, subject: let(strip(from_place(rest, F.length(subject))), lambda b: F.when((e != "") & (subject != "") & b.rlike(TIBETAN), entry(e, subject, split_chain_term(b))))
        return let(strip(from_place(t, F.length(e))), lambda rest: let(F.regexp_extract(rest, rf"^({SUBJECTS})(?=\s|$)", 1), lambda subject: body(rest, subject)))

    return let(strip(F.regexp_replace(line, r"\s+x\s*$", "")), lambda t: let(english(t), lambda e: found(t, e)))


def by_words(line: Column) -> Column:
    """Leading English words, perhaps a subject, and all from the first word with Tibetan on; null without English or Tibetan."""

    def found(own: Column, count: Column) -> Column:
        n = F.size(own)
        subject = let(F.get(own, count), lambda w: F.when((count > 0) & is_subject(w), w).otherwise(""))

        def rest(s: Column) -> Column:
            after = count + F.when(s != "", 1).otherwise(0)
            left = F.slice(own, after + 1, F.greatest(n - after, F.lit(0)))
            start = lambda x: F.array_position(F.transform(x, lambda w: w.rlike(TIBETAN)), True).cast("int")
            body = lambda x, k: F.array_join(F.slice(x, F.greatest(k, F.lit(1)), F.size(x)), " ")
            return let(left, lambda x: let(start(x), lambda k: F.when((count > 0) & (k > 0), entry(clean_english_column(spaced(own, 1, count)), s, split_term(body(x, k), SMART_RULES)))))

        return let(F.coalesce(subject, F.lit("")), rest)

    return let(F.split(line, r"\s+"), lambda own: let(_leading_english(own), lambda count: found(own, count)))


def by_whole_pattern(line: Column) -> Column:
    """A line that is English, perhaps a subject, and Tibetan or ASCII text to its end."""
    with_subject = rf"^([a-zA-Z][a-zA-Z\s'-]+?)\s+({SUBJECT})\s+([ༀ-࿿][\sༀ-࿿\x20-\x7F]*)$"
    without = r"^([a-zA-Z][a-zA-Z\s'-]+?)\s+([ༀ-࿿][\sༀ-࿿\x20-\x7F]*)$"
    group = lambda t, p, i: F.regexp_extract(t, p, i)
    return let(line, lambda t: F.coalesce(
        F.when(t.rlike(with_subject), entry(clean_english_column(group(t, with_subject, 1)), group(t, with_subject, 2), split_term(group(t, with_subject, 3), SMART_RULES))),
        F.when(t.rlike(without), entry(clean_english_column(group(t, without, 1)), F.lit(""), split_term(group(t, without, 2), SMART_RULES))),
    ))


def detect_columns(line: Column) -> Column:
    """(english, subject, term, definition) by the first of three ways that gives a valid entry; null for short lines and where none does."""
    valid = lambda way: let(way, lambda w: F.when(valid_column_entry(w["english"], w["term"]), w))
    return let(strip(line), lambda t: F.when(F.length(t) >= 10, F.coalesce(*[valid(way(t)) for way in (by_pattern, by_words, by_whole_pattern)])))


def split_english_subject(c: Column) -> Column:
    """(english, subject): the last word is the subject if it looks like one."""
    pattern = rf"(?s)^(.+?)\s+({SUBJECT})$"
    return let(strip(c), lambda t: let(F.regexp_extract(t, pattern, 2), lambda s: F.struct(F.when(s != "", strip(F.regexp_extract(t, pattern, 1))).otherwise(t).alias("english"), s.alias("subject"))))


def by_transition(line: Column) -> Column:
    """English before the first character of another script, its last word the subject if it looks like one; null without a term."""
    before = f"(?s)^([^{OTHER_SCRIPTS[1:-1]}]+)[{OTHER_SCRIPTS[1:-1]}]"

    def found(t: Column, head: Column) -> Column:
        return let(split_english_subject(head), lambda e: F.when((head != "") & is_term(e["english"]), entry(e["english"], e["subject"], split_term(from_place(t, F.length(head)), CONTENT_RULES))))

    return let(strip(line), lambda t: let(F.regexp_extract(t, before, 1), lambda head: found(t, head)))


def by_simple_pattern(line: Column) -> Column:
    """English, a subject and anything after it."""
    pattern = rf"^([a-zA-Z][a-zA-Z\s'-]+?)\s+({SUBJECT})\s+(.+)$"
    group = lambda t, i: F.regexp_extract(t, pattern, i)
    return let(strip(line), lambda t: F.when(t.rlike(pattern), entry(strip(group(t, 1)), group(t, 2), split_term(group(t, 3), CONTENT_RULES))))


def widest_gaps(line: Column, most: int = 3) -> Column:
    """The parts of a line between its ``most`` widest runs of white space, the first of equally wide ones; the whole line with under two runs."""

    def parts(t: Column, gaps: Column) -> Column:
        cuts = F.array_sort(F.transform(F.slice(F.array_sort(gaps), 1, most), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"))))
        spans = lambda c: F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(c, lambda g: g["end"])).alias("a"), F.concat(F.transform(c, lambda g: g["start"]), F.array(F.length(t))).alias("b"))
        pieces = lambda c: F.filter(F.transform(spans(c), lambda p: strip(F.substr(t, p["a"] + 1, p["b"] - p["a"]))), lambda p: p != "")
        return F.when(F.size(gaps) < 2, F.array(t)).otherwise(let(cuts, pieces))

    def gaps_of(runs: Column, ends: Column) -> Column:
        placed = F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("size"), (F.get(ends, i) - F.length(r)).alias("start"), F.get(ends, i).alias("end"), r.rlike(r"^\s").alias("gap")))
        return F.filter(placed, lambda g: g["gap"])

    runs = lambda t: F.regexp_extract_all(t, F.lit(r"\S+|\s+"), F.lit(0))
    return let(line, lambda t: let(runs(t), lambda r: let(running(F.transform(r, F.length)), lambda ends: let(gaps_of(r, ends), lambda gaps: parts(t, gaps)))))


def by_position(line: Column, english_end: int = 25, subject_end: int = 35) -> Column:
    """Columns of fixed widths; null for short lines, without English, or without another script after them."""
    english = lambda t: clean_english_column(strip(F.left(t, F.lit(english_end))))
    subject = lambda t: strip(F.substring(t, english_end + 1, subject_end - english_end))
    found = lambda t, e, body: F.when((F.length(t) >= english_end) & is_column_english(e) & has_other_script(body), entry(e, subject(t), split_by_position(body)))
    return let(line, lambda t: let(english(t), lambda e: let(strip(from_place(t, F.lit(subject_end))), lambda body: found(t, e, body))))


def fixed_columns(line: Column, widths: tuple[int, ...] = (25, 10, 25)) -> Column:
    """Columns of given widths and the rest; blanks between columns belong to none."""
    if not widths:
        return F.array(strip(line))
    cell = lambda t: F.array(strip(F.left(t, F.lit(widths[0]))))
    return let(line, lambda t: F.concat(cell(t), fixed_columns(F.regexp_replace(from_place(t, F.lit(widths[0])), "^ +", ""), widths[1:])))


def regrouped(english: Column, subject: Column, tibetan: Column) -> Column:
    """Words of three columns, each put where it belongs, and the Tibetan ones split anew."""
    one = lambda w: matches(w, SUBJECT)
    listed = lambda w: one(w) | matches(w, "[a-z]+,[a-z]+")
    is_word = lambda w: matches(w, "[a-zA-Z][a-zA-Z'-]*")
    body = lambda w: w.rlike(TIBETAN) | ~w.rlike("[a-zA-Z]")

    def put(s: Column, t: Column, spare: Column, codes: Column) -> Column:
        late = F.when(F.size(codes) == 0, F.slice(F.filter(spare, one), 1, 1)).otherwise(F.array().cast("array<string>"))

        def with_late(code: Column) -> Column:
            taken = F.when(F.size(code) > 0, F.array_position(spare, F.get(code, F.lit(0)))).otherwise(F.lit(0))  # it fills an empty subject column and is no English word
            names = F.concat(F.filter(words(english), is_word), F.filter(s, lambda w: is_word(w) & ~listed(w)), let(taken, lambda k: F.filter(spare, lambda w, i: is_word(w) & (i + 1 != k))))
            return entry(F.array_join(names, " "), F.array_join(F.concat(codes, code), " "), split_term(F.array_join(F.filter(t, body), " "), REBUILT_RULES))

        return let(late, with_late)

    return let(words(subject), lambda s: let(words(tibetan), lambda t: let(F.filter(t, lambda w: ~body(w)), lambda spare: let(F.filter(s, listed), lambda codes: put(s, t, spare, codes)))))


def by_fixed_width(line: Column, widths: tuple[int, ...] = (25, 10, 25)) -> Column:
    body = lambda cells: strip(F.concat_ws(" ", F.get(cells, F.lit(2)), F.get(cells, F.lit(3))))
    found = lambda cells, b: F.when((F.get(cells, F.lit(0)) != "") & has_other_script(b), regrouped(F.get(cells, F.lit(0)), F.get(cells, F.lit(1)), b))
    return let(fixed_columns(line, widths), lambda cells: let(body(cells), lambda b: found(cells, b)))


def content_places(line: Column) -> Column:
    """(english, subject, tibetan): where the English part and the subject end and the Tibetan text begins."""

    def english(t: Column) -> Column:
        ahead = F.length(F.regexp_extract(t, r"(?s)^(.{6,}?)(?=\s*[a-z]{2,6}\s+\S|[ༀ-࿿])", 1))
        blank = F.instr(F.substr(t, F.lit(11), F.greatest(F.length(t) - 10, F.lit(0))), " ")
        return let(ahead, lambda n: F.when(n > 0, n).when(blank > 0, blank + 9).otherwise(F.floor(F.length(t) / 3).cast("int")))

    def subject(t: Column, e: Column) -> Column:
        rest = from_place(t, e)
        code = F.regexp_extract(rest, "^ *([a-z,]*)", 1)
        return e + F.length(F.regexp_extract(rest, "^( *)", 1)) + let(code, lambda c: F.when(matches(c, SUBJECTS), F.length(c)).otherwise(0))

    def tibetan(t: Column, s: Column) -> Column:
        before = lambda after: F.regexp_extract(after, "(?s)^([^ༀ-࿿]*)[ༀ-࿿]", 1)
        return s + let(from_place(t, s), lambda after: F.when(after.rlike(TIBETAN), let(before(after), lambda b: F.length(b) - F.length(F.regexp_extract(b, "([^ ]*)$", 1)))).otherwise(0))

    ends = lambda t, e, s: F.struct(e.alias("english"), s.alias("subject"), tibetan(t, s).alias("tibetan"))
    return let(line, lambda t: let(english(t), lambda e: let(subject(t, e), lambda s: ends(t, e, s))))


def content_columns(line: Column) -> Column:
    """(english, subject, tibetan) by content, as a head line has them."""

    def cells(t: Column, p: Column) -> Column:
        e, s, b = p["english"], p["subject"], p["tibetan"]
        subject = F.when(s > e, strip(F.substr(t, e + 1, F.greatest(s - e, F.lit(0))))).otherwise("")
        return F.struct(strip(F.left(t, e)).alias("english"), subject.alias("subject"), F.when((b > 0) & (b < F.length(t)), strip(from_place(t, b))).otherwise("").alias("tibetan"))

    return let(line, lambda t: let(content_places(t), lambda p: cells(t, p)))


def by_content(line: Column) -> Column:
    found = lambda p, c: F.when((p["english"] > 0) & (p["tibetan"] > 0), entry(c["english"], c["subject"], split_term(c["tibetan"], REBUILT_RULES)))
    return let(line, lambda t: let(content_places(t), lambda p: let(content_columns(t), lambda c: found(p, c))))


# pages


def _found(text: Column, pattern: str, groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)])


def extracted_terms(pages: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, way, english, tibetan, subject): what each extractor finds on a page; a term may be found by several."""
    page = clean_page(F.col(text_col))
    g = lambda i: F.col(f"m.g{i}")
    failed = F.concat(F.lit("[Tibetan OCR failed: "), F.left(strip(g(3)), F.lit(20)), F.lit("...]"))
    two = strip(F.concat_ws(" ", clean_english(g(1)), clean_english(g(2))))
    ways = {
        "main": (3, page, clean_english(g(1)), clean_tibetan(g(3)), g(2)),
        "abbreviation": (3, page, clean_english(g(2)), clean_tibetan(g(3)), F.lit("abbrev")),
        "failed": (3, page, clean_english(g(1)), failed, g(2)),
        "two_lines": (4, page, two, clean_tibetan(g(4)), g(3)),
        "free": (3, F.col(text_col), clean_english(g(1)), clean_tibetan(g(3)), g(2)),
    }
    out = []
    for way, (n, source, english, tibetan, subject) in ways.items():
        found = pages.select(*keys, F.explode(_found(source, EXTRACTORS[way], n)).alias("m"))
        rows = found.select(*keys, F.lit(way).alias("way"), english.alias("english"), tibetan.alias("tibetan"), subject.alias("subject"))
        out.append(rows.where(valid_english(F.col("english")) if way == "failed" else valid_pair(F.col("english"), F.col("tibetan"))))
    first, *rest = out
    for o in rest:
        first = first.unionByName(o)
    return first


def four_column_terms(pages: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, way, english, subject, term, definition) of pages whose last two columns run into each other."""
    g = lambda i: F.col(f"m.g{i}")
    two = strip(F.concat_ws(" ", clean_entry(g(1)), clean_entry(F.coalesce(g(2), F.lit("")))))
    out = None
    for way, n, english, subject, body in (("abbreviation", 3, clean_entry(g(2)), F.lit("abbrev"), g(3)), ("main", 4, two, g(3), g(4))):
        found = pages.select(*keys, F.explode(_found(F.col(text_col), FOUR_COLUMNS[way], n)).alias("m"))
        rows = found.select(*keys, F.lit(way).alias("way"), english.alias("english"), subject.alias("subject"), split_term(body, FOUR_COLUMN_RULES).alias("p"))
        rows = rows.select(*keys, "way", "english", "subject", F.col("p.term").alias("term"), F.col("p.definition").alias("definition")).where(valid_entry(F.col("english"), F.col("term")))
        out = rows if out is None else out.unionByName(rows)
    return out


def saved_pair(page: Column, method: str, subject: Column, definition: Column) -> tuple[Column, Column]:
    """(context, notes) under which a found pair is stored; long notes are cut."""
    context = F.concat(F.lit("Page "), page.cast("string"), F.lit(f" ({method})"), F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit(" | Subject: "), subject)).otherwise(""))
    notes = F.concat(F.lit("Definition: "), strip(definition))
    notes = F.when(F.length(notes) > 200, F.concat(F.left(notes, F.lit(200)), F.lit("..."))).otherwise(notes)
    return context, F.when(strip(F.coalesce(definition, F.lit(""))) != "", notes).otherwise("Requires manual review")
