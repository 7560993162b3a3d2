"""String functions of the glossary: cleaning, splitting, labels.  All are column expressions; only packing goes through Arrow batches."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: subject codes
SUBJECTS = ["acc", "agri", "anth", "arch", "astro", "bio", "bot", "buddh", "chem", "econ", "geo", "geog", "geom", "hist", "ling", "lit", "log", "math", "med", "mus", "phil", "phys", "psycho", "zool", "poly", "soc", "rel", "adm", "pol", "com", "edu", "cine", "hay"]
#: fixed values: tokens that recognition leaves behind
ARTEFACTS = ["BNA", "ANA", "aT", "AQ", "STARE", "ATS", "AAS"]
SHAD, TSEK = "།", "་"
TIBETAN = "[\\u0F00-\\u0FFF]"
LONGEST_TERM, CUT_TERM = 30, 25
#: fixed values: what goes from a recognised word, from a definition, and from Tibetan text, with what comes for it, in this order
WORD_NOISE = [(r"\s+x\s*$", ""), (r"\s+x\s+", " "), (r"^x\s+", ""), (r"\bx\b", ""), (r"\b(?:" + "|".join(ARTEFACTS) + r")\b", "")]
DEFINITION_NOISE = [(r"\bx\b", ""), ("[0-9]+", ""), ("[A-Z]{2,}", ""), ("['‘’]", ""), (r"\s+", " ")]
DEFINITION_STRINGS = ["ས་སུ་", "་ཤོས་ཤོག", "ATS", "AAS", "STARE", "AQ"]
LATIN_NOISE = [("'[aA]", ""), (r"\b[aA]\b", ""), (r"[a-zA-Z]'|'[a-zA-Z]", ""), ("[a-df-zA-DF-Z]", ""), (r"\s+", "")]


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def has_tibetan(c: Column) -> Column:
    return c.rlike(TIBETAN)


def drop_latin(c: Column) -> Column:
    """Tibetan text without Latin letters (``e`` may stand for a vowel and stays), without apostrophes beside letters, and without white space."""
    return F.trim(_chain(c, *LATIN_NOISE))


def clean_word(c: Column) -> Column:
    """A recognised word without single ``x`` and known artefacts, and without Latin letters if it is Tibetan; null is empty."""
    plain = F.trim(_chain(F.coalesce(c, F.lit("")), *WORD_NOISE))
    return F.when(has_tibetan(plain), drop_latin(plain)).otherwise(plain)


def cut_term(c: Column) -> Column:
    """A term up to its first shad, or cut at a syllable if it is long, or closed by a shad."""
    t = _chain(F.coalesce(c, F.lit("")), (r"\bx\b", ""), (r"\s+", ""))
    at = F.instr(t, SHAD)
    syllable = F.instr(F.substring(t, 21, LONGEST_TERM - 20), TSEK)
    return (
        F.when(t == "", "")
        .when((at > 1) & (at <= 50), F.concat(F.substring_index(t, SHAD, 1), F.lit(SHAD)))
        .when((F.length(t) > LONGEST_TERM) & (syllable > 0), F.left(t, syllable + 20))
        .when(F.length(t) > LONGEST_TERM, F.concat(F.left(t, F.lit(CUT_TERM)), F.lit("...")))
        .when(~t.endswith(SHAD) & ~t.endswith(TSEK), F.concat(t, F.lit(SHAD)))
        .otherwise(t)
    )


def clean_definition(c: Column) -> Column:
    """A definition without digits, capitals in a row, quotation marks and known misreadings, and without Latin letters; null is empty."""
    t = F.trim(_chain(F.coalesce(c, F.lit("")), *DEFINITION_NOISE))
    return drop_latin(F.regexp_replace(t, "|".join(DEFINITION_STRINGS), ""))


def subject_code(c: Column) -> Column:
    """The subject code; of a list with commas the last valid one; else empty."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z,\s]", ""))
    valid = F.filter(F.split(t, r"[,\s]+"), lambda x: x.isin(SUBJECTS))
    return F.when(t.contains(",") & (F.size(valid) > 0), F.element_at(valid, -1)).when(t.isin(SUBJECTS), t).otherwise("")


def status_icon(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("draft")))
    return F.when(s.isin("verified", "approved"), "✅").when(s == "reviewed", "🔍").when(s == "draft", "📝").otherwise("❓")


def optional_line(prefix: str, c: Column, suffix: str = "\n") -> Column:
    """A line if the value isn't blank, else nothing."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(prefix), c, F.lit(suffix))).otherwise("")


def language_pair(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" → "), target)


def split_at_shad(c: Column) -> tuple[Column, Column]:
    """(term with its shad, the rest) of a text; without a shad the whole is the term."""
    at = F.instr(c, SHAD)
    return F.when(at > 0, F.left(c, at)).otherwise(c), F.when(at > 0, F.trim(F.substring(c, at + 1, F.length(c)))).otherwise("")


def glossary_structure(c: Column) -> Column:
    """Whether a page's text looks like a glossary: Latin words, Tibetan, over ten lines."""
    return c.rlike("[a-zA-Z]{3,}") & has_tibetan(c) & (F.size(F.split(c, "\n")) > 10)


def page_break(line: Column) -> Column:
    return line.rlike(r"^\s*\d+\s*$") | line.rlike(r"absolute pressure.*\d") | ((F.trim(line) == "") & (F.length(line) < 5))


def stacks(c: Column) -> Column:
    """Stacks: a base letter with what hangs on it."""
    return F.regexp_extract_all(c, F.lit("([\\u0F40-\\u0F6C][\\u0F71-\\u0F84\\u0F8D-\\u0FBC]*)"), F.lit(1))


def syllables(c: Column) -> Column:
    return F.filter(F.split(c, f"[{TSEK}{SHAD}\\s]+"), lambda x: x != "")


def blank_runs(c: Column) -> Column:
    """The lengths of the runs of blanks in a line."""
    return F.transform(F.regexp_extract_all(c, F.lit(" +"), F.lit(0)), lambda r: F.length(r))


def packed(c: Column) -> Column:
    """Text as zlib-compressed UTF-8."""
    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda s: zlib.compress(s.encode()), na_action="ignore")

    return run(c)


def unpacked(c: Column) -> Column:
    """The text that ``packed`` made smaller."""
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: zlib.decompress(b).decode(), na_action="ignore")

    return run(c)
