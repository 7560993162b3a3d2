"""Spelling of Tibetan syllables: parts, roots and whether a syllable follows the rules; column expressions.

The root stands where the first telling letter says: a letter that is always a
root, a subjoined one, a lower half of a stack, or a vowel.  What stands up to
there must be a legal beginning, what follows a legal ending.  Syllables of plain
consonants are judged by their length.

Results for odd input: null is null; the empty syllable has no root and breaks the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.parse import let

#: fixed values: the alphabet, and letters by what they may be
ALPHABET = "ཀཁགངཅཆཇཉཏཐདནཔཕབམཙཚཛཝཞཟའཡརལཤསཧཨ"
ROOTS = "ཀཁཅཆཇཉཏཐཔཕཙཚཛཝཞཟཡཤ"
LOWER = "ྐྑྒྔྕྖྗྙྚྟྠྡྜྣྤྦྥྨྩྪྫྯྮྴྷྻྼྶ"
SUBJOINED = "ྱྲླྭ"
VOWELS = "ིེོུ"
RETROFLEX = "ཊཋཌཎཥྚྛྜྞྵ"
ACHUNG, WAZUR = "འ", "ྭ"
#: fixed values: stacks, letters after a prefix, and endings
STACKS = (
    "རྐ རྒ རྔ རྗ རྙ རྟ རྡ རྣ རྦ རྨ རྩ རྫ "
    "ལྐ ལྒ ལྔ ལྕ ལྗ ལྟ ལྡ ལྤ ལྦ ལྷ "
    "སྐ སྒ སྔ སྙ སྟ སྡ སྣ སྤ སྦ སྨ སྩ "
    "ཀྱ ཁྱ གྱ པྱ ཕྱ བྱ མྱ "
    "ཀྲ ཁྲ གྲ ཏྲ ཐྲ དྲ པྲ ཕྲ བྲ མྲ ཧྲ སྲ "
    "ཀླ གླ བླ ཟླ རླ སླ "
    "རྐྱ རྒྱ རྨྱ སྐྱ སྒྱ སྤྱ སྦྱ སྨྱ "
    "སྐྲ སྒྲ སྣྲ སྤྲ སྦྲ སྨྲ "
    "ཀྭ ཁྭ གྭ ཅྭ ཉྭ ཏྭ དྭ ཙྭ ཚྭ ཞྭ ཟྭ རྭ ལྭ ཤྭ སྭ ཧྭ གྲྭ དྲྭ"
).split()
PREFIXED = (
    "གཅ གཉ གཏ གད གན གཙ གཞ གཟ གཡ གཤ གས "
    "དཀ དཀྱ དཀྲ དག དགྱ དགྲ དང དཔ དཔྱ དཔྲ དབ དབྱ དབྲ དམ དམྱ "
    "བཀ བཀྱ བཀྲ བརྐ བསྐ བརྐྱ བསྐྱ བསྐྲ བག བགྱ བརྒ བསྒ བརྒྱ བསྒྱ བསྒྲ བརྔ བསྔ བཅ བརྗ བརྙ བསྙ བཏ བརྟ བལྟ བསྟ བད བརྡ བལྡ བསྡ བརྣ བསྣ བཙ བརྩ བསྩ བརྫ བཞ བཟ བཟླ བརླ བཤ བས བསྲ བསླ བགྲ "
    "མཁ མཁྱ མཁྲ མག མགྱ མགྲ མང མཆ མཇ མཉ མཐ མད མན མཚ མཛ "
    "འཁ འཁྱ འཁྲ འག འགྱ འགྲ འཆ འཇ འཐ འད འདྲ འཕ འཕྱ འཕྲ འབ འབྱ འབྲ འཚ འཛ"
).split()
SUFFIXES = "གངདནབམའརལས"
DOUBLE_SUFFIXES = ["གས", "ངས", "བས", "མས", "ནད", "རད", "ལད"]
ACHUNG_ENDINGS = ["འི", "འུ", "འང", "འམ", "འོ", "འུའི"]
#: fixed values: three plain letters whose second is the root although they end in two suffixes
SECOND_IS_ROOT = ["དགས", "འགས", "དབས", "དམས"]
STARTS = [*STACKS, *PREFIXED, *ALPHABET]
ENDS = [*SUFFIXES, *DOUBLE_SUFFIXES, *ACHUNG_ENDINGS]
#: letters of words: consonants, vowel signs and other signs over a syllable, and subjoined consonants
WORD = "ཀ-ཬཱ-ཾཱྀྀྃྐ-ྼ"
TELLING = ROOTS + LOWER + SUBJOINED + VOWELS
_FIRST_LOWER, _LETTERS = "ྐ", 45


def _one_of(c: Column, letters: str) -> Column:
    return c.isin([*letters])


def legal(start: Column, end: Column) -> Column:
    """Whether the letters up to the root and those after it go together with it; a wazur belongs to the former."""
    wazur = end.startswith(WAZUR) & (start != "")
    starts = F.when(wazur, F.concat(start, F.lit(WAZUR))).otherwise(start)
    ends = F.when(wazur, F.regexp_replace(end, f"^{WAZUR}+", "")).otherwise(end)
    good_start = let(starts, lambda s: (s == "") | s.isin(STARTS))
    good_end = let(ends, lambda e: ~e.rlike(f"^[{VOWELS}]{{2}}") & let(F.regexp_replace(e, f"^[{VOWELS}]+", ""), lambda bare: (bare == "") | bare.isin(ENDS)))
    return good_start & good_end


def _root_by_telling_letter(c: Column) -> Column:
    cut = lambda n: legal(F.left(c, n), F.substr(c, n + 1, F.length(c)))

    def told(i: Column) -> Column:
        letter, after = F.substr(c, i + 1, F.lit(1)), F.substr(c, i + 2, F.lit(1))
        before = F.when(i > 0, F.substr(c, F.greatest(i, F.lit(1)), F.lit(1))).otherwise(F.right(c, F.lit(1)))
        lone = (F.length(c) == 1) & _one_of(c, ALPHABET)
        subjoined, vowel = _one_of(letter, SUBJOINED), _one_of(letter, VOWELS)
        hung = vowel & (before == ACHUNG) & (i != 1)
        # where the part up to the root ends, and where the root stands then
        end = F.when(subjoined, i + 1).when(hung, F.when(i > 0, i - 1).otherwise(F.length(c) - 1)).when(vowel, i).when(_one_of(after, SUBJOINED), i + 2).otherwise(i + 1)
        place = F.when(hung, 0).when(subjoined | vowel, i - 1).otherwise(i)
        return F.when(lone, 0).otherwise(let(end, lambda n: F.when(cut(n), place)))

    return let(F.length(F.regexp_extract(c, f"^([^{TELLING}]*)", 1)), told)


def _root_by_length(c: Column) -> Column:
    n, letter = F.length(c), lambda i: F.substring(c, i, 1)
    two = F.substring(c, 2, 2)
    three = F.when(two.isin(DOUBLE_SUFFIXES), F.when(c.isin(SECOND_IS_ROOT), 1).otherwise(0)).when(letter(2) == ACHUNG, F.when(legal(letter(1), two), 0)).otherwise(F.when(legal(F.substring(c, 1, 2), letter(3)), 1))
    return (
        F.when(n == 1, F.when(_one_of(c, ALPHABET), 0))
        .when(n == 2, F.when((letter(1) != letter(2)) & (letter(2) != ACHUNG) & _one_of(letter(2), SUFFIXES), 0))
        .when(n == 3, F.when(_one_of(letter(3), SUFFIXES), three))
        .when(n == 4, F.when(legal(F.substring(c, 1, 2), F.substring(c, 3, 2)), 1))
    )


def root_place(c: Column) -> Column:
    """The place of the root (from 0) in a syllable that follows the rules, else null."""
    told = lambda s: let(_root_by_telling_letter(s), lambda place: F.when(place.between(0, 2), place))
    return let(c, lambda s: F.when(s.rlike(f"[{RETROFLEX}]"), F.lit(None).cast("int")).when(s.rlike(f"[{TELLING}]"), told(s)).otherwise(_root_by_length(s)))


def breaks_rules(c: Column) -> Column:
    """Whether a syllable is not written as the rules have it; foreign letters are not."""
    return F.when(c.isNotNull(), root_place(c).isNull())


def root(c: Column) -> Column:
    """The root letter; of a syllable that breaks the rules the first letter."""
    return F.substr(c, F.coalesce(root_place(c), F.lit(0)) + 1, F.lit(1))


def base_letters(c: Column) -> Column:
    """Subjoined letters as the letters that they stand for."""
    lower = "".join(chr(ord(_FIRST_LOWER) + i) for i in range(_LETTERS))
    return F.translate(c, lower, "".join(chr(ord("ཀ") + i) for i in range(_LETTERS)))


def syllable_parts(c: Column, omit_tsek: bool = True) -> Column:
    """Runs of word letters, and every other character on its own; without tseks, if so asked."""
    parts = F.regexp_extract_all(c, F.lit(f"[{WORD}]+|[^{WORD}]"), F.lit(0))
    return F.filter(parts, lambda p: p != "་") if omit_tsek else parts


def syllables(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0))


#: fixed values: readings that recognition confuses, applied in this order
CONFUSED = [("ལ་ལ", "ལེ་འུ"), ("བ་པ", "དགེ་བ"), ("ན་དེ", "དེ"), ("པ་མ", "པ"), ("ག་བ", "བ"), ("མ་ན", "མི"), ("ད་ན", "དེ")]


def corrected(c: Column) -> Column:
    """Text with confused readings replaced, and without empty syllables and tseks at line ends."""
    for wrong, right in [("་\n", "\n"), ("་་", "་"), *CONFUSED]:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    kept = F.filter(F.split(c, "་"), lambda w: ~w.rlike(r"\A\s*\z"))
    return F.regexp_replace(F.replace(F.array_join(kept, "་"), F.lit("་\n"), F.lit("\n")), r"\A\s+|\s+\z", "")
