"""Column functions on names and numbers, all in the JVM.

Folding goes code point by code point, so what compatibility decomposition and
the look-alikes make of each is worked out once on the driver, by rule, and
becomes the argument of a ``translate``; only code points that stand for several
letters need a look-up, in the few texts that have them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alikes of ASCII letters that decomposition leaves as they are.
LOOKALIKES = {
    "Ꭱ": "R", "Ꭲ": "T", "Ꮮ": "L", "Ꮯ": "C", "Ꮋ": "H", "Ꭺ": "A", "Ꭼ": "E", "Ꮲ": "P", "Ꮪ": "S", "Ꮶ": "K",
    "Ꮇ": "M", "Ꮃ": "W", "Ꭰ": "D", "Ꮖ": "I", "Ꮷ": "J", "Ø": "O", "Ð": "D", "Þ": "P", "Ł": "L", "ß": "B", "€": "E",
    "Δ": "A", "Ć": "C", "Ħ": "H", "Ƥ": "P", "Ñ": "N", "Ɐ": "A",
    "Ŋ": "N", "ŋ": "n", "Ų": "U", "ų": "u", "Ɓ": "B", "ɓ": "b", "Į": "I", "į": "i", "Ə": "E", "Ɔ": "O",
    "Ʌ": "A", "Ƨ": "S", "Ƽ": "S", "Ʈ": "T", "Ɗ": "D", "Ɖ": "D", "Ƙ": "K", "Ɲ": "N", "Ɍ": "R", "Ɏ": "Y",
}
# Letters that the rule below doesn't reach, and those that it reaches but that stand for nothing.
MORE_LETTERS = {
    "Ʉ": "U", "ʉ": "U", "ᵻ": "I", "ᵾ": "U", "ᶧ": "I", "ᶶ": "U", "\u1abf": "W", "Ꝛ": "R", "ꝛ": "R", "ꬱ": "A", "ꭇ": "R", "ꭏ": "U", "\U0001f1a5": "D",
    "\u1dca": "R", "\u1dd7": "C", "\u1de3": "R", "\u1dec": "L", "\u1ded": "O", "\u1df0": "U", "\u1df2": "A", "\u1df3": "O", "\u1df4": "U",
}
NO_LETTERS = "ʛᴌꭆ\U00010794\U0001079c\U0001df04"
EXOTIC = 0.5  # from this share of non-ASCII code points on, a name counts as stylised
DIGITS = {w: str(i) for i, w in enumerate("ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())}
INVISIBLE = r"[\x{200D}\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{0}-\x{20}]"
BLANK = r"[\x{0}-\x{20}]"


@lru_cache(maxsize=1)
def latin_variants() -> dict[int, str]:
    """By rule: a letter ``WITH`` a mark, a combining, circled or squared letter or digit stands for the plain one."""
    marked = re.compile(r"LATIN (?:CAPITAL |SMALL )?LETTER (?:SMALL CAPITAL )?([A-Z]) WITH .*")
    boxed = re.compile(r"(?:COMBINING|(?:CROSSED )?NEGATIVE (?:CIRCLED|SQUARED)) LATIN (?:CAPITAL |SMALL )LETTER (?:SMALL CAPITAL )?([A-Z])")
    digit = re.compile(r"(?:DINGBAT .*|DOUBLE |NEGATIVE )(?:CIRCLED )?(?:SANS-SERIF )?DIGIT ([A-Z]+)")
    out = {}
    for c in map(chr, range(0x80, 0x1F200)):
        name = unicodedata.name(c, "")
        if m := marked.fullmatch(name) or boxed.fullmatch(name):
            out[ord(c)] = m[1]
        elif (m := digit.fullmatch(name)) and m[1] in DIGITS:
            out[ord(c)] = DIGITS[m[1]]
    out = {c: v for c, v in out.items() if chr(c) not in NO_LETTERS}
    return out | {ord(k): v for k, v in (MORE_LETTERS | LOOKALIKES).items()}


def fold_text(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).translate(latin_variants())
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", plain)).lower()
    return re.sub("[^a-z0-9]", "", plain)


@lru_cache(maxsize=1)
def folded_points() -> tuple[dict[str, str], dict[str, str]]:
    """By rule: the code points beyond ASCII that fold to one letter or digit, and those that fold to several."""
    folds = {c: f for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (f := fold_text(c))}
    return {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1}


@lru_cache(maxsize=1)
def spelt_range() -> str:
    """A character class of few ranges that holds all code points that fold to several letters, and some others."""
    found = sorted(map(ord, folded_points()[1]))
    cuts = [0, *(i for i in range(1, len(found)) if found[i] - found[i - 1] > 64), len(found)]
    return "[" + "".join(f"\\x{{{found[lo]:X}}}-\\x{{{found[hi - 1]:X}}}" for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)) + "]"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def fold(c: Column) -> Column:
    """Letters a-z and digits of a name, whatever its style. Null gives ''."""
    one, several = folded_points()
    spelt = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])

    def plain(c: Column) -> Column:
        whole = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(spelt[x], x)), "")
        styled = F.translate(F.when(c.rlike(spelt_range()), whole).otherwise(c), "".join(one), "".join(one.values()))
        return F.when(c.rlike(r"[^\x00-\x7F]"), styled).otherwise(c)

    return F.coalesce(once(c, lambda c: F.regexp_replace(F.lower(plain(c)), "[^a-z0-9]+", "")), F.lit(""))


def usable(folded: Column, raw: Column) -> Column:
    """A fold that tells enough: three characters, or as many as the name has."""
    shown = F.char_length(F.regexp_replace(F.coalesce(raw, F.lit("")), BLANK, ""))
    return F.when((F.char_length(folded) >= 3) | (F.char_length(folded) >= shown), folded).otherwise(F.lit(""))


def usable_fold(c: Column) -> Column:
    return usable(fold(c), c)


def symbols(c: Column) -> Column:
    """The visible code points of a name, without joiners, selectors and skin tones."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, "")


def alias_key(c: Column) -> Column:
    shown = once(symbols(c), lambda s: F.when(s != "", F.concat(F.lit("\u0002"), s)).otherwise(""))
    return once(fold(c), lambda f: F.when(f != "", f).otherwise(shown))


def exoticness(c: Column) -> Column:
    """Share of the visible code points that are not ASCII; 0 for none."""
    shown = F.char_length(F.regexp_replace(c, BLANK, ""))
    return F.when(shown > 0, F.char_length(F.regexp_replace(c, r"[\x{0}-\x{7E}]", "")) / shown).otherwise(F.lit(0.0))


def first_integer(c: Column) -> Column:
    """The first integer of a text, commas and blanks aside; null without one."""
    digits = F.regexp_extract(F.regexp_replace(c, r"[,\s]", ""), r"-?\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def decimal_number(c: Column) -> Column:
    """A whole text as a finite number, commas and blanks aside; else null."""
    value = F.nullif(F.regexp_replace(c, r"[,\s]", ""), F.lit("")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def shown_key(c: Column) -> Column:
    """What a cell shows, ignoring case, spacing and style."""
    return once(fold(c), lambda f: F.when(f != "", f).otherwise(F.coalesce(squeezed(c), F.lit(""))))
