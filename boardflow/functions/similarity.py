"""Edit similarity of names, as Column expressions, and equi-join keys that lose no pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardflow.functions.text import EXOTIC

# Fixed values.
NEAR_LETTERS = 4
CLAIM, CLAIM_STYLISED = 0.8, 0.45
ORPHAN = 0.6


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; equal texts 1, an empty one against another 0."""
    edits = F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - edits)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def symbol_cap(a: Column, b: Column) -> Column:
    """Edits that two symbol names may be apart: a third of the longer one if both have four code points, else one."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    both = F.least(F.char_length(a), F.char_length(b)) >= NEAR_LETTERS
    return F.when(both, F.greatest(F.lit(1), F.floor(n / 3))).otherwise(1)


def symbols_near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= symbol_cap(a, b)


def deletion_keys(c: Column) -> Column:
    """The text and all texts with one character left out: two texts within one edit share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c))))
    return F.array_distinct(F.when(F.char_length(c) > 0, F.concat(F.array(c), cut)).otherwise(F.array(c)))


def claim_plausible(key: Column, shown: Column, exotic: Column, form_key: Column, form_shown: Column, form_exotic: Column) -> Column:
    """Whether a reading may be what a claimed roster form shows.

    Readings in letters: similar enough, less so if both are stylised. Readings
    in symbols alone: only against forms in symbols alone, equal, one within the
    other, or near by edits; an empty reading is nothing's.
    """
    bar = F.when((exotic >= EXOTIC) & (form_exotic >= EXOTIC), CLAIM_STYLISED).otherwise(CLAIM)
    letters = (form_key != "") & (similarity(key, form_key) >= bar)
    long = F.least(F.char_length(shown), F.char_length(form_shown)) >= NEAR_LETTERS
    within = F.contains(form_shown, shown) | F.contains(shown, form_shown)
    signs = (form_key == "") & (shown != "") & (form_shown != "") & (within | (long & symbols_near(shown, form_shown)))
    return F.when(key == "", signs).otherwise(letters)
