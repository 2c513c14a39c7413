"""Text normalisation, composite names and markup."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F

from . import fixed_values as V


@cache
def _folding() -> tuple[str, str, str, str, str, str, str]:
    """What compatibility decomposition without combining marks does to each letter, from the Unicode tables.

    Letters that become one letter come with it (source, target; those past the end of the target vanish); letters
    that become several come as a pattern, a list and their spellings. Korean syllables follow from a rule of their own.
    Two more patterns are cheaper and true wherever the long one is: what is no Latin letter that stays one, and, of two ranges only, what is
    beyond the first 256 letters or among the few of those that become several.
    """
    single, target, gone, several, spelled = [], [], [], [], []
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code < 0xE000:
            continue
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if base == letter:
            continue
        if not base:
            gone.append(letter)
        elif len(base) == 1:
            single.append(letter)
            target.append(base)
        else:
            several.append(letter)
            spelled.append(base)
    ranges = []
    for letter in several:
        if ranges and ord(letter) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = letter
        else:
            ranges.append([letter, letter])
    pattern = "[" + "".join(f"\\x{{{ord(a):X}}}-\\x{{{ord(b):X}}}" for a, b in [*ranges, ("\uac00", "\ud7a3")]) + "]"
    odd = [0x250, *(ord(c) for c in several if c < "\u0250")]
    edges = sorted({-1, *odd})
    plain = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    hint = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in plain) + "]"
    early = [ord(c) for c in several if c < "\u0100"]
    rough = f"[\\x{{{min(early):X}}}-\\x{{{max(early):X}}}\\x{{100}}-\\x{{10FFFF}}]"
    return "".join(single + gone), "".join(target), pattern, "".join(several), "\x00".join(spelled), hint, rough


def _syllable(letter: Column) -> Column:
    """The two or three signs of a Korean syllable: 21 vowels by 28 ends for each first consonant."""
    place = F.ascii(letter) - 0xAC00

    def sign(first: int, count: int, at: Column) -> Column:
        return F.substring(F.lit("".join(map(chr, range(first, first + count)))), (at + 1).cast("int"), F.lit(1))

    end = place % 28
    return F.concat(
        sign(0x1100, 19, F.floor(place / 588)), sign(0x1161, 21, F.floor(place % 588 / 28)),
        F.when(end > 0, sign(0x11A7, 28, end)).otherwise(""),
    )


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks, for every script, inside the JVM.

    ASCII text is passed through. Letters that become one letter or vanish are translated; only texts with a letter
    that becomes several are taken apart.
    """
    source, target, pattern, several, spelled, hint, rough = _folding()

    def spell(letter: Column) -> Column:
        place = F.call_function("locate", letter, F.lit(several))
        syllable = (letter >= "\uac00") & (letter <= "\ud7a3")
        return F.when(syllable, _syllable(letter)).otherwise(
            F.coalesce(F.get(F.split(F.lit(spelled), "\x00"), place - 1), letter)
        )

    apart = F.array_join(F.transform(F.split(text, ""), spell), "")
    found = F.rlike(text, F.lit(rough)) & F.rlike(text, F.lit(hint)) & F.rlike(text, F.lit(pattern))
    whole = F.when(found, apart).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(whole, source, target))


# The white space that is trimmed.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_text(text: Column) -> Column:
    """Upper case, no accents, single spaces; NULL and the empty words give ''."""
    bare = strip(F.coalesce(text, F.lit("")))
    # Single spaces are left alone: most texts need no replacement at all.
    clean = F.upper(F.regexp_replace(fold_accents(bare), r"(?U)\s{2,}|[^\S ]", " "))
    return F.when((bare == "") | F.upper(bare).isin(*V.EMPTY_WORDS), F.lit("")).otherwise(clean)


def programme_name(text: Column) -> Column:
    return strip_prefix(normalize_text(text), V.UMBRELLA_PREFIXES)


def strip_prefix(text: Column, prefixes: Sequence[str], separator: str = " - ") -> Column:
    """Normalised text without one leading `prefix + separator`."""
    return F.regexp_replace(text, f"^({'|'.join(prefixes)}){separator}", "")


def split_unit(unit: Column) -> tuple[Column, Column]:
    """(department, programme) of a grant unit 'DEPARTMENT / PROGRAMME' with tails; without a slash all of it is the department.

    The generic prefixes are removed before accents are, so an accented prefix stays.
    """
    slash = F.instr(unit, F.lit("/"))
    rest = F.substring(unit, slash + 1, F.length(unit))
    for tail in V.UNIT_TAILS:
        rest = F.regexp_replace(rest, f"(?i){tail}", "")
    own = F.regexp_replace(strip(rest), f"(?i)^({'|'.join(V.GENERIC_PREFIXES)})", "")
    head = F.when(slash > 0, F.substring(unit, F.lit(1), slash - 1)).otherwise(unit)
    return normalize_text(head), F.when(slash > 0, programme_name(own)).otherwise(F.lit(""))


def _decoded(text: Column) -> Column:
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return decode(text)


def page_text(page: Column) -> Column:
    """Visible text of a page: tags to spaces, all character references decoded, white space collapsed.

    Only texts with a reference go to Python, in Arrow batches.
    """
    text = F.regexp_replace(page, r"<[^>]+>", " ")
    decoded = F.coalesce(_decoded(F.when(text.contains("&"), text)), text)
    return F.regexp_replace(decoded, r"(?U)\s+", " ")


def word_tokens(text: Column) -> Column:
    """Distinct folded lower-case words."""
    words = F.split(F.lower(fold_accents(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.array_remove(words, ""))


def letter_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return letters / F.nullif(F.length(text), F.lit(0))
