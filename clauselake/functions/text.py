"""Text column functions (O35, O44, O45, O47) on built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.catalog import SNIPPET_CHARS, literal_map
from clauselake.plans.once import let

# Every code point that counts as white space at the ends of a Python string.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE_RUN, " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, WHITESPACE_RUN), lambda token: token != "")


SYLLABLES, SYLLABLE_COUNT = 0xAC00, 11172  # Hangul syllables, composed by arithmetic
LEADS, VOWELS, TAILS = (0x1100, 19), (0x1161, 21), (0x11A7, 28)  # their parts; the first tail stands for none


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition without marks, derived from the Unicode tables.

    Returns the characters that map to one character, their images, the marks
    to delete, and the characters that expand to several (ligatures, fractions).
    Marks are deleted whatever their order, so decomposing each character alone
    gives the decomposition of the text. Hangul syllables follow arithmetic.
    """
    single, images, marks, expanding = [], [], [], []
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        char = chr(cp)
        if SYLLABLES <= cp < SYLLABLES + SYLLABLE_COUNT:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if plain == "":
            marks.append(char)
        elif len(plain) == 1:
            single.append(char)
            images.append(plain)
        else:
            expanding.append((char, plain))
    return "".join(single), "".join(images), "".join(marks), tuple(expanding)


def _char_class(chars: list[str]) -> str:
    """Character class of sorted characters, with runs written as ranges."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _jamo(parts: tuple[int, int], index: Column) -> Column:
    first, count = parts
    return F.substring(F.lit("".join(map(chr, range(first, first + count)))), index + 1, 1)


def _split_syllables(text: Column) -> Column:
    """Hangul syllables as lead, vowel and tail, from the position of each in the block."""

    def parts(char: Column) -> Column:
        def spell(at: Column) -> Column:
            tail = F.pmod(at, F.lit(TAILS[1]))
            vowel = F.floor(at / TAILS[1]).cast("int")
            ends = F.when(tail > 0, _jamo(TAILS, tail)).otherwise(F.lit(""))
            lead = _jamo(LEADS, F.floor(vowel / VOWELS[1]).cast("int"))
            return F.concat(lead, _jamo(VOWELS, F.pmod(vowel, F.lit(VOWELS[1]))), ends)

        inside = char.between(chr(SYLLABLES), chr(SYLLABLES + SYLLABLE_COUNT - 1))
        return F.when(inside, spell(F.ascii(char) - SYLLABLES)).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), parts), "")


def strip_accents(text: Column) -> Column:
    """NFKD without combining marks, for every script.

    One-to-one letters go through ``translate``. Rows that still hold a
    character that expands to several look up the distinct ones that they hold,
    and rows with Hangul syllables are spelled out; other rows skip both, and
    rows that are ASCII by then meet no lambda, which Spark interprets.
    """
    single, images, marks, expanding = _fold_rules()
    pattern = _char_class([char for char, _ in expanding])
    keys = F.lit("".join(char for char, _ in expanding))
    values = F.split(F.lit("\x00".join(plain for _, plain in expanding)), "\x00")
    syllables = f"[\\x{{{SYLLABLES:x}}}-\\x{{{SYLLABLES + SYLLABLE_COUNT - 1:x}}}]"

    def expand(plain: Column) -> Column:
        held = F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), 0))
        image = lambda char: F.get(values, F.instr(keys, char) - 1)
        replaced = F.aggregate(held, plain, lambda acc, char: F.replace(acc, char, image(char)))
        return F.when(plain.rlike(r"[^\x00-\x7f]") & plain.rlike(pattern), replaced).otherwise(plain)

    def spell(plain: Column) -> Column:
        return F.when(plain.rlike(syllables), _split_syllables(plain)).otherwise(plain)

    plain = F.translate(text, single + marks, images)
    return F.when(plain.rlike(r"[^\x00-\x7f]"), let(let(plain, expand), spell)).otherwise(plain)


def fold(text: Column) -> Column:
    """Strip, lower, remove accents, collapse spaces; empty text gives null.

    Built-in expressions for all of Unicode. A mark that decomposes into a space
    leaves none at the ends.
    """
    return F.nullif(strip(collapse_spaces(strip_accents(F.lower(strip(text))))), F.lit(""))


def _fold_batch(batch: pd.Series) -> pd.Series:
    def one(value: str) -> str | None:
        decomposed = unicodedata.normalize("NFKD", value.strip().lower())
        return " ".join("".join(c for c in decomposed if not unicodedata.combining(c)).split()) or None

    return batch.map(one, na_action="ignore")


def fold_exact(text: Column) -> Column:
    """O35 over all of Unicode (scripts beyond Latin), Arrow batched."""
    return F.pandas_udf(_fold_batch, "string")(text)


def clean_optional(text: Column, null_words: bool = False) -> Column:
    """Trimmed text, empty gives null; optionally null/none/n/a/na too."""
    trimmed = strip(text)
    empty = F.length(trimmed) == 0
    if null_words:
        empty = empty | F.lower(trimmed).isin("null", "none", "n/a", "na")
    return F.when(~empty, trimmed)


def policy_id_from_filename(path: Column) -> Column:
    """File stem as a slug; default ``apolice``."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    slug = F.lower(F.trim(F.regexp_replace(stem, r"[^0-9a-zA-Z]+", "_"), F.lit("_")))
    return F.when(slug == "", F.lit("apolice")).otherwise(slug)


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    """One line, cut at ``limit`` with an ellipsis."""
    flat = strip(collapse_spaces(text))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def truncate(text: Column, limit: int) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)
