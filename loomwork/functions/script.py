"""Character classes and text functions, as column expressions.

Classes follow the Tibetan script but are parameters of a ``Script``, so that the
same functions work on languages that separate words by spaces.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The script's block and its marks.
TSHEG = "་"
TSHEGS = "་༌"
SHAD = "།"
SHADS = "།༎༏༐༑༒༔"
BLOCK = "ༀ-࿿"
#: White space as Python's str.split has it.
WHITE = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WHITE_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
VOWELS = "ིེོཻཽུ"
#: Letters, vowel signs and subjoined letters (a pattern).
LETTER = "[ཀ-ཬཱ-྅ྐ-ྼ]"
#: Consonants that may close a syllable.
FINALS = "གངདནབམའརལས"


@dataclass(frozen=True)
class Script:
    """Marks between syllables and at the end of sentences."""

    syllable_marks: str = TSHEGS
    sentence_marks: str = SHADS
    block: str = BLOCK


TIBETAN = Script()


def squeeze_space(text: Column) -> Column:
    """Runs of any white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def remove_controls(text: Column) -> Column:
    """Control and format characters go, but tab and line breaks."""
    return F.regexp_replace(text, "[\\p{Cc}\\p{Cf}&&[^\\t\\n\\r\\x0B\\f\\x85]]", "")


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; Spark has no function for it."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return run(text)


def normalize(text: Column, form: str = "NFC", collapse: bool = True) -> Column:
    """Controls removed, a normal form, and (by default) white space squeezed."""
    out = unicode_form(remove_controls(text), form)
    return squeeze_space(out) if collapse else out


def tidy(text: Column) -> Column:
    """Runs of syllable marks and of shads become one; one space beside either goes."""
    out = F.regexp_replace(text, f"[{TSHEGS}]+", TSHEG)
    out = F.regexp_replace(out, "[།༎༏༑]+", SHAD)
    return F.regexp_replace(F.regexp_replace(out, f" ([{TSHEG}{SHAD}])", "$1"), f"([{TSHEG}{SHAD}]) ", "$1")


def tidied(text: Column) -> Column:
    """(original, normalized, changed, changes): the text in composed form and tidy, with a record of the change."""
    normal = tidy(unicode_form(text))
    said = F.concat(F.lit("normalized from '"), text, F.lit("' to '"), normal, F.lit("'"))
    changes = F.when(normal != text, F.array(said)).otherwise(F.array().cast("array<string>"))
    return F.struct(text.alias("original"), normal.alias("normalized"), (normal != text).alias("changed"), changes.alias("changes"))


def letter_count(text: Column) -> Column:
    """Letters, vowel signs and subjoined letters; marks between syllables do not count."""
    return F.regexp_count(text, F.lit(LETTER)).cast("long")


def has_letter(text: Column) -> Column:
    return text.rlike(LETTER)


def only_script(text: Column) -> Column:
    """Letters and marks of the script alone, and not nothing."""
    return text.rlike("^[ཀ-ཬཱ-྅ྐ-ྼ་༌།༎༏]+$")


def script_ratio(text: Column, script: Script = TIBETAN) -> Column:
    """Share of characters in the script's block; 0 for the empty text."""
    inside = F.char_length(F.regexp_replace(text, f"[^{script.block}]", ""))
    return F.when(F.char_length(text) > 0, inside / F.char_length(text)).otherwise(F.lit(0.0))


def ranges(chars: str) -> str:
    """The inside of a pattern's character class, neighbours as ranges: a class costs a test for each entry and character."""
    codes, out = sorted(set(map(ord, chars))), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def spaced(text: Column, script: Script = TIBETAN) -> Column:
    """The text with a space for every mark and white space."""
    between = script.syllable_marks + script.sentence_marks + WHITE_CHARS
    return F.translate(text, between, " " * len(between))


def syllables(text: Column, script: Script = TIBETAN) -> Column:
    """Syllables: what stands between marks and white space.

    All of these become one space, at which the text is split: a pattern would test every character against the class.
    """
    return F.array_remove(F.split(spaced(text, script), " "), "")


def sentences(text: Column, script: Script = TIBETAN) -> Column:
    """Content up to a run of sentence marks or a line break; orphan marks are dropped."""
    marks, breaks = script.sentence_marks, "\n\r\x0b\f\x85\u2028\u2029"
    parts = F.regexp_extract_all(text, F.lit(f"[^{ranges(marks + breaks)}]+[{ranges(marks)}]*"), F.lit(0))
    trimmed = F.transform(parts, lambda s: F.btrim(s, F.lit(WHITE_CHARS)))
    return F.filter(trimmed, lambda s: F.btrim(s, F.lit(marks + WHITE_CHARS)) != "")


def shad_sentences(text: Column, least: int = 5) -> Column:
    """Pieces between shads of more than ``least`` characters, the shad put back."""
    parts = F.transform(F.split(text, SHAD), lambda s: F.regexp_replace(s, f"^[{WHITE}]+|[{WHITE}]+$", ""))
    return F.transform(F.filter(parts, lambda s: F.char_length(s) > least), lambda s: F.concat(s, F.lit(SHAD)))


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 bytes before a code-point offset."""
    return F.octet_length(F.substring(text, F.lit(1), at))


def bare(word: Column) -> Column:
    """The word without marks and spaces at its ends, as dictionaries hold it."""
    return F.regexp_replace(word, f"^[{TSHEG}{SHAD} ]+|[{TSHEG}{SHAD} ]+$", "")


def vowel_before_consonant(word: Column) -> Column:
    """A final vowel sign typed after one consonant too many changes places with it."""
    n = F.char_length(word)
    last, before = F.substring(word, -1, 1), F.substring(word, n - 1, F.lit(1))
    swapped = F.concat(F.substring(word, F.lit(1), n - 2), last, before)
    return F.when((n >= 3) & last.rlike("[ིེོུ]") & ~before.rlike("[ིེོུ]"), swapped).otherwise(word)


def final_consonant(word: Column) -> Column:
    """The closing consonant that chooses a particle's form, or ``open``."""
    last = F.regexp_extract(bare(word), f"[^{TSHEG}]*$", 0)
    letters = F.regexp_replace(last, "[^ཀ-ཪ]", "")
    closing = F.substring(letters, -1, 1)
    return (
        F.when(last.rlike("འ$"), "འ")
        .when((F.char_length(letters) <= 1) | last.rlike("[ཱ-྇ྐ-ྼ]$"), "open")
        .when(closing.rlike(f"[{FINALS}]"), closing)
        .otherwise("open")
    )


def context(text: Column, start: Column, end: Column, width: int = 20) -> Column:
    """The text around a span, clamped at its ends."""
    low = F.greatest(F.lit(0), start - width)
    return F.substring(text, low + 1, F.least(F.char_length(text), end + width) - low)


def occurrences_before(text: Column, needle: str, index: Column) -> Column:
    """Occurrences of ``needle``, overlapping ones too, that start before ``index``."""
    head = F.substring(text, F.lit(1), index + (len(needle) - 1))
    escaped = "".join(f"\\x{{{ord(c):x}}}" for c in needle)
    return F.regexp_count(head, F.lit(f"(?={escaped})"))
