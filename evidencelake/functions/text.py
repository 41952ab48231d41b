"""Column builders for the text normalizers.

The normalizers differ on purpose (token, substring, label, answer, safety) and
must not be unified.  All of them start from the same accent and case fold,
which is built once from the Unicode database as a ``translate`` table, so text
stays inside the JVM.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns of the retrieval, verifier and answer normalizers.
RETRIEVAL_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
VERIFIER_TOKEN = r"[a-z0-9]+"
ANSWER_TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"

# Words the verifier ignores.
VERIFIER_STOP_WORDS = (
    "a", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "is", "o", "os",
    "para", "the", "um", "uma",
)


# Blocks outside (Han, Hangul, private use) never fold to ASCII or to nothing.
_FOLDING_RANGES = (
    range(0x0000, 0x3400),
    range(0xA000, 0xAC00),
    range(0xF900, 0x10000),
    range(0x10000, 0x20000),
)


def _base_letters(char: str) -> str:
    """What is left of a character after full decomposition, without combining marks."""
    parts = unicodedata.decomposition(char).split()
    if not parts:
        return "" if unicodedata.combining(char) else char
    mapped = parts[1:] if parts[0].startswith("<") else parts
    return "".join(_base_letters(chr(int(code, 16))) for code in mapped)


def folded_character(char: str, *, casefold: bool = True) -> str:
    """The fold of one character; the fold of a text is that of its characters, one after another."""
    return "".join(map(_base_letters, char.casefold() if casefold else char))


@functools.lru_cache(maxsize=2)
def _translate_table(casefold: bool) -> tuple[str, str, dict[str, str]]:
    """Split the fold into 1:1 replacements, deletions and expansions."""
    singles_from, singles_to, deleted, expansions = [], [], [], {}
    for code in itertools.chain(*_FOLDING_RANGES):
        char = chr(code)
        folded = folded_character(char, casefold=casefold)
        if folded == char:
            continue
        if not folded:
            deleted.append(char)
        elif len(folded) == 1:
            singles_from.append(char)
            singles_to.append(folded)
        else:
            expansions[char] = folded
    return "".join(singles_from + deleted), "".join(singles_to), expansions


def _ranges(codes: list[int], gap: int) -> str:
    """Ranges that hold the codes; codes nearer than ``gap`` share one."""
    edges = [0, *(i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > gap), len(codes)]
    return "".join(f"\\x{{{codes[a]:x}}}-\\x{{{codes[b - 1]:x}}}" for a, b in itertools.pairwise(edges))


def _class_of(chars: frozenset[str]) -> str:
    """Inside of a character class; a few wide ranges settle most characters before the exact ones are asked."""
    codes = sorted(map(ord, chars))
    return f"{_ranges(codes, 64)}&&[{_ranges(codes, 1)}]"


#: Stands in a translated text for characters of several letters; no text has to hold it, and one that does is cut up too.
_SEVERAL_HERE = "\ufdd0"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(text: Column, plain: Column, casefold: bool) -> Column:
    """The fold of a text; ``plain`` is the fold of pure ASCII, found by comparing byte and character counts.

    Characters that stand for several letters are looked up only in the rows
    that hold one.  One translation folds all others and marks such rows: it
    costs a table look-up a character, a pattern of all of them would cost a
    thousand times that.  The rows are cut around the characters found.  The
    German sharp s is frequent, so it is written out before.
    """
    source, target, several = _translate_table(casefold)
    eased = F.replace(text, F.lit("ß"), F.lit("ss")) if casefold else text
    kept, marks = "".join(several), _SEVERAL_HERE * len(several)
    wide = _class_of(frozenset(several))
    table = F.from_json(F.lit(json.dumps(several, ensure_ascii=False)), "map<string,string>")
    single = F.translate(text, source, target)
    parts = F.regexp_extract_all(single, F.lit(f"[{wide}]|[^{wide}]+"), F.lit(0))
    written = F.array_join(F.transform(parts, lambda part: F.coalesce(F.try_element_at(table, part), part)), "")
    marked = F.translate(eased, source[: len(target)] + kept + source[len(target) :], target + marks)
    folded = _bound(marked, lambda m: F.when(F.contains(m, F.lit(_SEVERAL_HERE)), written).otherwise(m))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(folded)


def fold(text: Column) -> Column:
    """Casefold, decompose and drop combining marks, inside the JVM.

    Ligatures, fractions, squared letters and other characters that stand for
    several letters are written out.
    """
    return _folded(text, F.lower(text), True)


def strip_marks(text: Column) -> Column:
    """Decompose and drop combining marks but keep case (safety patterns)."""
    return _folded(text, text, False)


def tokens(text: Column) -> Column:
    """Retrieval tokens: words, codes such as ``px-101`` and numbers as ``10.5``."""
    return F.regexp_extract_all(fold(text), F.lit(RETRIEVAL_TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct verifier tokens longer than one letter without stop words."""
    found = F.regexp_extract_all(fold(text), F.lit(VERIFIER_TOKEN), F.lit(0))
    return F.filter(
        F.array_distinct(found),
        lambda t: (F.length(t) > 1) & ~t.isin(*VERIFIER_STOP_WORDS),
    )


def answer_text(text: Column) -> Column:
    """Answer normalizer: tokens joined by single blanks, matched by substring."""
    return F.array_join(
        F.regexp_extract_all(fold(text), F.lit(ANSWER_TOKEN), F.lit(0)), " "
    )


def label_text(text: Column) -> Column:
    """Label normalizer: every run of other characters becomes one blank."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def collapse_blanks(text: Column) -> Column:
    """Join the blank-separated words with single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_any(text: Column, signals: tuple[str, ...]) -> Column:
    """Substring test against a closed word list (never a token test)."""
    found = F.lit(False)
    for signal in signals:
        found = found | F.contains(text, F.lit(signal))
    return found


def byte_tokens(text: Column, bytes_per_token: int = 4) -> Column:
    """Token estimate: bytes rounded up to whole tokens; empty text costs none."""
    if bytes_per_token <= 0:
        raise ValueError("a token takes at least one byte")
    size = F.octet_length(text)
    return F.ceil(size / F.lit(bytes_per_token)).cast("bigint")


def word_tokens(text: Column) -> Column:
    """Token estimate: number of blank-separated words."""
    flat = collapse_blanks(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " "))).cast("bigint")
