"""Compatibility decomposition without combining marks, as column expressions.

Spark has no such function.  The table comes from the Unicode data of this Python by a rule: for each code point its
decomposition less the combining marks.  It is a two-level lookup: the high bits of a code point name a page of 256
entries, and pages without an entry share one that is empty.  Hangul syllables, which decompose by arithmetic, are none of
its entries.  As marks go, their canonical order doesn't matter.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 256
#: The first code points of Hangul syllables and of their three parts, and how many there are of each part.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
VOWEL_COUNT, TAIL_COUNT, SYLLABLE_COUNT = 21, 28, 11172


def bare(c: str) -> str:
    """A character's compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@functools.cache
def pages() -> tuple[str, str]:
    """JSON of the number of each code point's page (by its high bits), and of the pages: null where nothing changes."""
    numbers, found = [], [[None] * PAGE]
    for first in range(0, 0x110000, PAGE):
        page = [None] * PAGE
        for k in range(PAGE):
            point = first + k
            if 0xD800 <= point < 0xE000 or SYLLABLES <= point < SYLLABLES + SYLLABLE_COUNT:
                continue
            c = chr(point)
            if point > 127 and (new := bare(c)) != c:
                page[k] = new
        numbers.append(len(found) if any(x is not None for x in page) else 0)
        if numbers[-1]:
            found.append(page)
    return json.dumps(numbers), json.dumps(found)


def nfkd(text: Column) -> Column:
    """``text`` decomposed for compatibility, without combining marks; ASCII texts are only looked at once; null stays null."""
    numbers, found = pages()
    # constants, which the optimizer folds to one literal each
    number, page = F.from_json(F.lit(numbers), "array<int>"), F.from_json(F.lit(found), "array<array<string>>")

    def of(c: Column) -> Column:
        point = F.ascii(c)
        entry = F.get(F.get(page, F.get(number, F.floor(point / PAGE).cast("int"))), point % PAGE)
        at = point - SYLLABLES
        char = lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("long")), 4, "0")), "UTF-16BE")
        parts = F.concat(char(LEADS + F.floor(at / (VOWEL_COUNT * TAIL_COUNT))), char(VOWELS + F.floor(at % (VOWEL_COUNT * TAIL_COUNT) / TAIL_COUNT)), F.when(at % TAIL_COUNT == 0, "").otherwise(char(TAILS + at % TAIL_COUNT)))
        return F.when((at >= 0) & (at < SYLLABLE_COUNT), parts).otherwise(F.coalesce(entry, c))

    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(r"[\x00-\x7F]"), c).otherwise(of(c))), ""))
