"""Text and language functions: Column in, Column out, nothing leaves the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import constants as C

#: All decimal digits that are not ASCII, and what each becomes.
OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
PLAIN_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def filled(text: Column) -> Column:
    """Whether a text has anything but white space; false for null."""
    return F.coalesce(text.rlike(rf"[^\n\r\x{{000B}}\x{{000C}}\x{{001C}}-\x{{001E}}\x{{0085}}\x{{2028}}\x{{2029}}{C.BLANKS}]"), F.lit(False))


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of a class a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{characters}]")), F.lit(0))


def language(text: Column) -> Column:
    """Language of Arabic-English texts with confidence and shares: struct(lang, confidence, arabic, latin, digits).

    Null and blank texts, and texts without letters and digits, are ``unknown`` with confidence 0.
    """
    arabic, latin, digits = (occurrences(text, c).cast("double") for c in (C.ARABIC_LETTERS, C.LATIN, C.DIGITS))
    total = F.nullif(arabic + latin + digits, F.lit(0.0))
    share = [F.coalesce(n / total, F.lit(0.0)) for n in (arabic, latin, digits)]
    known = filled(text) & total.isNotNull()
    name = F.when(~known, "unknown").when((arabic > 0) & (latin > 0), "ar-en").when(arabic > 0, "ar").when(latin > 0, "en").otherwise("numeric")
    sure = F.when(~known, 0.0).when((arabic > 0) & (latin > 0), share[0] + share[1]).when(arabic > 0, F.greatest(F.lit(0.6), share[0])).when(latin > 0, F.greatest(F.lit(0.6), share[1])).otherwise(share[2])
    return F.struct(name.alias("lang"), sure.alias("confidence"), share[0].alias("arabic"), share[1].alias("latin"), share[2].alias("digits"))


def direction(text: Column) -> Column:
    """``rtl`` for Arabic alone, ``auto`` for Arabic with Latin letters or digits, else ``ltr``."""
    arabic, rest = occurrences(text, C.ARABIC_LETTERS), occurrences(text, C.LATIN + C.DIGITS)
    return F.when((arabic > 0) & (rest > 0), "auto").when(arabic > 0, "rtl").otherwise("ltr")


def script(text: Column) -> Column:
    """mixed, arabic, latin, numeric or unknown."""
    arabic, latin, digits = (occurrences(text, c) for c in (C.ARABIC_LETTERS, C.LATIN, C.DIGITS))
    return F.when((arabic > 0) & (latin > 0), "mixed").when(arabic > 0, "arabic").when(latin > 0, "latin").when(digits > 0, "numeric").otherwise("unknown")


def engine_script(text: Column) -> Column:
    """The recognizer's own names of scripts: mixed, ar, latin, numeric, symbol, or unknown for null and empty."""
    arabic, latin, digits = (occurrences(text, c) for c in (C.ARABIC_BLOCK, C.LATIN, C.DIGITS_ARABIC_INDIC))
    found = F.when((arabic > 0) & (latin > 0), "mixed").when(arabic > 0, "ar").when(latin > 0, "latin").when(digits > 0, "numeric").otherwise("symbol")
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(found)


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, rf"^[\n\r{C.BLANKS}]+|[\n\r{C.BLANKS}]+$", "")


def normalized(text: Column) -> Column:
    """Logical text: no direction controls, plain blanks, lines stripped, order untouched; null gives an empty text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{C.BIDI}]", "")
    plain = F.translate(plain, "  ​", "  ")
    plain = F.regexp_replace(F.regexp_replace(plain, C.LINE_ENDS, "\n"), "[ \t]+", " ")
    return stripped(F.regexp_replace(plain, rf"(?m)^[{C.BLANKS}]+|[{C.BLANKS}]+$", ""))


def bidi_safe(text: Column) -> Column:
    """Whether a text forces no direction."""
    return ~F.coalesce(text.rlike(f"[{C.BIDI}]"), F.lit(False))


def without_tashkeel(text: Column) -> Column:
    return F.regexp_replace(text, f"[{C.TASHKEEL}]", "")


def plain_digits(text: Column) -> Column:
    """Every decimal digit as ASCII."""
    return F.translate(text, OTHER_DIGITS, PLAIN_DIGITS)


def folded_arabic(text: Column) -> Column:
    """Without marks, with one letter each for the spellings of alef, teh marbuta and yeh, lower case."""
    return F.lower(F.translate(without_tashkeel(text), "أإآٱةى", "ااااهي"))


def _fold(word: str) -> str:
    return word.translate(str.maketrans("أإآٱةى", "ااااهي")).lower()


def address_line(line: Column) -> Column:
    """Whether a line looks like part of an address."""
    text = folded_arabic(line)
    words = [*C.ADDRESS_WORDS, *C.GOVERNORATES.values()]
    return F.coalesce(text.rlike(r"(?:^|[\s\p{Z}]|\p{Nd})ش(?:[\s\p{Z}]|\.|/|$)") | any_of(text, [_fold(w) for w in words]), F.lit(False))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text contains one of the words."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in dict.fromkeys(words)))


def is_card_title(text: Column) -> Column:
    clean = without_tashkeel(stripped(text))
    return reduce(lambda a, b: a | b, (clean.rlike(p) for p in C.CARD_PATTERNS))


def _is_header(text: Column) -> Column:
    clean = without_tashkeel(stripped(text))
    return reduce(lambda a, b: a | b, (clean.rlike(p) for p in C.HEADER_PATTERNS))


def corrected_line(line: Column) -> Column:
    """A recognised line with its known misreadings put right; headers and titles take their canonical form."""
    text = stripped(line)
    fixed = F.regexp_replace(text, rf"(?<![{C.WORD}])عبا\s+({'|'.join(C.ABD_NAMES)})(?![{C.WORD}])", "عبد $1")
    for wrong, right in (C.NAME_REPAIRS | C.PLACE_REPAIRS).items():
        fixed = F.regexp_replace(fixed, rf"(?<![{C.WORD}]){wrong}(?![{C.WORD}])", right)
    fixed = stripped(F.regexp_replace(F.regexp_replace(fixed, "[؛«»^~|_]+", " "), r"[\s\p{Z}]{2,}", " "))
    return (
        F.when(F.coalesce(line, F.lit("")) == "", "")
        .when(_is_header(line) & ~any_of(text, C.CARD_WORDS), C.HEADER)
        .when(is_card_title(line), C.CARD_TITLE)
        .otherwise(fixed)
    )


def corrected_lines(lines: Column) -> Column:
    """Lines of a card in order: the first three may be a header told by the title in the two lines after them."""

    def one(line: Column, i: Column) -> Column:
        text = stripped(line)
        after = F.concat_ws(" ", F.slice(lines, i + 2, 2))
        told = text.rlike("[جمهورصالحبينمكذفنع]") & (F.length(text) >= 3) & any_of(after, ["بطاقة", "بطاقه", "تحقيق"])
        return (
            F.when((i <= 2) & ~any_of(text, C.CARD_WORDS) & (_is_header(line) | told), C.HEADER)
            .when(is_card_title(line), C.CARD_TITLE)
            .when(text.rlike(r"^تحقيق\s+[ا|.]\s*$"), "تحقيق")
            .otherwise(corrected_line(line))
        )

    return F.transform(lines, one)


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), C.LINE_ENDS), stripped), lambda x: x != "")


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[\n\r\x{{000B}}\x{{000C}}\x{{001C}}-\x{{001E}}\x{{0085}}\x{{2028}}\x{{2029}}{C.BLANKS}]+"), lambda x: x != "")


def title_case(name: Column) -> Column:
    """``first_name`` as ``First Name``."""
    return F.initcap(F.translate(name, "_", " "))
