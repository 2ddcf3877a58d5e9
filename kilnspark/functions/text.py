"""Text functions on columns: normalisation, words, trigrams.

Everything is a built-in expression except Unicode NFKC, which Spark lacks and which runs
as an Arrow function. Java's ``\\w``, ``\\d`` and ``\\b`` know only ASCII, so patterns
start with ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once.

    An expression that a lambda of a higher-order function refers to is evaluated for every
    element; through this, the lambda refers to a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


ZWNJ = "‌"

# fixed values: Arabic letters and the Persian ones they become
ARABIC = "يكئؤآإأۀۂة"
PERSIAN = "یکیواااههه"
# fixed values: marks that go
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
# fixed values: digits
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
DIGITS = "0123456789"
#: Letters and digits that keyword search does not tell apart, and what stands for them.
FTS_LETTERS = (ARABIC + PERSIAN_DIGITS + ARABIC_DIGITS + ZWNJ, PERSIAN + DIGITS + DIGITS + " ")
# fixed values: words that decomposed ligatures garble, and their repair, in this order
LIGATURES = {
    "وکالی": "وکلای",
    "دالیل": "دلایل",
    "سالم": "سلام",
    "عالوه": "علاوه",
    "مثالم": "مثال",
    "اعالم": "اعلام",
    "اقالم": "اقلام",
    "قبال": "قبل",
    "حاالت": "حالت",
    "معامالت": "معاملات",
    "مطالبات": "مطالبات",
    "اصالح": "اصلاح",
    "تفاصیل": "تفصیل",
    "مقاالت": "مقالات",
    "رساالت": "رسالات",
    "مسیول": "مسئول",
    "هیأت": "هیئت",
    "اطلاعت": "اطلاعات",
    "علالخصوص": "علی‌الخصوص",
}
# fixed values: words joined to the next one, words joined to the one before
JOINED_NEXT = ("می", "نمی", "خواه")
JOINED_BEFORE = ("اش", "ات", "ام")
JOINED_NEXT_TOO = ("به", "هم", "غیر", "میان", "پیش", "پس", "علی", "بین")
# fixed values: control and formatting characters that go
CONTROLS = "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u0080-\u009f​-‏ - ⁠-⁤﻿￼­]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def to_persian(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ARABIC, PERSIAN), DIACRITICS, "")


def fix_ligatures(c: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), c)


def strip_tatweel(c: Column) -> Column:
    return F.translate(c, "ـ", "")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def fix_half_spaces(c: Column) -> Column:
    """Put a zero-width non-joiner where a prefix or suffix stands apart."""
    after = lambda c, w: F.regexp_replace(c, rf"(?U)\b{w}\s+(\w)", f"{w}{ZWNJ}$1")
    before = lambda c, w: F.regexp_replace(c, rf"(?U)(\w)\s+{w}\b", f"$1{ZWNJ}{w}")
    return reduce(after, JOINED_NEXT_TOO, reduce(before, JOINED_BEFORE, reduce(after, JOINED_NEXT, c)))


def rejoin_dates(c: Column) -> Column:
    """Dates that a line break split after the year become one token again."""
    for mark in "/-":
        c = F.regexp_replace(c, rf"(?U)(\d{{2,4}})\s*{mark}\s*\n\s*(\d{{1,2}})\s*{mark}\s*(\d{{1,2}})", f"$1{mark}$2{mark}$3")
    return c


def tidy(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {3,}", " ")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize(c: Column) -> Column:
    """All steps in their fixed order; a null becomes empty."""
    steps = (nfkc, fix_ligatures, strip_tatweel, strip_controls, to_persian, fix_half_spaces, rejoin_dates, tidy)
    return reduce(lambda c, step: step(c), steps, F.coalesce(c, F.lit("")))


def fts_normalize(c: Column, unicode_forms: bool = True) -> Column:
    """The form under which texts and queries meet in keyword search.

    ``unicode_forms=False`` leaves out NFKC and so keeps the whole expression in the JVM.
    """
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if unicode_forms else c
    # none of the letters is ASCII, and most texts of some corpora are nothing else
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(c, *FTS_LETTERS))


def fts_normalized(text: str) -> str:
    """:func:`fts_normalize` of one query."""
    return unicodedata.normalize("NFKC", text or "").translate(str.maketrans(*FTS_LETTERS))


# fixed values: letters that anchors do not tell apart, and what stands for them
ANCHOR_LETTERS = ("يكأإآ", "یکااا")


def anchor_form(c: Column) -> Column:
    """The form in which anchors are looked for: no marks, letters made alike, single blanks."""
    bare = F.translate(F.regexp_replace(c, DIACRITICS, ""), *ANCHOR_LETTERS)
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


# fixed values: the letters beside which a bracket may be misplaced
BRACKETED = "\u0600-\u06FF\uFB8A\uFE8D\uFEE3\uFEFB\uFEFC"


def fix_brackets(c: Column, least: int = 3) -> Column:
    """Brackets on the wrong side of a Persian word change sides; then, in lines where one kind
    outnumbers the other by ``least`` or more, the excess goes: closing ones from the end,
    opening ones from the start."""
    c = F.regexp_replace(c, rf"(?U)(?<![{BRACKETED}])\s*\)\s*([{BRACKETED}]+)", "$1)")
    c = F.regexp_replace(c, rf"(?U)([{BRACKETED}]+)\s*\(\s*(?![{BRACKETED}])", "($1")

    def balanced(line: Column) -> Column:
        opened, closed = F.split(line, r"\(", -1), F.split(line, r"\)", -1)
        more = F.size(closed) - F.size(opened)
        # of closing brackets the first stay, of opening ones the last: as many as of the other
        first = lambda xs, n: F.slice(xs, F.lit(1), n)
        rest = lambda xs, n: F.slice(xs, n + 1, F.size(xs))
        without_last = F.concat(F.array_join(first(closed, F.size(opened)), ")"), F.array_join(rest(closed, F.size(opened)), ""))
        gone = F.greatest(F.lit(1), 1 - more)
        without_first = F.array_join(F.concat(F.array(F.array_join(first(opened, gone), "")), rest(opened, gone)), "(")
        return F.when(more >= least, without_last).when(more <= -least, without_first).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n", -1), balanced), "\n")


WORD = r"[\p{L}\p{N}_]+"


def words(c: Column) -> Column:
    """Lower-cased words in order, with repeats; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def split_words(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


# fixed values: Persian function words that queries lose
STOP_WORDS = (
    "و", "در", "به", "از", "که", "با", "برای", "این", "آن", "را", "ها", "های", "می", "هم", "نیز", "اگر",
    "اما", "ولی", "یا", "باید", "شاید", "ممکن", "خواهد", "باشند", "است", "هست", "شد", "شود", "شده", "کرد",
    "کند", "گفت", "دهد", "دارد", "داشت", "باشه", "باشید", "باشیم", "باشم", "باشی", "بود", "بودن", "بوده",
    "باشد", "هستند", "هستم", "هستی", "نمی", "نباید", "نخواهد", "نکرد", "نکند", "نگفت", "هر", "چند", "چگونه",
    "چیست", "چه", "چرا", "کجا", "کی", "اینکه", "آنکه", "آنچه", "هرچه", "هرکس", "هرکه", "تحت", "طی", "درباره",
    "دربارۀ", "پیرامون", "مربوط", "قبل", "بعد", "بالا", "پایین", "داخل", "خارج", "جلوی", "علیه", "ضد", "جز",
    "غیر", "خیلی", "بسیار", "کم", "اندکی", "تقریبا", "حدود", "البته", "قطعا", "مسلما", "حتما", "پس", "پیش",
    "کنون", "اکنون", "هنوز", "همچنان", "همچنین", "همیشه", "گاهی", "گاه", "برخی", "بعضی", "بعضا", "سراسر",
    "تمام", "تمامی", "همه", "همگی", "بدون", "بی", "باوجود", "علیرغم", "طبق", "براساس", "برپایه", "برمبنای",
    "برطبق", "ضمن", "هنگام", "زمان", "وقتی", "موقع", "نظیر", "مانند", "مثل", "همچو", "چو", "جزیی", "جزئی",
    "لذا", "بنابراین", "ازاینرو", "معذلک", "الا", "مگر", "زیرا", "چون", "اگرچه", "هرچند",
)


def remove_stop_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that are no stop words, order and repeats kept."""
    stops = F.array(*map(F.lit, stop_words))
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t))


def trigrams(c: Column) -> Column:
    """The set of character triples of the lower-cased words, padded by two blanks before and one after.

    Padded words stand on lines of their own, so one look-ahead pattern finds every triple
    within a line.
    """
    lines = F.concat(F.lit("  "), F.array_join(F.array_distinct(words(c)), " \n  "), F.lit(" "))
    found = F.array_distinct(F.regexp_extract_all(lines, F.lit("(?=([^\n]{3}))"), F.lit(1)))
    return F.filter(found, lambda g: g != "   ")  # of no words, three blanks are left


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))
