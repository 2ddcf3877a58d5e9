"""Signals of garbled extraction, as column expressions.

``letters`` is the regular-expression class of the script that is judged (Persian by
default). Word lists and letter pairs are parameters: they come from a table or a rule
(:func:`pairs_of`), not from this file.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, split_words

PERSIAN_LETTERS = "؀-ۿ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~،؛؟«»"

# fixed values: general function words and words of court documents
GENERAL_WORDS = (
    "از", "به", "در", "با", "برای", "و", "که", "این", "آن", "را", "تا", "یا", "اما", "اگر", "البته", "باید",
    "شاید", "ممکن", "بعد", "قبل", "زیر", "روی", "بین", "درباره", "مثل", "مانند", "چون", "زیرا", "بنابراین",
    "پس", "خواهد", "می", "است", "شد", "شود", "شده", "دارد", "داشت", "کرد", "کند", "گفت", "دهد", "بود", "باشند",
    "باشد", "نیز", "هم", "حدود", "سایر", "غیر",
)
COURT_WORDS = (
    "دادگاه", "شعبه", "خواهان", "خوانده", "دادنامه", "پرونده", "کلاسه", "رأی", "حکم", "قانون", "ماده", "تبصره",
    "مصوب", "الزام", "محکوم", "مستند", "مستندات", "دلایل", "ادعا", "دعوی", "درخواست", "اعتراض", "تجدیدنظر",
    "فرجام", "وکالت", "وکیل", "مدعی", "منع", "قبول", "رد", "ابطال", "تنفیذ", "استرداد", "تامین", "خسارت",
    "هزینه", "دادرسی", "کارشناسی", "کارشناس", "رای", "شرح", "گردش", "کار", "مندرج", "ذیل",
)


def _listed(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def only_letters(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{letters}]", "")


def stopword_ratio(c: Column, stop_words: Iterable[str] = (*GENERAL_WORDS, *COURT_WORDS)) -> Column:
    """Share of tokens that are function words; 0 without tokens."""
    stops, tokens = _listed(stop_words), split_words(c)
    return _share(F.size(F.filter(tokens, lambda t: F.array_contains(stops, t))), F.size(tokens), 0.0)


def letter_tokens(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    return F.filter(split_words(c), lambda t: t.rlike(f"[{letters}]"))


def lexicon_validity(c: Column, lexicon: Iterable[str], letters: str = PERSIAN_LETTERS) -> Column:
    """Share of the script's tokens that, without outer punctuation, are known words; 0 without tokens."""
    known, tokens = _listed(lexicon), letter_tokens(c, letters)
    bare = F.transform(tokens, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return _share(F.size(F.filter(bare, lambda t: F.array_contains(known, t))), F.size(tokens), 0.0)


def letter_pairs(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """Neighbouring letters after everything else is taken out (so pairs reach across words)."""
    chars = F.filter(F.split(only_letters(c, letters), ""), lambda x: x != "")
    none = F.array().cast("array<string>")
    pairs = lambda cs: F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.concat(a, b))
    return let(chars, lambda cs: F.when(F.size(cs) >= 2, pairs(cs)).otherwise(none))


def pairs_of(words: DataFrame, min_count: int = 1) -> DataFrame:
    """``pair, n``: letter pairs of a column ``word``, the rule from which a plausible set is built."""
    pair = F.explode(letter_pairs(F.col("word"), r"\p{L}"))
    return words.select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def pair_plausibility(c: Column, pairs: Iterable[str], letters: str = PERSIAN_LETTERS) -> Column:
    """Share of neighbouring letter pairs that are usual; 1 with fewer than two letters."""
    usual, found = _listed(pairs), letter_pairs(c, letters)
    return _share(F.size(F.filter(found, lambda p: F.array_contains(usual, p))), F.size(found), 1.0)


def connected_share(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """Share of the script's letters next to another one; 1 without letters.

    A letter stands alone exactly if its run has length one, so runs are taken out.
    """
    text = F.coalesce(c, F.lit(""))
    total = F.length(only_letters(text, letters))
    alone = F.length(only_letters(F.regexp_replace(text, f"[{letters}]{{2,}}", " "), letters))
    return _share(total - alone, total, 1.0)


def isolated_share(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """The older measure: share of letters that stand alone; 0 without letters."""
    return F.when(F.length(only_letters(c, letters)) == 0, F.lit(0.0)).otherwise(1 - connected_share(c, letters))


def letter_entropy(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """Shannon entropy (bits) of the script's letters in the text; 0 without letters."""
    def entropy(kept: Column) -> Column:
        total = F.length(kept).cast("double")
        # the distinct letters, then how much of the text goes with each
        distinct = F.filter(F.array_distinct(F.split(kept, "")), lambda x: x != "")
        shares = F.transform(distinct, lambda x: (total - F.length(F.replace(kept, x))) / total)
        summed = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
        return F.when(total == 0, F.lit(0.0)).otherwise(summed)

    return let(only_letters(c, letters), entropy)


def quality_score(c: Column, lexicon: Iterable[str], pairs: Iterable[str], letters: str = PERSIAN_LETTERS, stop_words: Iterable[str] = (*GENERAL_WORDS, *COURT_WORDS)) -> Column:
    """0 (garbage) to 1: five weighted signals; 0 for blank text."""
    weighted = (
        0.30 * stopword_ratio(c, stop_words)
        + 0.25 * lexicon_validity(c, lexicon, letters)
        + 0.15 * pair_plausibility(c, pairs, letters)
        + 0.20 * connected_share(c, letters)
        + 0.10 * (1 - F.least(letter_entropy(c, letters) / 5, F.lit(1.0)))
    )
    return F.when(is_blank(c), F.lit(0.0)).otherwise(weighted)


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def is_garbled(c: Column, lexicon: Iterable[str], pairs: Iterable[str], threshold: float = 0.3, **how) -> Column:
    return ~is_blank(c) & (quality_score(c, lexicon, pairs, **how) < threshold)


def shattered_ratio(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """Share of the script's tokens that hold just one of its letters; 0 without tokens."""
    tokens = letter_tokens(c, letters)
    single = F.filter(tokens, lambda t: F.length(F.regexp_replace(t, f"[^{letters}]", "")) == 1)
    return _share(F.size(single), F.size(tokens), 0.0)


def is_shattered(c: Column, letters: str = PERSIAN_LETTERS, threshold: float = 0.4) -> Column:
    return shattered_ratio(c, letters) > threshold


def stripped_lines(c: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def repeated_lines(c: Column, min_lines: int = 4, times: int = 3) -> Column:
    """How many different lines occur ``times`` times or more, in texts of ``min_lines`` lines or more.

    Sorting brings equal lines together: a line repeats enough if it equals the one
    ``times - 1`` places on, and is counted where its run starts.
    """
    def starts(lines: Column) -> Column:
        found = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
            lambda i: (F.get(lines, i - 1) == F.get(lines, i + times - 2))
            & ((i == 1) | (F.get(lines, F.greatest(i - 2, F.lit(0))) != F.get(lines, i - 1))),
        )
        return F.when(F.size(lines) >= min_lines, F.size(found)).otherwise(0)

    return let(F.array_sort(stripped_lines(c)), starts)


def output_quality(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """0 to 1 from the number of letters, the length and the variety of characters."""
    text = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    unique = F.size(F.filter(F.array_distinct(F.split(text, "")), lambda x: x != ""))
    score = (
        0.4 * F.least(F.length(only_letters(text, letters)) / 100, F.lit(1.0))
        + 0.3 * F.least(F.length(bare) / 500, F.lit(1.0))
        + 0.3 * F.least(unique / 50, F.lit(1.0))
    )
    return F.when(is_blank(c), F.lit(0.0)).otherwise(score)


ARTICLE = r"(?U)ماده\s*(\d+)"


def article_numbers(c: Column, pattern: str = ARTICLE) -> Column:
    from .text import ARABIC_DIGITS, DIGITS, PERSIAN_DIGITS

    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda n: F.translate(n, PERSIAN_DIGITS + ARABIC_DIGITS, DIGITS * 2).cast("long"))


def number_jumps(numbers: Column) -> Column:
    """Steps between neighbouring numbers that skip more than one or go back."""
    none = F.array().cast("array<bigint>")
    step = lambda ns: F.zip_with(F.slice(ns, 1, F.size(ns) - 1), F.slice(ns, 2, F.size(ns) - 1), lambda a, b: b - a)
    steps = let(numbers, lambda ns: F.when(F.size(ns) >= 2, step(ns)).otherwise(none))
    return F.filter(steps, lambda s: (s > 2) | (s < 0))


def verify_extraction(c: Column, letters: str = PERSIAN_LETTERS) -> Column:
    """``struct(verified, confidence, flags)`` of an extracted page; each flag costs 0.15."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+\z", "")
    n_letters = F.length(only_letters(text, letters))
    ratio = n_letters / F.greatest(F.length(text), F.lit(1))
    jumps = number_jumps(article_numbers(text))
    flag = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(
        flag((n_letters > 0) & (ratio < 0.1), "low_letter_ratio"),
        F.transform(jumps, lambda j: F.when(j > 2, F.lit("article_gap")).otherwise(F.lit("non_ascending_articles"))),
        flag(text.rlike("[0-9]") & ~text.rlike("[۰-۹]") & (ratio > 0.2), "digit_conversion"),
        flag(repeated_lines(text) > 0, "repeated_content"),
    )
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - F.size(flags) * 0.15))
    made = lambda ok, conf, fl: F.struct(ok.alias("verified"), conf.cast("double").alias("confidence"), fl.alias("flags"))
    return (
        F.when(F.length(text) == 0, made(F.lit(False), F.lit(0.0), F.array(F.lit("empty_output"))))
        .when(F.length(text) < 10, made(F.lit(False), F.lit(0.1), F.array(F.lit("too_short"))))
        .otherwise(made(F.size(flags) == 0, confidence, flags))
    )


# fixed values: titles of a table of contents
TOC_TITLES = (r"فهرست\s+مطالب", r"فهرست\s+مندرجات", r"فهرست\s+اجمالی", r"فهرست\s+تفصیلی", r"(?i:Table\s+of\s+Contents)")


def is_table_of_contents(c: Column, titles: Iterable[str] = TOC_TITLES, head: int = 300, min_lines: int = 3, min_ratio: float = 0.4) -> Column:
    """A title near the start and enough lines that end in a number or hold a row of dots."""
    text = F.coalesce(c, F.lit(""))
    # a final line break starts no further line
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    structural = F.filter(lines, lambda x: x.rlike(r"[.…]{3,}") | F.regexp_replace(x, r"(?U)\s+$", "").rlike("[0-9۰-۹٠-٩]$"))
    return (
        ~is_blank(c)
        & F.substring(text, 1, head).rlike("(?U)" + "|".join(titles))
        & (F.size(structural) >= min_lines)
        & (F.size(structural) / F.size(lines) >= min_ratio)
    )
