import pytest
from pyspark.sql import functions as F

from kilnspark.functions import jsontext, quality, tables, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "step, given, expected",
    [
        (text.fix_ligatures, "وکالی", "وکلای"),
        (text.fix_ligatures, "دالیل", "دلایل"),
        (text.fix_ligatures, "عالوه", "علاوه"),
        (text.rejoin_dates, "1376/\n01/15", "1376/01/15"),
        (text.rejoin_dates, "1376-\n01-15", "1376-01-15"),
        (text.rejoin_dates, "۱۳۷۶/\n۰۱/۱۵", "۱۳۷۶/۰۱/۱۵"),
        (text.strip_tatweel, "قـانون", "قانون"),
        (text.to_persian, "كتابي", "کتابی"),
        (text.fix_half_spaces, "می روم", "می‌روم"),
        (text.fix_half_spaces, "کتاب اش", "کتاب‌اش"),
        (text.strip_controls, "a\x00b​c‌d\te", "abcd\te"),
        (text.tidy, "  a\n\n\n\nb    c \n", "a\n\nb c"),
        (text.nfkc, "ﬁ", "fi"),
        (text.fts_normalize, "ماده‌۲۲ كتاب", "ماده 22 کتاب"),
        (text.normalize, None, ""),
        (text.fts_normalize, None, ""),
    ],
)
def test_pairs(spark, step, given, expected):
    assert value(spark, step(F.lit(given).cast("string"))) == expected


def test_trigrams(spark):
    assert sorted(value(spark, text.trigrams(F.lit("Cat cat")))) == ["  c", " ca", "at ", "cat"]
    assert value(spark, text.set_similarity(text.trigrams(F.lit("")), text.trigrams(F.lit("")))) == 0.0
    assert value(spark, text.set_similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("words")))) == pytest.approx(4 / 7)


def test_stop_words_keep_order_and_repeats(spark):
    assert value(spark, text.remove_stop_words(F.split(F.lit("قانون در قانون مدنی"), " "))) == ["قانون", "قانون", "مدنی"]


@pytest.mark.parametrize(
    "signal, given, expected",
    [
        (quality.stopword_ratio, "", 0.0),
        (quality.stopword_ratio, "از به در", 1.0),
        (lambda c: quality.pair_plausibility(c, ["اب"]), "", 1.0),
        (lambda c: quality.pair_plausibility(c, ["اب"]), "و", 1.0),
        (lambda c: quality.pair_plausibility(c, ["اب"]), "اب ا", 0.5),
        (quality.connected_share, "", 1.0),
        (quality.connected_share, "ق ا نون", 0.6),
        (quality.isolated_share, "abc", 0.0),
        (quality.letter_entropy, "", 0.0),
        (quality.letter_entropy, "اب", 1.0),
        (lambda c: quality.quality_score(c, [], []), "  ", 0.0),
        (quality.shattered_ratio, "ق ا ن ون", 0.75),
        (quality.repeated_lines, "a\nb\na\na\nb\nb\nc", 2),
        (quality.repeated_lines, "a\na\na", 0),
        (quality.output_quality, " ", 0.0),
    ],
)
def test_quality(spark, signal, given, expected):
    assert value(spark, signal(F.lit(given))) == pytest.approx(expected)


def test_garbled_text_scores_lower(spark):
    known = ["خواهان", "خوانده", "شده"]
    pairs = ["خو", "وا", "اه", "ها", "ان", "ند", "ده", "شد"]
    score = lambda t: value(spark, quality.quality_score(F.lit(t), known, pairs))
    assert score("خوااهن") < score("خواهان")
    assert score("ناوخد") < score("خوانده")
    assert score("هدبش") < score("شده")


def test_verify(spark):
    check = lambda t: value(spark, quality.verify_extraction(F.lit(t)))
    assert check("").flags == ["empty_output"] and check("").confidence == 0.0
    assert check("abc").flags == ["too_short"]
    long = "ماده 1 متن قانون\nماده 9 متن قانون\nماده 2 متن قانون\nx\n" + "تکرار\n" * 3
    assert sorted(check(long).flags) == ["article_gap", "digit_conversion", "non_ascending_articles", "repeated_content"]
    assert check(long).confidence == pytest.approx(0.4)


@pytest.mark.parametrize(
    "lines, expected",
    [
        (["فهرست مطالب", "a 1", "b 2", "c 3", "d 4", "e 5"], True),
        (["Table of  Contents", "a ...... 1", "b ...... 2", "c ...... ۳"], True),
        (["a 1", "b 2", "c 3"], False),
        (["فهرست مطالب", "a 1", "b 2"], False),
        (["فهرست مطالب", "a 1", "b 2", "c 3", *["x"] * 6], False),
    ],
)
def test_table_of_contents(spark, lines, expected):
    assert value(spark, quality.is_table_of_contents(F.lit("\n".join(lines)))) is expected


def test_tables(spark):
    def table(*rows):
        return F.array(*(F.array(*(F.lit(c).cast("string") for c in r)) for r in rows))

    assert value(spark, tables.table_markdown(table(["نام", "خواهان"]))) == "| نام | خواهان |\n| --- | ------ |"
    assert value(spark, tables.table_markdown(table(["a", None], ["longer", " b "]))) == "| a      |     |\n| ------ | --- |\n| longer | b   |"
    assert value(spark, tables.table_markdown(F.lit(None).cast("array<array<string>>"))) == ""
    assert value(spark, tables.table_semantic_text(table(["نام", "خواهان"], ["علی", "احمدی"], ["x", None]))) == "نام: علی | خواهان: احمدی\nنام: x"
    assert value(spark, tables.table_semantic_text(table(["a", None, " b "]))) == "a | b"


@pytest.mark.parametrize(
    "given, expected",
    [("70 درصد - دعوای مستند به سند رسمی", 0.7), ("۷۵", 0.75), ("30", 0.3), ("نامشخص", 0.0), ("", 0.0), (None, 0.0), ("250", 1.0), ("0.7", 0.0)],
)
def test_probability(spark, given, expected):
    assert value(spark, jsontext.probability(F.lit(given).cast("string"))) == pytest.approx(expected)


def test_probability_number(spark):
    assert value(spark, jsontext.probability_number(F.lit(70.0))) == pytest.approx(0.7)
    assert value(spark, jsontext.probability_number(F.lit(0.85))) == pytest.approx(0.85)


@pytest.mark.parametrize(
    "given, strategy, expected",
    [
        ('{"a": 1}', "strict", {"a": 1}),
        ('```json\n{"a": 1}\n```', "fenced", {"a": 1}),
        ('{"a": "x\ny"}', "controls", {"a": "x y"}),
        ('Sure: {"a": 1} ok', "braces", {"a": 1}),
        ('{"a": [1, 2,], }', "commas", {"a": [1, 2]}),
        ('{"a": 1, "b": "cut', "closed", {"a": 1, "b": "cut"}),
        ('{"a": 1, "b"', "closed", {"a": 1}),
        ('{"a": {"b": [1, {"c": 2', "closed", {"a": {"b": [1, {"c": 2}]}}),
        ('x "a": "y", oops } {', "fields", {"a": "y"}),
        ("nothing", "none", {}),
        (None, "none", {}),
    ],
)
def test_salvage(given, strategy, expected):
    import json

    got, body = jsontext.salvage(given, ("a",))
    assert (got, json.loads(body)) == (strategy, expected)


def test_parse_tiers(spark):
    said = ['```json\n{"k": 1}\n```', '{"k": 2, "s": "a\tb"}', 'so {"k": 3} there', "none", None]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    got = rows.select(jsontext.parse_tier(F.col("s")).alias("t"), jsontext.field(jsontext.parse_json(F.col("s")), "$.k", "int").alias("k")).collect()
    assert [(r.t, r.k) for r in got] == [(1, 1), (2, 2), (3, 3), (None, None), (None, None)]


# texts and what the operators must make of them
BRACKETS = [
    (")سلام", "سلام)"), (") سلام", "سلام)"), ("متن )سلام دنیا", "متن سلام) دنیا"), ("))سلام", ")سلام)"), ("سلام(", "(سلام"), ("سلام (", "(سلام"),
    ("متن سلام( دنیا", "متن (سلام دنیا"), ("سلام((", "(سلام("), ("a (b) c", "a (b) c"), ("x)))y", "xy"), ("(((x\ny)", "x\ny)"), ("(a)b))))", "(a)b"), ("((((a)b", "(a)b"),
]
ANCHORS = [("رأي  دادگاه", "رای دادگاه"), (" مُادّه\n۱۲ ", "ماده ۱۲"), ("آئين  نامة", "ائین نامة"), ("كتاب", "کتاب"), ("plain", "plain")]
STEPS = [
    (text.fix_ligatures, "وکالی دالیل عالوه", "وکلای دلایل علاوه"),
    (text.rejoin_dates, "1376/\n01/15 ۱۳۷۶-\n۰۱-۱۵", "1376/01/15 ۱۳۷۶-۰۱-۱۵"),
    (text.strip_tatweel, "قـانون", "قانون"),
    (text.to_persian, "كتابي", "کتابی"),
    (text.fix_half_spaces, "می روم کتاب اش", "می‌روم کتاب‌اش"),
    (text.strip_controls, "a\u200bc\u200cd\te", "acd\te"),
    (text.tidy, "  a\n\n\n\nb    c \n", "a\n\nb c"),
    (text.nfkc, "ﬁ²", "fi2"),
    (text.fts_normalize, "ماده‌۲۲ كتاب", "ماده 22 کتاب"),
    (text.normalize, "  كتابـي\u200b ﬁ\n\n\n\nمی روم ", "کتابی fi\n\nمی‌روم"),
]


@pytest.mark.parametrize("given,made", BRACKETS)
def test_fix_brackets(spark, given, made):
    assert value(spark, text.fix_brackets(F.lit(given))) == made


@pytest.mark.parametrize("given,made", ANCHORS)
def test_anchor_form(spark, given, made):
    assert value(spark, text.anchor_form(F.lit(given))) == made


@pytest.mark.parametrize("step,given,made", STEPS)
def test_step(spark, step, given, made):
    assert value(spark, step(F.lit(given))) == made
