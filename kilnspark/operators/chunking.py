"""Structure-aware chunking of documents with page provenance, in expressions and rows.

Sections start at anchors; sentences are packed up to a token limit with an overlap;
sections that are too small join the next one. All offsets refer to one text (the input
without its page markers), so chunks are lossless: without overlap they cover every
character that is no white space, in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ANCHOR_LETTERS, DIACRITICS, anchor_form, let
from ..stored import stored

# fixed values: anchors at which a section starts, and the kind of section
SECTION_KINDS = (
    (r"ر[أا]ی[\s‌]+دادگاه", "verdict"),
    (r"دادنامه", "verdict"),
    (r"قرار[\s‌]+دادگاه", "verdict"),
    (r"گردشکار", "proceedings"),
    (r"گردش[\s‌]+کار", "proceedings"),
    (r"خلاصه[\s‌]+گردشکار", "proceedings"),
    (r"صورت[\s‌]*جلسه", "minutes"),
    (r"صورت[\s‌]*مجلس", "minutes"),
    (r"جلسه[\s‌]+رسیدگی", "minutes"),
    (r"ختم[\s‌]+دادرسی", "proceedings"),
    (r"ختم[\s‌]+جلسه", "proceedings"),
    (r"نظریه[\s‌]+مشورتی", "opinion"),
    (r"نظریه[\s‌]+تفسیری", "opinion"),
    (r"در[\s‌]+خصوص[\s‌]+دعوی", "case_detail"),
    (r"در[\s‌]+خصوص[\s‌]+دادخواست", "case_detail"),
    (r"شرح[\s‌]+شکایت", "case_detail"),
    (r"شرح[\s‌]+دادخواست", "case_detail"),
    (r"دفاعیات", "defense"),
    (r"دفاعیات[\s‌]+خوانده", "defense"),
    (r"دفاعیات[\s‌]+وکیل", "defense"),
    (r"بسمه[\s‌]+تعالی", "header"),
    (r"بسم[\s‌]+الله[\s‌]+الرحمن[\s‌]+الرحیم", "header"),
    (r"ماده[\s‌]*\d+", "article"),
    (r"فصل[\s‌]*\d+", "chapter"),
    (r"بخش[\s‌]*\d+", "section"),
    (r"تبصره[\s‌]*\d+", "note"),
)
# fixed values: phrases before which a full chunk may end
BOUNDARY_HINTS = (r"مستنداً[\s‌]+به[\s‌]+مواد", r"لذا[\s‌]+دادگاه", r"دادگاه[\s‌]+با[\s‌]+توجه[\s‌]+به", r"محکوم[\s‌]+می‌نماید", r"حکم[\s‌]+به")
# fixed values: anchors of the simpler chunker, and the title of text before the first
SIMPLE_ANCHORS = (r"رأی دادگاه", r"رای دادگاه", r"در خصوص دعوی", r"گردشکار", r"ختم دادرسی", r"نظریه مشورتی", r"بسمه تعالی", r"ماده\s*\d+", r"فصل\s*\d+")
PREAMBLE = "مقدمه"
# fixed values: header fields of a case file
HEADER_FIELDS = (
    ("case_number", r"کلاسه\s*(?:پرونده)?\s*:?\s*(\d{10,16})"),
    ("date", r"تاریخ\s*:?\s*(\d{2,4}[/\-]\d{1,2}[/\-]\d{1,2})"),
    ("plaintiff", r"خواهان\s*:?\s*([^\n]{2,100})"),
    ("defendant", r"خوانده\s*:?\s*([^\n]{2,100})"),
    ("branch", r"شعبه\s*(\d+)"),
)
REFERENCE = r"(?U)ماده[\s‌]*(\d+(?:[\s‌]*و[\s‌]*\d+)*)"

# fixed values: words of a verdict
VERDICT_WORDS = (r"محکوم[\s‌]+می‌نماید", r"حکم[\s‌]+به", r"محکومیت")

#: A word or a mark; what stands between them is white space.
TOKEN = r"(?U)(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
MARKER = r"(?U)\[PAGE\s*(\d+)\]\s*\n?"
SENTENCE_END = r"(?U)((?<!\d)[.؟!](?!\d)|:\s|\n{2,})"
#: Noncharacters, which no text may hold, put in where a text is cut and where a hint begins.
CUT, HINT = "\uFDD0", "\uFDD1"
#: Sections of more characters than this are packed as rows over all tasks.
LONG = 1 << 20
#: Rows in a block of a running sum, and spans of the largest chunk in a block of a range search.
BLOCK, SPANS = 4096, 16


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks; pass another counter where thresholds refer to one."""
    return F.regexp_count(text, F.lit(TOKEN))


def without_page_markers(text: Column) -> Column:
    """The text without ``[PAGE N]`` markers; offsets of chunks refer to it."""
    return F.regexp_replace(text, MARKER, "")


def page_starts(text: Column) -> Column:
    """Where pages begin in :func:`without_page_markers`: an array of ``pos, page``."""
    numbers = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    lengths = F.transform(F.split(text, MARKER, -1), F.length)
    nothing = F.array().cast("array<int>")
    sums = F.aggregate(lengths, nothing, lambda done, n: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n))
    return F.zip_with(F.slice(sums, F.lit(1), F.size(numbers)), numbers, lambda at, page: F.struct(at.alias("pos"), page.cast("int").alias("page")))


def pages_between(starts: Column, start: Column, end: Column) -> Column:
    """The page in force at ``start`` (1 before any marker) and those that begin before ``end``."""
    before = F.filter(starts, lambda p: p["pos"] <= start)
    inside = F.filter(starts, lambda p: (p["pos"] > start) & (p["pos"] < end))
    current = F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(F.array(current), F.transform(inside, lambda p: p["page"]))))


def tolerant(pattern: str) -> str:
    """The pattern, so that it meets letters in all forms that anchors do not tell apart, and
    with marks between them. Patterns are made of letters, classes, groups and repetitions."""
    forms: dict[str, str] = {}
    for other, plain in zip(*ANCHOR_LETTERS):
        forms[plain] = forms.get(plain, plain) + other
    out, inside, i = [], False, 0
    while i < len(pattern):
        ch, step = pattern[i], 1
        if ch == "\\":
            atom, step = pattern[i : i + 2], 2
        elif inside:
            atom, inside = forms.get(ch, ch), ch != "]"
        else:
            atom, inside = (f"[{forms[ch]}]" if ch in forms else ch), ch == "["
        i += step
        letter = ch.isalpha() and not inside
        out.append(atom + (f"{DIACRITICS}*" if letter and pattern[i : i + 1] not in ("", "*", "+", "?", "{") else ""))
    return "".join(out)


def _marked(text: Column, patterns, put: str) -> Column:
    return F.regexp_replace(text, "(?U)(" + "|".join(patterns) + ")", put) if patterns else text


def _parts(text: Column, anchors) -> Column:
    """The text from anchor to anchor: an array of ``title, text``, each anchor in its text."""
    parts = F.split(_marked(text, [tolerant(p) for p in anchors], f"{CUT}$1{HINT}"), CUT, -1)
    one = lambda p: F.struct(
        F.when(F.contains(p, F.lit(HINT)), F.substring_index(p, HINT, 1)).otherwise("").alias("title"), F.replace(p, F.lit(HINT), F.lit("")).alias("text")
    )
    return F.transform(parts, one)


def sections(text: Column, anchors, smallest: int, largest: int, counter=count_tokens) -> Column:
    """From anchor to anchor: an array of ``title, start, text``.

    Text before the first is a section without a title, unless it is blank. A section of
    fewer than ``smallest`` tokens takes in what follows, up to ``largest``.
    """

    def joined(parts: Column) -> Column:
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        blank = (F.size(parts) > 1) & ~F.coalesce(first["text"].rlike(r"(?U)\S"), F.lit(False))
        begun = F.array(F.struct(second["title"].alias("title"), F.concat(first["text"], second["text"]).alias("text")))
        return F.when(blank, F.concat(begun, F.slice(parts, F.lit(3), F.size(parts)))).otherwise(parts)

    shape = "struct<done:array<struct<title:string,start:int,text:string>>,title:string,start:int,text:string>"
    nothing = F.struct(F.array().alias("done"), F.lit("").alias("title"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("text")).cast(shape)

    def section(state: Column) -> Column:
        return F.struct(state["title"].alias("title"), state["start"].alias("start"), state["text"].alias("text"))

    def step(state: Column, part: Column) -> Column:
        both = F.concat(state["text"], part["text"])
        takes_in = state["text"].isNotNull() & (counter(state["text"]) < smallest)
        takes_in = F.when(takes_in, counter(both) <= largest).otherwise(False)
        done = F.when(state["text"].isNull(), state["done"]).otherwise(F.array_append(state["done"], section(state)))
        after = state["start"] + F.coalesce(F.length(state["text"]), F.lit(0))
        new = F.struct(done.alias("done"), part["title"].alias("title"), after.alias("start"), part["text"].alias("text"))
        grown = F.struct(state["done"].alias("done"), state["title"].alias("title"), state["start"].alias("start"), both.alias("text"))
        return F.when(takes_in, grown).otherwise(new).cast(shape)

    return F.aggregate(let(_parts(text, anchors), joined), nothing, step, lambda state: F.array_append(state["done"], section(state)))


def pieces(text: Column, hints, largest: int, counter=count_tokens) -> Column:
    """Sentences, each with its closing mark, also cut before hints and after ``largest``
    tokens: an array of ``text, n`` (tokens) and ``hinted``; together they are the text."""
    cut = F.regexp_replace(_marked(text, hints, f"{CUT}{HINT}$1"), SENTENCE_END, f"$1{CUT}")

    def one(part: Column) -> Column:
        said, hinted = F.replace(part, F.lit(HINT), F.lit("")), F.startswith(part, F.lit(HINT))
        piece = lambda t, n, h: F.struct(t.alias("text"), n.cast("int").alias("n"), h.alias("hinted"))

        def cut_up(s: Column) -> Column:
            words = F.regexp_extract_all(s["t"], F.lit(rf"(?U)^\s*{TOKEN}\s*|{TOKEN}\s*"), F.lit(0))
            groups = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws), F.lit(largest)), lambda i: F.array_join(F.slice(ws, i, F.lit(largest)), ""))
            several = F.transform(let(words, groups), lambda t, i: piece(t, counter(t), s["h"] & (i == 0)))
            return F.when(s["n"] > largest, several).otherwise(F.array(piece(s["t"], s["n"], s["h"])))

        return let(F.struct(said.alias("t"), counter(said).alias("n"), hinted.alias("h")), cut_up)

    return F.flatten(F.transform(F.filter(F.split(cut, CUT, -1), lambda p: p != ""), one))


def packed(found: Column, smallest: int, largest: int, overlap: int) -> Column:
    """Pieces packed greedily: an array of ``first, last`` (from 1) and ``start`` (characters).

    A run ends before a piece that would pass ``largest`` tokens, and before a hinted one once
    it has ``smallest``. The next one begins with the last ``overlap`` pieces of one that was
    longer, or as many of them as leave room.
    """
    shape = "struct<done:array<struct<first:int,last:int,start:int>>,k:int,first:int,size:int,start:int,at:int>"

    def fold(ps: Column) -> Column:
        nothing = F.struct(F.array().alias("done"), F.lit(1).alias("k"), F.lit(1).alias("first"), *(F.lit(0).alias(c) for c in ("size", "start", "at"))).cast(shape)

        def chunk(s: Column) -> Column:
            return F.struct(s["first"].alias("first"), (s["k"] - 1).alias("last"), s["start"].alias("start"))

        def step(s: Column, p: Column) -> Column:
            k, n = s["k"], p["n"]
            full = (k > s["first"]) & ((s["size"] + n > largest) | (p["hinted"] & (s["size"] >= smallest)))
            # the most pieces that may be taken along, and what they hold
            back, held, width = F.lit(0), F.lit(0), F.lit(0)
            tokens = wide = F.lit(0)
            for b in range(1, overlap + 1):
                before = F.get(ps, k - 1 - b)
                tokens, wide = tokens + F.coalesce(before["n"], F.lit(0)), wide + F.coalesce(F.length(before["text"]), F.lit(0))
                fits = (k - s["first"] > overlap) & (tokens + n <= largest)
                back, held, width = (F.when(fits, x).otherwise(y) for x, y in ((F.lit(b), back), (tokens, held), (wide, width)))
            at = s["at"] + F.length(p["text"])
            new = [F.array_append(s["done"], chunk(s)), k + 1, k - back, held + n, s["at"] - width, at]
            old = [s["done"], k + 1, s["first"], s["size"] + n, s["start"], at]
            named = lambda xs: F.struct(*(x.alias(c) for x, c in zip(xs, ("done", "k", "first", "size", "start", "at"))))
            return F.when(full, named(new)).otherwise(named(old)).cast(shape)

        return F.aggregate(ps, nothing, step, lambda s: F.when(s["k"] > 1, F.array_append(s["done"], chunk(s))).otherwise(s["done"]))

    return let(found, fold)


def running_sums(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``<column>_sum``: sums over each key's rows up to each one's ``order``,
    numbers without gaps. Blocks are summed alone, then moved by the sums of earlier blocks."""
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    so_far = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, block).agg(*(F.sum(c).alias(c) for c in columns))
    blocks = blocks.select(*keys, "_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns))
    rows = rows.withColumn("_block", block).join(blocks, [*keys, "_block"])
    sums = {f"{c}_sum": F.sum(c).over(so_far) + F.col(f"_before_{c}") for c in columns}
    return rows.withColumns(sums).drop("_block", *(f"_before_{c}" for c in columns))


def packed_rows(found: DataFrame, keys: list[str], smallest: int, largest: int, overlap: int) -> DataFrame:
    """:func:`packed` over rows: ``keys, first, last`` of pieces in ``found`` (``keys, k`` from
    1, ``n, hinted, n_sum`` and ``before``, the tokens of the last ``overlap`` pieces, nearest
    first), however many of them a section has.

    For every piece with which a run may begin, with or without some taken along, the piece
    that ends the run comes from a range search over the running sums. Which of those runs are
    real is found by doubling: runs reached by 1, 2, 4, ... steps at a time.
    """
    total, room = F.lit(0), F.lit(0)
    for b in range(1, overlap + 1):
        total = total + F.coalesce(F.get("before", F.lit(b - 1)), F.lit(0))
        room = F.when((F.size("before") >= b) & (total + F.col("n") <= largest), b).otherwise(room)
    options = F.array(F.lit(0), room) if overlap else F.array(F.lit(0))
    begins = found.select("*", F.posexplode(options).alias("along", "back"))
    held = F.aggregate(F.slice("before", F.lit(1), F.col("back")), F.lit(0), lambda s, n: s + n)
    key = F.col("n_sum") - F.col("n") - held
    long = lambda c: F.lit(None).cast("long").alias(c)
    asked = begins.select(*keys, key.alias("key"), F.col("k").cast("long").alias("asks"), "along", "back", long("piece"), long("hint"))
    none = [long("asks"), F.lit(None).cast("int").alias("along"), F.lit(None).cast("int").alias("back")]
    ends = found.select(*keys, F.col("n_sum").alias("key"), *none, F.col("k").cast("long").alias("piece"), long("hint"))
    hinted = found.where("hinted").select(*keys, (F.col("n_sum") - F.col("n")).alias("key"), *none, long("piece"), F.col("k").cast("long").alias("hint"))
    width = SPANS * (largest + 1)
    own = F.floor(F.col("key") / width)
    near = F.when(F.pmod("key", F.lit(width)) <= largest, F.array(own, own - 1)).otherwise(F.array(own))
    rows = asked.withColumn("part", own).unionByName(ends.unionByName(hinted).withColumn("part", F.explode(near)))
    ahead = W.partitionBy(*keys, "part").orderBy("key")
    last = F.max("piece").over(ahead.rangeBetween(0, largest))
    stops = F.collect_list("hint").over(ahead.rangeBetween(smallest, largest))
    rows = rows.withColumn("last", last).withColumn("stops", stops).where(F.col("asks").isNotNull())
    stop = F.array_min(F.filter("stops", lambda k: k > F.col("asks")))
    ends_before = F.greatest(F.col("asks") + 1, F.least(F.col("last") + 1, F.coalesce(stop, F.col("last") + 1)))
    runs = rows.select(*keys, F.col("asks").alias("k"), "along", (F.col("asks") - F.col("back")).alias("first"), ends_before.alias("to"))
    runs = runs.withColumn("to_along", (F.col("to") - F.col("first") > overlap).cast("int") * (1 if overlap else 0))
    runs = stored(runs)
    reached = stored(runs.where("k = 1 AND along = 0").select(*keys, "k", "along"))
    jumps = runs.select(*keys, "k", "along", "to", "to_along")
    known = reached.count()
    while True:
        further = reached.join(jumps, [*keys, "k", "along"]).select(*keys, F.col("to").alias("k"), F.col("to_along").alias("along"))
        reached = stored(reached.unionByName(further).join(runs.select(*keys, "k", "along"), [*keys, "k", "along"], "left_semi").distinct())
        now = reached.count()
        if now == known:
            return runs.join(reached, [*keys, "k", "along"]).select(*keys, "first", (F.col("to") - 1).alias("last"))
        known = now
        second = jumps.select(*keys, F.col("k").alias("to"), F.col("along").alias("to_along"), F.col("to").alias("_k"), F.col("to_along").alias("_along"))
        jumps = stored(jumps.join(second, [*keys, "to", "to_along"]).select(*keys, "k", "along", F.col("_k").alias("to"), F.col("_along").alias("to_along")))


def _chunk_columns(rows: DataFrame, counter, kinds) -> DataFrame:
    """Chunks with their pages, counts and index from ``document_id, starts, title, start, content``."""
    end = F.col("start") + F.length("content")
    rows = rows.where(F.col("content").rlike(r"(?U)\S")).withColumn("end", end)
    rows = rows.withColumn("pages", pages_between(F.col("starts"), F.col("start"), F.col("end")))
    index = F.row_number().over(W.partitionBy("document_id").orderBy("section", "start", "end")) - 1
    return rows.select(
        "document_id", index.alias("chunk_index"), "content", "start", "end", "pages", F.length("content").alias("char_count"),
        counter(F.col("content")).cast("int").alias("token_count"), F.col("title").alias("section_title"),
        section_kind(F.col("title"), kinds).alias("section_type"),
    )


def structural_chunks(documents: DataFrame, smallest: int = 150, largest: int = 400, overlap: int = 1, kinds=SECTION_KINDS, hints=BOUNDARY_HINTS,
                      counter: Callable[[Column], Column] = count_tokens, verdict=VERDICT_WORDS, reference: str = REFERENCE, long: int = LONG, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Sections at anchors, packed into chunks of ``smallest`` to ``largest`` tokens.

    One row per chunk, with its :func:`chunk_metadata`; null or blank texts give none. A text is scanned, and the pieces of a
    section packed, within its row; sections of more than ``long`` characters have their
    pieces packed as rows, over all tasks.
    """
    if not 0 <= overlap or smallest > largest or smallest < 1:
        raise ValueError("overlap must not be negative, smallest positive and not above largest")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cut(docs: DataFrame) -> DataFrame:
        rows = docs.where(F.col(text_col).rlike(r"(?U)\S"))
        rows = rows.select(F.col(id_col).alias("document_id"), without_page_markers(text).alias("text"), page_starts(text).alias("starts"))
        found = sections(F.col("text"), [p for p, _ in kinds], smallest, largest, counter)
        rows = rows.select("document_id", "starts", F.posexplode(found).alias("section", "s"))
        rows = rows.select("document_id", "starts", "section", "s.title", F.col("s.start").alias("base"), F.col("s.text").alias("text"))
        return rows.withColumn("pieces", pieces(F.col("text"), hints, largest, counter))

    short = cut(documents).where(F.length("text") <= long)
    said = lambda c: F.array_join(F.transform(F.slice("pieces", c["first"], c["last"] - c["first"] + 1), lambda p: p["text"]), "")
    made = F.transform(packed(F.col("pieces"), smallest, largest, overlap), lambda c: F.struct(c["start"].alias("start"), said(c).alias("content")))
    short = short.select("document_id", "starts", "section", "title", "base", F.explode(made).alias("c"))
    out = short.select("document_id", "starts", "section", "title", (F.col("base") + F.col("c.start")).alias("start"), F.col("c.content").alias("content"))
    large = documents.where(F.length(text_col) > long)  # only these can have such a section
    if not large.isEmpty():
        out = out.unionByName(_long_sections(cut(large).where(F.length("text") > long), smallest, largest, overlap))
    known = chunk_metadata(F.col("content"), F.col("section_title"), F.col("pages"), kinds, verdict, reference)
    return _chunk_columns(out, counter, kinds).withColumn("metadata", known)


def _long_sections(cut: DataFrame, smallest: int, largest: int, overlap: int) -> DataFrame:
    keys = ["document_id", "section"]
    before = lambda k: F.transform(F.reverse(F.slice("pieces", F.greatest(F.lit(1), k + 1 - overlap), F.least(k, F.lit(overlap)))), lambda p: p["n"])
    listed = F.transform("pieces", lambda p, k: F.struct((k + 1).alias("k"), p["n"].alias("n"), p["hinted"].alias("hinted"), p["text"].alias("text"), before(k).alias("before")))
    cut = stored(cut)
    rows = cut.select(*keys, F.explode(listed).alias("p")).select(*keys, "p.*").withColumn("width", F.length("text"))
    rows = stored(running_sums(rows.repartition(*keys, F.floor(F.col("k") / BLOCK)), keys, "k", ["n", "width"]))
    chunks = packed_rows(rows.drop("text", "width", "width_sum"), keys, smallest, largest, overlap)
    held = chunks.withColumn("k", F.explode(F.sequence("first", "last"))).join(rows.select(*keys, "k", "text", "width", "width_sum"), [*keys, "k"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")  # a chunk's own pieces
    held = held.groupBy(*keys, "first").agg(texts.alias("content"), F.min(F.col("width_sum") - F.col("width")).cast("int").alias("at"))
    return held.join(cut.select(*keys, "starts", "title", "base"), keys).select(
        "document_id", "starts", "section", "title", (F.col("base") + F.col("at")).alias("start"), "content"
    )


def simple_chunks(documents: DataFrame, tokens: int = 400, overlap: int = 50, anchors=SIMPLE_ANCHORS, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """The fallback: sections after each anchor, cut into windows of tokens."""
    if not 0 <= overlap < tokens:
        raise ValueError("overlap must be below the window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("document_id"), without_page_markers(text).alias("text"), page_starts(text).alias("starts"))
    rows = rows.where(F.col("text").rlike(r"(?U)\S"))
    # an anchor's own text is in no window
    shape = "struct<done:array<struct<title:string,start:int,text:string>>,at:int>"

    def step(s: Column, p: Column) -> Column:
        skipped = F.length(p["title"])
        body = F.struct(F.when(s["at"].isNull(), PREAMBLE).otherwise(p["title"]).alias("title"), (F.coalesce(s["at"], F.lit(0)) + skipped).alias("start"), F.substr(p["text"], skipped + 1).alias("text"))
        return F.struct(F.array_append(s["done"], body).alias("done"), (F.coalesce(s["at"], F.lit(0)) + F.length(p["text"])).alias("at")).cast(shape)

    nothing = F.struct(F.array().alias("done"), F.lit(None).alias("at")).cast(shape)
    found = F.aggregate(_parts(F.col("text"), anchors), nothing, step, lambda s: s["done"])
    rows = rows.select("document_id", "starts", F.posexplode(found).alias("section", "s"))
    words = F.regexp_extract_all("s.text", F.lit(TOKEN + r"\s*"), F.lit(0))
    lead = F.length(F.regexp_extract("s.text", r"(?U)^\s*", 0))
    rows = rows.select("document_id", "starts", "section", "s.title", (F.col("s.start") + lead).alias("base"), words.alias("words")).where(F.size("words") > 0)
    step_size = tokens - overlap
    firsts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("words") - overlap) - 1, F.lit(step_size))
    rows = rows.withColumn("i", F.explode(firsts))
    content = F.regexp_replace(F.array_join(F.slice("words", F.col("i") + 1, F.lit(tokens)), ""), r"(?U)\s+\z", "")
    stride = F.length(F.array_join(F.slice("words", F.col("i") + 1, F.lit(step_size)), ""))
    before = W.partitionBy("document_id", "section").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(stride).over(before), F.lit(0))
    rows = rows.select("document_id", "starts", "section", "title", start.cast("int").alias("start"), content.alias("content"))
    return _chunk_columns(rows, count_tokens, ())


def token_windows(tokens: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of ``size`` tokens, each ``size - overlap`` after the one before, as arrays."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the window")

    def windows(ts: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(ts) - overlap - 1)
        starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
        return F.when(F.size(ts) > 0, F.transform(starts, lambda s: F.slice(ts, s + 1, size))).otherwise(
            F.array().cast("array<array<string>>")
        )

    return let(tokens, windows)


def section_kind(title: Column, kinds=SECTION_KINDS) -> Column:
    """The first kind whose anchor the title holds."""
    view, out = anchor_form(title), F.lit("text")
    for pattern, kind in reversed(kinds):
        out = F.when(view.rlike("(?U)" + pattern), kind).otherwise(out)
    return out


def chunk_metadata(content: Column, title: Column, pages: Column, kinds=SECTION_KINDS, verdict=VERDICT_WORDS, reference: str = REFERENCE) -> Column:
    """What is known about a chunk: its section, sentences, verdict, references and pages."""
    refs = article_references(content, reference)
    said = F.filter(F.split(content, r"(?<![0-9])[.؟!](?![0-9])|:\s|\n{2,}", -1), lambda x: x.rlike(r"(?U)\S"))
    return F.struct(
        section_kind(title, kinds).alias("section_type"),
        F.when(title != "", title).alias("anchor_text"),
        F.size(said).alias("sentence_count"),
        content.rlike("(?U)" + "|".join(verdict)).alias("has_verdict"),
        (F.size(refs) > 0).alias("has_legislation_ref"),
        refs.alias("legislation_refs"),
        F.array_min(pages).alias("start_page"),
        F.array_max(pages).alias("end_page"),
    )


def article_references(content: Column, pattern: str = REFERENCE) -> Column:
    """Distinct references to articles, in order."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))


def header_fields(text: Column, fields=HEADER_FIELDS) -> Column:
    """Map of the header fields; in each line the first matching field counts, the last line wins."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")

    def field(line: Column) -> Column:
        out = None
        for name, pattern in fields:
            value = F.trim(F.regexp_extract(line, "(?U)" + pattern, 1))
            pair = F.struct(F.lit(name).alias("k"), value.alias("v"))
            out = F.when(line.rlike("(?U)" + pattern), pair) if out is None else out.when(line.rlike("(?U)" + pattern), pair)
        return out

    found = F.filter(F.transform(lines, field), lambda p: p.isNotNull())
    empty = F.create_map().cast("map<string,string>")
    # later lines replace earlier ones
    return F.aggregate(found, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def without_header(text: Column, fields=HEADER_FIELDS) -> Column:
    """The text without the lines that hold a header field."""
    held = "(?U)" + "|".join(f"(?:{pattern})" for _, pattern in fields)
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda x: ~x.rlike(held)), "\n")


def section_spans(anchors: DataFrame, key: str = "document_id") -> DataFrame:
    """Anchors (``pos``) with the ``end`` of the section each starts: the next anchor, or the text's length."""
    nxt = F.lead("pos").over(W.partitionBy(key).orderBy("pos"))
    return anchors.withColumn("end", F.coalesce(nxt, F.col("length")))
