"""Registered queries of cases, chunk upkeep, status events and search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cases, jsontext, quality, tables, text
from .operators import chunking, models, relational
from .registry import query, table
from .sources import files, sinks


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in _LETTERS)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TEXT_SQL = "coalesce(text, '')"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: every whole text, empty for null."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def swapped(c: Column, pairs: dict[str, str]) -> Column:
    """Each key replaced by its value, one pair after the other."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs.items(), c)


def swapped_sql(c: str, pairs: dict[str, str]) -> str:
    return reduce(lambda c, pair: f"replace({c}, '{pair[0]}', '{pair[1]}')", pairs.items(), c)


# --- damaged texts and their repair ----------------------------------------------------
#
# The supplied texts are in Latin letters, so each query puts into them what its operator
# repairs, by letter or word; the SQL says what must come out.

_DIGITS_SEEN = "01234" + text.PERSIAN_DIGITS[5:] + text.ARABIC_DIGITS[:10] + "0"
_WORD_SQL = r"\p{L}\p{M}\p{N}_\x{200c}"
_JOINED = {" the ": " می ", " and ": " نمی ", " le ": " اش ", " of ": " به ", " und ": " علی ", " la ": " ام ", " der ": " ات "}
_GARBLED = {x: f" {word} " for x, word in zip(_LETTERS, text.LIGATURES)}
_REPAIRED = {x: f" {word} " for x, word in zip(_LETTERS, text.LIGATURES.values())}


def _half_spaces_sql(c: str) -> str:
    after = lambda c, w: rf"regexp_replace({c}, '(^|[^{_WORD_SQL}]){w}\s+([{_WORD_SQL}])', '\1{w}{text.ZWNJ}\2', 'g')"
    before = lambda c, w: rf"regexp_replace({c}, '([{_WORD_SQL}])\s+{w}([^{_WORD_SQL}]|$)', '\1{text.ZWNJ}{w}\2', 'g')"
    c = reduce(before, text.JOINED_BEFORE, reduce(after, text.JOINED_NEXT, c))
    return reduce(after, text.JOINED_NEXT_TOO, c)


def _dates_sql(c: str) -> str:
    one = lambda c, m: rf"regexp_replace({c}, '(\p{{Nd}}{{2,4}})\s*{m}\s*\n\s*(\p{{Nd}}{{1,2}})\s*{m}\s*(\p{{Nd}}{{1,2}})', '\1{m}\2{m}\3', 'g')"
    return one(one(c, "/"), "-")


_DATED = {". ": "-\n", " ": "/\n"}
_TIDIED = {"e": "    ", ".": "\n\n\n\n"}
_CONTROLS = "\u0001\u000b\u001f\u0085​‏⁠﻿￼­"
_MARKS = "ًٰؐۖ"
_MIXED = ("abcdefghij" + "mnopqrstuvwxyz" + "kl", text.ARABIC + _WIDE[12:] + "ـ​")

# name, step, what is done to a text first, SQL of what must come out
_STEPS = (
    ("nfkc", text.nfkc, lambda c: F.translate(c, _LETTERS, _WIDE), _TEXT_SQL),
    ("ligatures", text.fix_ligatures, lambda c: swapped(c, _GARBLED), swapped_sql(_TEXT_SQL, _REPAIRED)),
    ("tatweel", text.strip_tatweel, lambda c: F.translate(c, "eau", "ـــ"), f"translate({_TEXT_SQL}, 'eau', '')"),
    ("controls", text.strip_controls, lambda c: F.translate(c, _LETTERS[:10], _CONTROLS), f"translate({_TEXT_SQL}, '{_LETTERS[:10]}', '')"),
    ("persian", text.to_persian, lambda c: F.translate(c, _LETTERS[:14], text.ARABIC + _MARKS), f"translate({_TEXT_SQL}, '{_LETTERS[:14]}', '{text.PERSIAN}')"),
    ("half_spaces", text.fix_half_spaces, lambda c: swapped(c, _JOINED), _half_spaces_sql(swapped_sql(_TEXT_SQL, _JOINED))),
    ("dates", text.rejoin_dates, lambda c: swapped(F.translate(c, _LETTERS, _DIGITS_SEEN * 2), _DATED),
     _dates_sql(swapped_sql(f"translate({_TEXT_SQL}, '{_LETTERS}', '{(_DIGITS_SEEN * 2)[:26]}')", _DATED))),
    ("tidy", text.tidy, lambda c: F.concat(F.lit(" \n"), swapped(c, _TIDIED), F.lit("\n ")),
     rf"trim(regexp_replace(regexp_replace({swapped_sql(_TEXT_SQL, _TIDIED)}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), {_BLANKS})"),
    ("search", text.fts_normalize, lambda c: F.translate(c, _LETTERS[:15], text.ARABIC + "۳۷٤٩" + text.ZWNJ), f"translate({_TEXT_SQL}, '{_LETTERS[:15]}', '{text.PERSIAN}3749 ')"),
    ("whole", text.normalize, lambda c: F.translate(c, *_MIXED),
     rf"trim(regexp_replace(regexp_replace(translate({_TEXT_SQL}, '{_MIXED[0]}', '{text.PERSIAN}{_LETTERS[12:]}'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), {_BLANKS})"),
)


@query("SELECT doc_id, " + ", ".join(f"md5({sql}) AS {name}" for name, _, _, sql in _STEPS) + " FROM documents")
def normalisation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text after each step of the normalisation, and after all."""
    return texts(spark, sf_dir).select("doc_id", *(F.md5(step(damage(F.col("text")))).alias(name) for name, step, damage, _ in _STEPS))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_TEXT_SQL}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), {_BLANKS})) AS digest,
  md5({_TEXT_SQL}) AS fts_digest FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps on the texts as they are: Latin letters stay, blanks and line breaks are tidied."""
    return texts(spark, sf_dir).select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"), F.md5(text.fts_normalize(F.col("text"))).alias("fts_digest"))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(translate({_TEXT_SQL}, 'aeioustn', 'یکااا'), '\s+', ' ', 'g'), ' ')) AS form FROM documents""")
def anchor_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that anchors do not tell apart, marks and wide blanks, put into every text."""
    said = F.replace(F.translate("text", "aeioustn", text.ANCHOR_LETTERS[0] + _MARKS[:3]), F.lit(" "), F.lit(" \t "))
    return texts(spark, sf_dir).select("doc_id", F.md5(text.anchor_form(said)).alias("form"))


_BRACKETED = ("aotrnhEI", "بتسلمن()")
_SIDES = {"i": ")", "d": "("}
_B = text.BRACKETED


@query(rf"""WITH d AS (SELECT doc_id, {swapped_sql(f"translate({_TEXT_SQL}, '{_BRACKETED[0]}', '{_BRACKETED[1]}')", _SIDES)} AS t FROM documents),
closed AS (SELECT doc_id, regexp_replace(t, '(^|[^{_B}])(\s*)\)\s*([{_B}]+)', '\1\3)', 'g') AS t FROM d),
moved AS (SELECT doc_id, regexp_replace(t, '([{_B}]+)\s*\((\s*)($|[^{_B}])', '(\1\3', 'g') AS t FROM closed),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM moved),
counted AS (SELECT *, length(line) - length(replace(line, '(', '')) AS o, length(line) - length(replace(line, ')', '')) AS c FROM lines),
fixed AS (SELECT doc_id, n, CASE
  WHEN c - o >= 3 THEN regexp_extract(line, '^(?:[^)]*\)){{' || least(o, 900) || '}}') || replace(substring(line, 1 + length(regexp_extract(line, '^(?:[^)]*\)){{' || least(o, 900) || '}}'))), ')', '')
  WHEN o - c >= 3 THEN replace(substring(line, 1, length(line) - length(regexp_extract(line, '(?:\([^(]*){{' || least(c, 900) || '}}$'))), '(', '') || regexp_extract(line, '(?:\([^(]*){{' || least(c, 900) || '}}$')
  ELSE line END AS line FROM counted)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS fixed FROM fixed GROUP BY doc_id""")
def bracket_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets and Persian letters put into every text; sides and counts are mended."""
    said = swapped(F.translate("text", *_BRACKETED), _SIDES)
    return texts(spark, sf_dir).select("doc_id", F.md5(text.fix_brackets(said)).alias("fixed"))


_TITLES = {"The ": "رأي  دادگاه ", "Is ": "صورت جلسه ", "La ": "گردشكار ", "Der ": "نظريه مشورتي ", "Les ": "قرار دادگاه "}


@query("""WITH t AS (SELECT doc_id, substring(coalesce(text, ''), 1, 200) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'The ') OR contains(t, 'Les ') THEN 'verdict' WHEN contains(t, 'La ') THEN 'proceedings'
  WHEN contains(t, 'Is ') THEN 'minutes' WHEN contains(t, 'Der ') THEN 'opinion' ELSE 'text' END AS kind FROM t""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a section by its title, here the head of each text with anchors in place of articles."""
    return texts(spark, sf_dir).select("doc_id", chunking.section_kind(swapped(F.substring("text", 1, 200), _TITLES)).alias("kind"))


_BAR = " | "
_CAPTIONS = cases.FACT_CAPTIONS


@query(f"""SELECT c_custkey AS case_id,
  CASE c_custkey % 3 WHEN 0 THEN 'پرونده {cases.CASE_NAMES['civil']}' WHEN 1 THEN 'پرونده {cases.CASE_NAMES['labour']}' ELSE 'پرونده unknown' END
  || '{_BAR}{_CAPTIONS['parties']}: buyer: ' || c_name || ' و seller: n' || c_nationkey
  || '{_BAR}{_CAPTIONS['claims']}: ' || c_mktsegment
  || CASE WHEN c_custkey % 2 = 0 THEN '{_BAR}{_CAPTIONS['amount']}: ' || format('{{:,}}', 1000 * c_custkey) || ' {cases.CURRENCY}' ELSE '{_BAR}{_CAPTIONS['amount']}: much' END
  || '{_BAR}court: c' || c_nationkey AS description FROM customer""")
def case_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    parties = F.to_json(F.struct(F.col("c_name").alias("buyer"), F.concat(F.lit("n"), nation).alias("seller")))
    amount = F.when(key % 2 == 0, (1000 * key).cast("string")).otherwise("much")
    facts = F.create_map(
        F.lit("parties"), parties, F.lit("claims"), F.col("c_mktsegment"), F.lit("amount"), amount, F.lit("timeline"), F.lit(""), F.lit("court"), F.concat(F.lit("c"), nation),
    )
    kind = F.element_at(F.array(*map(F.lit, ("civil", "labour", "unknown"))), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("case_id"), cases.case_description(kind, facts).alias("description"))


_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, lang, source, {_SPLIT} AS w FROM documents)
SELECT doc_id, concat_ws(' ', 'base', nullif(array_to_string(list_slice(w, 1, 20), ' '), ''), nullif(array_to_string(list_slice(w, 1, 15), ' '), ''),
  CASE WHEN lang IN ('en', 'de') THEN lang END) AS words FROM w""")
def case_search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, roles = F.coalesce("text", F.lit("")), F.array("lang", "source")
    return table(spark, sf_dir, "documents").select("doc_id", cases.case_keywords(F.lit("base"), c, c, roles, ("en", "de")).alias("words"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS case_type,
  least(1.0, CASE WHEN event_id % 3 = 1 THEN 0 ELSE (event_id % 15) / 10.0 END)::DOUBLE AS completeness,
  CASE WHEN event_id % 5 = 0 THEN true ELSE least(1.0, CASE WHEN event_id % 3 = 1 THEN 0 ELSE (event_id % 15) / 10.0 END) >= 0.7 END AS ready,
  CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_missing FROM events""")
def fact_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the wrong type count as missing; the score decides where no truth value is given."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    score = F.when(n % 3 == 1, F.lit('"high"')).otherwise(((n % 15) / 10).cast("string"))
    ready = F.when(n % 5 == 0, F.lit("true")).otherwise(F.lit('"soon"'))
    missing = F.when(n % 2 == 0, F.lit('["date", "sum"]')).otherwise(F.lit('"none"'))
    said = F.concat(
        F.lit('```json\n{"case_type": '), kind, F.lit(', "completeness_score": '), score, F.lit(', "is_ready": '), ready,
        F.lit(', "missing_facts": '), missing, F.lit(', "facts": {"a": 1}}\n```'),
    )
    rows = table(spark, sf_dir, "events").select(n, cases.facts_of(said).alias("f"))
    return rows.select("event_id", "f.case_type", "f.completeness", "f.ready", F.size("f.missing").alias("n_missing"))


@query("""SELECT conv_id, turn, hub_type, CASE hub_type WHEN 'a' THEN coalesce(text, '') ELSE '' END AS fts_query,
  CASE hub_type WHEN 'a' THEN 'v' ELSE role END AS vector_query, '' AS reasoning
FROM conversations, (VALUES ('a'), ('b')) h(hub_type)""")
def routing_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routing result from its stored JSON; what is no object goes, missing texts are empty."""
    a = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("fts_query"), F.lit("v").alias("vector_query")))
    b = F.to_json(F.struct(F.col("role").alias("vector_query")))
    kept = F.concat(F.lit('{"sub_queries": {"a": '), a, F.lit(', "b": '), b, F.lit(', "c": "no object"}, "other": 1}'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cases.routed(kept).alias("r"))
    return rows.select("conv_id", "turn", F.explode("r.sub_queries").alias("hub_type", "q"), "r.reasoning").select(
        "conv_id", "turn", "hub_type", "q.fts_query", "q.vector_query", "reasoning"
    )


@query("""SELECT doc_id, '# ' || source || chr(10) || chr(10) || '## Language' || chr(10) || lang
  || CASE WHEN n_chars % 2 = 0 THEN chr(10) || chr(10) || '## Facts' || chr(10) || '- ' || lang || chr(10) || '- ' || n_chars ELSE '' END AS report FROM documents""")
def fallback_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.when(F.col("n_chars") % 2 == 0, F.array("lang", F.col("n_chars").cast("string")))
    sections = {"Language": F.col("lang"), "Empty": F.lit(""), "Facts": models.bullets(facts)}
    return table(spark, sf_dir, "documents").select("doc_id", models.fallback_report(F.col("source"), sections).alias("report"))


# --- upkeep ----------------------------------------------------------------------------


@query("""SELECT o_orderkey AS task_id, CASE
  WHEN f.k IS NOT NULL THEN 'failed' ELSE o_orderstatus END AS status, f.message AS error, CAST(coalesce(f.at, 0) AS BIGINT) AS completed_at
FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS at, 'line ' || max(l_linenumber) AS message FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY l_orderkey) f ON o_orderkey = f.k""")
def failed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with failures become failed, with the latest message."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    line = F.col("l_linenumber").cast("long")
    failures = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("task_id"), line.alias("at"), F.concat(F.lit("line "), line.cast("string")).alias("message")
    )
    return relational.with_failures(tasks, failures, "task_id").fillna(0, ["completed_at"])


@query("""SELECT event_id, '[' || user_id || '] ' || event_type || CASE
  WHEN event_id % 2 = 0 THEN ' — id=' || event_id || ' kind=' || event_type ELSE '' END AS line FROM events""")
def milestone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type")))
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", relational.milestone_line(F.col("user_id"), F.col("event_type"), extra).alias("line"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 THEN length(text) END::BIGINT AS first,
  CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 THEN length(text) - length(replace(text, 'e', '')) END::BIGINT AS second
  FROM documents""")
def re_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors anew, by an embedder that counts letters."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.array(F.lit(0.0)).alias("embedding"))
    made = models.re_embedded(held, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return made.select("chunk_id", F.get("embedding", 0).cast("long").alias("first"), F.get("embedding", 1).cast("long").alias("second"))


@query("""SELECT count(*) FILTER (WHERE doc_id % 3 = 0
  AND length(trim(coalesce(text, ''))) > 0) AS processed, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) = 0) AS skipped,
  count(*) FILTER (WHERE doc_id % 3 <> 0 AND length(trim(coalesce(text, ''))) > 0) AS failed FROM documents""")
def embed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("text", F.lit(""))
    vector = F.when((F.col("doc_id") % 3 == 0) & c.rlike(r"\S"), F.array(F.lit(1.0)))
    return models.embed_summary(table(spark, sf_dir, "documents").select(c.alias("content"), vector.alias("embedding")))


@query("""SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || 'table ' || page_id || chr(10) || chr(10) || 'more' ELSE '' END AS said FROM pages""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.struct(c.alias("semantic_text"))
    listed = F.array(one(F.concat(F.lit("table "), F.col("page_id").cast("string"))), one(F.lit("")), one(F.lit(None).cast("string")), one(F.lit("more")))
    given = F.when(F.col("page_id") % 2 == 0, listed).otherwise(F.slice(listed, 2, 2))
    return table(spark, sf_dir, "pages").select("page_id", relational.embedding_input(F.col("url"), given).alias("said"))


@query("""SELECT p_partkey AS chunk_id, p_name || ' 12 یک' AS search_text FROM part""")
def search_text_at_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that keyword search reads is worked out when chunks are written."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat("p_name", F.lit(" ۱٢ يك")).alias("content"))
    return sinks.with_search_text(rows).select("chunk_id", "search_text")


@query("""SELECT doc_id AS chunk_id, 0 AS chunk_index, 1 AS page_start, 2 AS page_end, lang AS content, n_chars / 2.0::DOUBLE AS relevance_score,
  n_chars AS token_count,
  source || ' | ' || lang AS legal_context FROM documents""")
def search_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.create_map(F.lit("law_name"), F.col("source"), F.lit("fasl"), F.col("lang"), F.lit("other"), F.lit("x"))
    found = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.col("lang").alias("content"),
        (F.col("n_chars") / 2).alias("relevance_score"), F.col("n_chars").alias("token_count"), metadata.alias("metadata"), F.lit("gone").alias("other"),
    )
    return relational.search_results(found).drop("metadata")


_HEADED = {". ": "\nCase: "}


@query(rf"""WITH l AS (SELECT doc_id, string_split({swapped_sql(_TEXT_SQL, _HEADED)}, chr(10)) AS l FROM documents),
k AS (SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(x, 'Case:\s*[\p{{L}}\p{{N}}_]')) AS k FROM l)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, 'Case:\s*[\p{{L}}\p{{N}}_]')), chr(10))) AS body,
  regexp_extract(k[-1], 'Case:\s*([\p{{L}}\p{{N}}_]+)', 1) AS case_number FROM k""")
def header_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a header field, here all sentences but the first of each line, leave the text; the last field is kept."""
    said, fields = swapped(F.col("text"), _HEADED), (("case_number", r"Case:\s*(\w+)"),)
    return texts(spark, sf_dir).select(
        "doc_id", F.md5(chunking.without_header(said, fields)).alias("body"), F.element_at(chunking.header_fields(said, fields), F.lit("case_number")).alias("case_number")
    )


# an answer around the letters of a text, and the strategy and the object that come of it
_ANSWERS = (
    ('{"a": "V"}', "strict", '{"a": "V"}'), ('```json\n{"a": "V"}\n```', "fenced", '{"a": "V"}'), ('so {"a": "V"} it is', "braces", '{"a": "V"}'),
    ('{"a": ["V", 2,],}', "commas", '{"a": ["V", 2]}'), ("{'a': 'V', 'b': ['x']}", "quotes", '{"a": "V", "b": ["x"]}'),
    ('{"a": "V', "closed", '{"a": "V"}'), ('bad "a": ["V", "y", broken', "fields", '{"a": ["V", "y"]}'), ("V", "none", "{}"),
)
_TURN_SQL = lambda at: " ".join(f"WHEN {i} THEN {at(row)}" for i, row in enumerate(_ANSWERS))


@query(f"""SELECT doc_id, CASE doc_id % 8 {_TURN_SQL(lambda r: f"'{r[1]}'")} END AS strategy,
  md5(replace(CASE doc_id % 8 {_TURN_SQL(lambda r: f"'{r[2]}'")} END, 'V', regexp_replace({_TEXT_SQL}, '[^a-z]', '', 'g'))) AS body FROM documents""")
def json_salvage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold each text's letters, broken in a way that each strategy mends."""
    answer = F.element_at(F.array(*(F.lit(a) for a, _, _ in _ANSWERS)), (F.col("doc_id") % 8 + 1).cast("int"))
    said = F.replace(answer, F.lit("V"), F.regexp_replace("text", "[^a-z]", ""))
    rows = texts(spark, sf_dir).select("doc_id", jsontext.salvaged(said, ("a",)).alias("found"))
    return rows.select("doc_id", "found.strategy", F.md5("found.json").alias("body"))


@query("""SELECT event_id, 'closed' AS strategy, left(props, length(props) - 1) || ', "s": "open"}' AS json FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut off within a text."""
    cut = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "s": "open'))
    rows = table(spark, sf_dir, "events").select("event_id", jsontext.salvaged(cut, ("k",)).alias("found"))
    return rows.select("event_id", "found.strategy", "found.json")


_PAGED = {"th": "ماده 3 ", "que": "ماده 7 ", "und": "ماده ۹", ". ": "\nsame\n"}


# the check of pages d(doc_id, t): t is stripped
_CHECKED_SQL = rf"""n AS (SELECT doc_id, t, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n, CAST(regexp_extract_all(translate(t, '{text.PERSIAN_DIGITS}', '0123456789'), 'ماده\s*([0-9]+)', 1) AS BIGINT[]) AS a,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS l FROM d),
s AS (SELECT doc_id, t, n, l, list_transform(list_zip(a[2:], a[:-2]), lambda z: z[1] - z[2]) AS s FROM n),
f AS (SELECT doc_id, t, list_concat(CASE WHEN n > 0 AND n / length(t) < 0.1 THEN ['low_letter_ratio'] ELSE [] END,
  list_transform(list_filter(s, lambda x: x > 2 OR x < 0), lambda x: CASE WHEN x > 2 THEN 'article_gap' ELSE 'non_ascending_articles' END),
  CASE WHEN regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '[۰-۹]') AND n / length(t) > 0.2 THEN ['digit_conversion'] ELSE [] END,
  CASE WHEN len(l) >= 4 AND list_max(map_values(list_histogram(l))) >= 3 THEN ['repeated_content'] ELSE [] END) AS f FROM s)
SELECT doc_id, length(t) >= 10 AND len(f) = 0 AS verified, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) < 10 THEN 0.1 ELSE round(greatest(0.1, 1 - 0.15 * len(f)), 6) END::DOUBLE AS confidence,
  CASE WHEN length(t) = 0 THEN 'empty_output' WHEN length(t) < 10 THEN 'too_short' ELSE array_to_string(f, ',') END AS flags FROM f"""


def _verified(rows: DataFrame, said: Column) -> DataFrame:
    found = rows.select("doc_id", quality.verify_extraction(said, "a-z").alias("found"))
    return found.select("doc_id", "found.verified", F.round("found.confidence", 6).alias("confidence"), F.array_join("found.flags", ",").alias("flags"))


@query(f"WITH d AS (SELECT doc_id, trim({_TEXT_SQL}, {_BLANKS}) AS t FROM documents), {_CHECKED_SQL}")
def extraction_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and confidence of the texts as they are."""
    return _verified(texts(spark, sf_dir), F.col("text"))


@query(rf"""WITH d AS (SELECT doc_id, trim(CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN substring({_TEXT_SQL}, 1, 5) WHEN 2 THEN repeat('12345 ', 400) || {_TEXT_SQL}
    WHEN 3 THEN {_TEXT_SQL} ELSE {swapped_sql(_TEXT_SQL, _PAGED)} END, {_BLANKS}) AS t FROM documents), {_CHECKED_SQL}""")
def extraction_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with articles, digits and lines put into them; each flag of the check is met."""
    turn = F.col("doc_id") % 10
    said = F.when(turn == 0, "").when(turn == 1, F.substring("text", 1, 5)).when(turn == 2, F.concat(F.repeat(F.lit("12345 "), 400), "text"))
    said = said.when(turn == 3, F.col("text")).otherwise(swapped(F.col("text"), _PAGED))
    return _verified(texts(spark, sf_dir), said)


_LISTED = {"<ul>": "<table><tr><th>name</th><th>n</th></tr>", "</ul>": "</table>", "<li>": "<tr><td>", "</li>": "</td><td> 1 </td></tr>"}


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li>(?:<a[^>]*>)?([^<]*)', 1) AS l FROM pages),
w AS (SELECT page_id, l, greatest(4, list_max(list_transform(l, lambda x: length(x))))::INT AS w FROM l WHERE len(l) > 0)
SELECT page_id, 0 AS n, '| ' || rpad('name', w, ' ') || ' | n   |' || chr(10) || '| ' || repeat('-', w) || ' | --- |' || chr(10)
  || array_to_string(list_transform(l, lambda x: '| ' || rpad(x, w, ' ') || ' | 1   |'), chr(10)) AS markdown FROM w""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages; the supplied ones hold lists only, which are made tables of two columns."""
    found = files.html_tables(table(spark, sf_dir, "pages").withColumn("html", swapped(F.col("html"), _LISTED)))
    return found.select("page_id", "n", tables.table_markdown(F.col("table")).alias("markdown"))
