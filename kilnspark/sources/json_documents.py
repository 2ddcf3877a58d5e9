"""Bulk JSON import: an object with chunks, or an array of chunks, one hub per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import approval_date

# fixed values: folder names of the hubs, and other names of them
FOLDER_HUBS = {
    "هاب قوانین مصوب": "legislation",
    "هاب رویه های قضایی": "judicial_precedent",
    "هاب نظریات مشورتی و رویه عملی": "advisory_opinion",
}
HUB_ALIASES = {
    "precedent": "judicial_precedent",
    "judicial_precedent": "judicial_precedent",
    "legislation": "legislation",
    "advisory_opinion": "advisory_opinion",
    "advisory": "advisory_opinion",
}
# fixed values: title words of each hub; ties go to the hub listed first
HUB_WORDS = {
    "legislation": ("قانون", "ماده", "اصلاحیه", "آیین نامه", "مصوب"),
    "judicial_precedent": ("رأی", "دادنامه", "حکم", "رای", "قضایی"),
    "advisory_opinion": ("نظریه", "استعلام", "نظر", "مشورتی"),
}
UNKNOWN_TITLE = "Unknown Document"


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(pairs, c)


def hub_alias(c: Column, aliases: dict[str, str] = HUB_ALIASES) -> Column:
    """The hub a name stands for; null for a name that is none."""
    return _mapped(c, aliases)


def hub_of_path(path: Column, folders: dict[str, str] = FOLDER_HUBS) -> Column:
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    return _mapped(F.element_at(parts, -2), folders)


def hub_by_words(title: Column, hub_words: dict[str, tuple[str, ...]] = HUB_WORDS) -> Column:
    """The hub most of whose words the title holds, the first of equals; null without any."""
    low = F.lower(F.coalesce(title, F.lit("")))
    scores = {}
    for hub, found in hub_words.items():
        scores[hub] = sum((low.contains(w).cast("int") for w in found[1:]), low.contains(found[0]).cast("int"))
    best = F.greatest(*scores.values())
    pick = F.when(best == 0, F.lit(None).cast("string"))
    for hub, score in scores.items():
        pick = pick.when(score == best, hub)
    return pick


def inferred_hub(path: Column, metadata_hub: Column, title: Column) -> Column:
    return F.coalesce(hub_of_path(path), hub_alias(metadata_hub), hub_by_words(title))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: one row a JSON file, parsed as a Variant (null if it is no JSON)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))


def file_format(value: Column) -> Column:
    """``object`` (chunks under a key), ``array``, or null for neither."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT") & F.try_variant_get(value, "$.chunks", "array<variant>").isNotNull(), "object").when(kind.startswith("ARRAY"), "array")


def read_chunks(files: DataFrame, folders: dict[str, str] = FOLDER_HUBS) -> DataFrame:
    """Chunks of all files: ``path, document_title, chunk_id, idx, text, hub_type`` and metadata.

    Titles are looked for at the top level and in ``metadata``; the order in the file is kept
    as ``position``.
    """
    listed = F.coalesce(F.try_variant_get("value", "$.chunks", "array<variant>"), F.try_variant_get("value", "$", "array<variant>"))
    rows = files.select("path", "value", file_format(F.col("value")).alias("format"), F.posexplode(listed).alias("position", "chunk"))
    get = lambda *paths: F.coalesce(*(F.nullif(F.try_variant_get("chunk", p, "string"), F.lit("")) for p in paths))
    number = lambda *paths: F.coalesce(*(F.try_variant_get("chunk", p, "long") for p in paths))
    title = F.coalesce(
        F.try_variant_get("value", "$.source_file", "string"),
        get("$.full_title", "$.metadata.full_title"),
        get("$.parent_title", "$.metadata.parent_title"),
        F.lit(UNKNOWN_TITLE),
    )
    judgment = get("$.judgment_number", "$.metadata.judgment_number")
    key = F.coalesce(get("$.chunk_id", "$.metadata.chunk_id"), F.when(judgment.isNotNull(), F.concat_ws("_", judgment, get("$.chunk_type"))))
    return rows.select(
        "path", "format", "position",
        title.alias("document_title"),
        key.alias("chunk_id"),
        F.coalesce(number("$.metadata.chunk_index", "$.chunk_index"), number("$.madde_number", "$.metadata.madde_number"), F.lit(0)).alias("idx"),
        get("$.text").alias("text"),
        F.coalesce(hub_of_path(F.col("path"), folders), hub_alias(get("$.metadata.hub_type", "$.hub_type"))).alias("hub_type"),
        get("$.metadata.law_name", "$.metadata.source", "$.full_title").alias("law_name"),
        get("$.metadata.legal_status", "$.metadata.status").alias("legal_status"),
        approval_date(get("$.metadata.approval_date")).alias("approval_date"),
        F.coalesce(get("$.metadata.legal_type"), F.lit("article")).alias("legal_type"),
    )


def read_laws(files: DataFrame) -> DataFrame:
    """Whole laws (``documents`` of raw text): ``path, title, content, hub_type`` and metadata, to be chunked."""
    rows = files.select("path", "value", F.explode(F.try_variant_get("value", "$.documents", "array<variant>")).alias("d"))
    get = lambda p: F.try_variant_get("d", p, "string")
    return rows.select(
        "path", get("$.title").alias("title"), get("$.content").alias("content"),
        hub_alias(F.try_variant_get("value", "$.hub_type", "string")).alias("hub_type"),
        *(get(f"$.metadata.{k}").alias(k) for k in ("law_name", "legal_status", "legal_type")),
        approval_date(get("$.metadata.approval_date")).alias("approval_date"),
    )


def audit_hubs(documents: DataFrame) -> DataFrame:
    """Adds ``expected_hub`` and ``matches``; nothing expected counts as a match."""
    expected = inferred_hub(F.col("path"), F.col("metadata_hub"), F.col("title"))
    rows = documents.withColumn("expected_hub", expected)
    return rows.withColumn("matches", F.col("expected_hub").isNull() | F.col("expected_hub").eqNullSafe(F.col("hub_type")))


def fix_hubs(chunks: DataFrame, audit: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks with the expected hub where the audit found another."""
    wrong = audit.where(~F.col("matches")).select(key, F.col("expected_hub").alias("_hub"))
    return chunks.join(wrong, key, "left").withColumn("hub_type", F.coalesce("_hub", "hub_type")).drop("_hub")
