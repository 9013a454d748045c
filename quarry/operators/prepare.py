"""From source documents to chunks: provenance rules, cleaning, windows, hashes, and repeats within a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import is_iso
from ..functions.text import chunk_id, clean, unit
from ..sources.writers import corpus_digest
from .chunking import character_windows, distinct_windows, explode_windows, paragraph_windows
from .shared import let, sent, settle

# What a source must have, what its status may be, and how its id and locator must look.
REQUIRED = ("source_id", "source_title", "source_url", "retrieved_at", "text")
STATUSES = ("pending", "reviewed", "fictional", "source_verified")
ID, LOCATOR = "^[a-zA-Z0-9_-]{1,100}\\z", "^(https?://|urn:local:sha256:)"


def field(docs: DataFrame, name: str) -> Column:
    return F.col(name) if name in docs.columns else F.lit(None).cast("string")


def violations(docs: DataFrame, needs_text: bool = True) -> DataFrame:
    """docs with the column broken: the names of the rules that a row breaks.

    needs_text: off, a document may be without text (null or blank; it gives no chunks), and every other rule holds.
    Ids are counted on their own; the few that stand twice are joined back, so texts are not shuffled.
    """
    col = lambda name: field(docs, name)
    status = F.coalesce(col("review_status"), F.lit("pending"))
    official = (F.coalesce(col("source_kind"), F.lit("")) == "official_legal_text") & (F.coalesce(col("document_version"), F.lit("")) == "original_oj") & (F.coalesce(col("celex"), F.lit("")) != "")
    rules = {
        "required": ~F.expr(" AND ".join(f"coalesce(regexp_replace({c}, '(?U)\\\\s+', ''), '') != ''" for c in REQUIRED if needs_text or c != "text")),
        "source_id": ~F.coalesce(col("source_id"), F.lit("")).rlike(ID),
        "source_url": ~F.coalesce(col("source_url"), F.lit("")).rlike(LOCATOR),
        "retrieved_at": ~is_iso(col("retrieved_at")),
        "review_status": ~status.isin(*STATUSES),
        "provenance": (status == "source_verified") & ~official,
        "duplicate": F.col("__twice").isNotNull(),
    }
    twice = settle(docs.groupBy("source_id").agg(F.count("*").alias("__twice")).where("__twice > 1"))
    return docs.join(sent(twice), "source_id", "left").withColumn("broken", F.filter(F.array(*[F.when(test, name) for name, test in rules.items()]), lambda x: x.isNotNull())).select(*docs.columns, "broken")


def require_valid(docs: DataFrame, needs_text: bool = True) -> DataFrame:
    """docs; a row that breaks a rule fails the whole job. needs_text: as in violations()."""
    told = F.concat(F.lit("source "), F.coalesce("source_id", F.lit("null")), F.lit(" breaks: "), F.array_join("broken", ", "))
    checked = violations(docs, needs_text).withColumn("broken", F.when(F.size("broken") > 0, F.raise_error(told)).otherwise(F.lit(True)))
    return checked.where("broken").drop("broken")


def chunks(docs: DataFrame, chunker: str = "characters", ascii_only: bool = False) -> DataFrame:
    """Cleaned, windowed and hashed chunks; a text repeated within its source stays once, but for private books."""
    if chunker not in ("characters", "paragraphs"):
        raise ValueError(f"unknown chunker {chunker}")
    cleaned = docs.withColumn("text", clean(F.col("text"), ascii_only))
    cut = character_windows if chunker == "characters" else paragraph_windows
    private = F.coalesce(field(docs, "source_kind"), F.lit("")) == "private_book"
    hashed = lambda rows: rows.withColumn("content_sha256", F.sha2("text", 256)).withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("char_start"), F.col("text")))
    twice = settle(docs.groupBy(F.col("source_id").alias("__s")).agg(F.count("*").alias("n")).where("n > 1").select("__s"))
    shared, same = not twice.isEmpty(), F.col("source_id").eqNullSafe(F.col("__s"))
    # a source that is one row repeats its texts within that row, so none of its windows is moved to see that
    once = cleaned.join(sent(twice), same, "left_anti") if shared else cleaned
    out = hashed(explode_windows(once, let(cut(F.col("text")), lambda w: F.when(private, w).otherwise(distinct_windows(w)))))
    if not shared:
        return out
    again = hashed(explode_windows(cleaned.join(sent(twice), same, "left_semi"), cut(F.col("text"))))
    nth = F.row_number().over(W.partitionBy("source_id", "content_sha256").orderBy("char_start"))
    return out.unionByName(again.withColumn("nth", nth).where((F.col("nth") == 1) | private).drop("nth"))


def prepare(docs: DataFrame, chunker: str = "characters", needs_text: bool = True) -> DataFrame:
    return chunks(require_valid(docs, needs_text), chunker)


def coverage(chunk_rows: DataFrame) -> DataFrame:
    """One row: sources, chunks, and the sorted instruments and versions."""
    names = lambda c: F.array_sort(F.collect_set(field(chunk_rows, c)))
    return chunk_rows.agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("chunks"), names("instrument_id").alias("instruments"), names("document_version").alias("document_versions"))




# The fields of a chunk; all but the last ones must be there, and there are no others.
CHUNK_FIELDS = ("chunk_id", "source_id", "source_title", "source_url", "retrieved_at", "text", "content_sha256", "char_start", "review_status")
CHUNK_EXTRA = ("schema_version", "section", "page", "language", "jurisdiction", "source_kind", "source_sha256", "instrument_id", "celex", "publication_date", "document_version", "version_notice")


def chunk_violations(rows: DataFrame, most: int = 1200, needs_text: bool = True) -> DataFrame:
    """Chunks with the column broken: what keeps a row from being a chunk of the closed schema. needs_text: off, a
    chunk's text may be null or blank, but the column must be there."""
    strange = sorted(set(rows.columns) - {*CHUNK_FIELDS, *CHUNK_EXTRA})
    absent = [c for c in CHUNK_FIELDS if c not in rows.columns]
    col = lambda c: field(rows, c)
    blank = lambda c: F.coalesce(F.regexp_replace(col(c).cast("string"), "(?U)\\s+", ""), F.lit("")) == ""
    rules = {f"no {c}": blank(c) for c in CHUNK_FIELDS if c not in absent and (needs_text or c != "text")} | {f"no {c}": F.lit(True) for c in absent} | {f"unknown {c}": F.lit(True) for c in strange}
    rules |= {
        "text is too long": F.length(col("text")) > most,
        "content_sha256 is no digest": ~F.coalesce(col("content_sha256"), F.lit("")).rlike("^[0-9a-f]{64}\\z"),
        "char_start is negative": col("char_start").cast("long") < 0,
        "review_status is unknown": ~F.coalesce(col("review_status"), F.lit("")).isin(*STATUSES),
    }
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])))


def encoded(rows: DataFrame, text: Column, encoder, tokens_of, dimension: int, limit: int = 512, prefix: str = "") -> DataFrame:
    """rows with vector: what encoder (a function from a column of texts to one of vectors, such as a pandas UDF) gives,
    over its length. A text of over limit tokens by tokens_of, and a vector of another dimension, of length zero or
    with a component that is no number, fail the job. prefix stands before each text, as some models ask of queries.
    """
    whole = F.concat(F.lit(prefix), text)
    short = rows.where(F.when(tokens_of(whole) <= limit, F.lit(True)).otherwise(F.raise_error(F.lit(f"a text is over {limit} tokens: split it"))))
    out = short.withColumn("__raw", encoder(whole))
    finite = F.forall("__raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce((F.size("__raw") == dimension) & finite & F.exists("__raw", lambda x: x != 0), F.lit(False))
    return out.withColumn("vector", F.when(fine, unit(F.col("__raw"))).otherwise(F.raise_error(F.lit("the encoder gave a bad vector")).cast("array<double>"))).drop("__raw")


def manifest(chunk_rows: DataFrame, model: dict, chunker: str = "characters", context: str = "none") -> DataFrame:
    """One row: the model (model_id, dimension, query_prefix), how chunks were cut, and corpus_digest()'s columns."""
    kind = {"characters": "characters-320-overlap-40-v2", "paragraphs": "paragraphs-1200-overlap-160-v1"}[chunker]
    named = [F.lit(model[c]).alias(c) for c in ("model_id", "dimension", "query_prefix")]
    return corpus_digest(chunk_rows).select("*", *named, F.lit(kind).alias("chunker"), F.lit(context).alias("document_context"), F.lit(True).alias("normalized"))


def require_model(manifest_row: DataFrame, model: dict) -> None:
    """An error if an index was made by another model than queries are encoded by."""
    row = manifest_row.select("model_id", "dimension", "query_prefix").first()
    if row is None or row.asDict() != {c: model[c] for c in ("model_id", "dimension", "query_prefix")}:
        raise ValueError("index and query model differ: build the index anew")
