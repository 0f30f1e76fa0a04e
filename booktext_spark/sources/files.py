"""Book files: dispatch, text decoding, text blocks, parsed tables, text and JSON editions."""

from __future__ import annotations

import codecs
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from booktext_spark.functions.ids import block_identifier, stable_identifier
from booktext_spark.functions.text import char_ratios

#: Error codes of rejected rows.
UNSUPPORTED_FORMAT, CONFIRM_ENCODING = "UNSUPPORTED_FORMAT", "ENCODING_CONFIRMATION_REQUIRED"
#: Other names of encodings.
ALIASES = {"shift-jis": "cp932", "shiftjis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "utf8": "utf-8"}
#: Least share of Japanese characters and largest share of control characters in CP932, characters of a preview.
JAPANESE_SHARE, CONTROL_SHARE, PREVIEW = 0.02, 0.001, 240
TEXT_SECTION = "txt:body"


def read_books(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, content, extension) of the supported files under a path, and rejects of all others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))
    known = F.col("extension").isin("epub", "txt", "pdf")
    return rows.where(known), rows.where(~known).select("path", F.lit(UNSUPPORTED_FORMAT).alias("error_code"))


@F.pandas_udf(StringType())
def decode_legacy(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes in a named encoding; null where they or the name are not valid."""

    def one(data: bytes | None, name: str | None) -> str | None:
        try:
            return None if data is None or name is None else codecs.decode(data, name)
        except (LookupError, ValueError):
            return None

    return pd.Series([one(d, n) for d, n in zip(content, encoding, strict=True)], dtype=object)


def decode_text(df: DataFrame, content: str = "content", confirmed: str = "confirmed_encoding") -> tuple[DataFrame, DataFrame]:
    """(rows with text and encoding, rejects with error_code, candidate and preview).

    The confirmed encoding decides if there is one; then byte order marks, strict UTF-8, and CP932 only where
    enough characters are Japanese and few are controls. Null content is rejected.
    """
    data = F.col(content)
    name = F.lower(F.replace(F.col(confirmed), F.lit("_"), F.lit("-")))
    for other, canonical in ALIASES.items():
        name = F.when(name == other, canonical).otherwise(name)
    head = F.hex(F.substring(data, 1, 3))
    valid = F.is_valid_utf8(data)
    guess = (
        F.when(F.length(F.coalesce(F.col(confirmed), F.lit(""))) > 0, name)
        .when(head == "EFBBBF", "utf-8-sig")
        .when(head.startswith("FFFE") | head.startswith("FEFF"), "utf-16")
        .when(valid, "utf-8")
        .otherwise("cp932")
    )
    sure = F.length(F.coalesce(F.col(confirmed), F.lit(""))) > 0
    tried = df.withColumns({"encoding": guess, "__sure": sure}).withColumn("text", F.when((F.col("encoding") == "utf-8") & valid, F.decode(data, "UTF-8")).otherwise(decode_legacy(data, F.col("encoding"))))
    ratios = char_ratios(F.col("text"))
    doubtful = (F.col("encoding") == "cp932") & ~F.col("__sure") & ((ratios["japanese"] < JAPANESE_SHARE) | (ratios["control"] > CONTROL_SHARE))
    bad = F.col("text").isNull() | doubtful
    ok = tried.where(~bad).drop("__sure")
    rejects = tried.where(bad).select(*[c for c in df.columns if c != content], F.lit(CONFIRM_ENCODING).alias("error_code"), F.col("encoding").alias("candidate"), F.substring("text", 1, PREVIEW).alias("preview"))
    return ok, rejects


def split_text_blocks(df: DataFrame, separator: str = r"\n{2,}", id_col: str = "source_hash", text_col: str = "text") -> DataFrame:
    """One row for each paragraph: book_id, section_id, section_ordinal, ordinal, stable_id, kind, source_text, locator, metadata.

    Line ends become newlines; leading and trailing newlines are kept in the metadata of the first and the last block,
    and each block keeps the separator after it, so that export gives the text back. A text without
    paragraphs is one empty block. A text of newlines only has them as leading and as trailing ones.
    """
    text = F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = df.select(F.col(id_col).cast("string").alias("source_hash"), text.alias("t"))
    rows = rows.withColumns({"leading": F.regexp_extract("t", r"^\n+", 0), "trailing": F.regexp_extract("t", r"\n+\z", 0)})
    start, end = F.length("leading"), F.length("t") - F.length("trailing")
    rows = rows.withColumn("body", F.substr("t", start + 1, F.greatest(end - start, F.lit(0))))
    rows = rows.withColumns({"parts": F.split("body", separator, -1), "gaps": F.regexp_extract_all("body", F.lit(f"({separator})"), 1)})
    # an empty last part is no block, unless it is the only one
    n = F.size("parts")
    parts = F.when((n > 1) & (F.element_at("parts", -1) == ""), F.slice("parts", 1, n - 1)).otherwise(F.col("parts"))
    rows = rows.withColumn("parts", parts)
    section, locator = F.lit(TEXT_SECTION), F.concat(F.lit("paragraph:"), F.col("ordinal").cast("string"))
    rows = rows.withColumns({"book_id": stable_identifier("book", F.col("source_hash")), "section_id": stable_identifier("sec", F.col("source_hash"), section)})  # once for each text
    blocks = rows.select("source_hash", "book_id", "section_id", "leading", "trailing", "gaps", F.size("parts").alias("n"), F.posexplode("parts").alias("ordinal", "source_text"))
    metadata = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("separator_after").alias("key"), F.coalesce(F.get("gaps", F.col("ordinal")), F.lit("")).alias("value")),
                F.when(F.col("ordinal") == 0, F.struct(F.lit("leading_newlines").alias("key"), F.col("leading").alias("value"))),
                F.when(F.col("ordinal") == F.col("n") - 1, F.struct(F.lit("trailing_newlines").alias("key"), F.col("trailing").alias("value"))),
            ),
            lambda e: e.isNotNull(),
        )
    )
    return blocks.select(
        "book_id",
        "section_id",
        F.lit(0).alias("section_ordinal"),
        "ordinal",
        block_identifier(F.col("source_hash"), section, locator, F.col("source_text")).alias("stable_id"),
        F.lit("paragraph").alias("kind"),
        "source_text",
        locator.alias("locator"),
        metadata.alias("metadata"),
    )


def write_parsed(tables: dict[str, DataFrame], path: str) -> int:
    """Writes sections and blocks of the books that have none at the path yet, all tables at once; a repeated run adds nothing. Returns the version.

    A run writes its tables into a folder of its own, which nobody reads until a version names it. A version is a small file that lists the runs; it
    is written under another name and moved to its number, which fails if another writer has that number already. Then the books that the others have
    brought are left out of a new run, and the next number is tried. So a run that breaks off leaves nothing to be seen, and two runs at once
    leave each book once and whole. read_parsed reads what the latest version lists.
    """
    spark = next(iter(tables.values())).sparkSession
    while True:
        version, runs = _latest(spark, path)
        run = f"run-{uuid.uuid4().hex}"
        for name, df in tables.items():
            old = read_parsed(spark, path, name, runs)
            new = df if old is None else df.join(old.select("book_id").distinct(), "book_id", "left_anti")
            new.write.parquet(f"{path}/{run}/{name}")
        if _commit(spark, path, version + 1, [*runs, run]):
            return version + 1


def read_parsed(spark: SparkSession, path: str, name: str, runs: list[str] | None = None) -> DataFrame | None:
    """A table of what write_parsed has committed at the path, of the latest version or of given runs; None if no run has it."""
    runs = _latest(spark, path)[1] if runs is None else runs
    at = [f"{path}/{run}/{name}" for run in runs]
    there = [p for p in at if _file_system(spark, p).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    return spark.read.parquet(*there) if there else None


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, runs) of the latest version; (0, none) before the first."""
    folder, fs = f"{path}/_versions", _file_system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
    if not numbers:
        return 0, []
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{max(numbers):08d}"))
    try:
        return max(numbers), str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, runs: list[str]) -> bool:
    """Whether the version with these runs could be put in place: not if its number is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    trial, final = hadoop.Path(f"{path}/_versions/.{uuid.uuid4().hex}"), hadoop.Path(f"{path}/_versions/{version:08d}")
    out = _file_system(spark, path).create(trial, False)
    try:
        out.write(" ".join(runs).encode())
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(hadoop, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(kind, 1)
    never_over[0] = kind.NONE
    try:
        context.rename(context.makeQualified(trial), context.makeQualified(final), never_over)
        return True
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False


def export_text(blocks: DataFrame, effective: DataFrame | None = None) -> DataFrame:
    """book_id, text: leading newlines, each block's text and separator in order, trailing newlines.

    effective(stable_id, text) replaces source texts; an empty text is a translation. Blocks without a separator in their
    metadata are followed by a blank line, as are sections.
    """
    if effective is not None:
        new = effective.select("stable_id", F.col("text").alias("__text"))
        blocks = blocks.join(new, "stable_id", "left").withColumn("source_text", F.coalesce("__text", "source_text")).drop("__text")
    part = F.struct("section_ordinal", "ordinal", F.col("source_text").alias("text"), F.try_element_at("metadata", F.lit("separator_after")).alias("after"), F.try_element_at("metadata", F.lit("leading_newlines")).alias("before"), F.try_element_at("metadata", F.lit("trailing_newlines")).alias("end"))
    books = blocks.groupBy("book_id").agg(F.sort_array(F.collect_list(part)).alias("b"))
    n = F.size("b")
    body = F.array_join(F.transform("b", lambda x, i: F.concat(x["text"], F.when(i == n - 1, F.coalesce(x["after"], F.lit(""))).when((F.coalesce(x["after"], F.lit("")) == "") & (F.get("b", i + 1)["section_ordinal"] != x["section_ordinal"]), F.lit("\n\n")).otherwise(F.coalesce(x["after"], F.lit("\n\n"))))), "")
    edge = lambda name: F.array_join(F.transform("b", lambda x: F.coalesce(x[name], F.lit(""))), "")
    return books.select("book_id", F.concat(edge("before"), body, edge("end")).alias("text"))


def export_report(exports: DataFrame, texts: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """export_id, book_id, format, valid, n_bytes, sha256, omitted_non_text_assets of each artifact; a missing text is not valid."""
    data = F.encode("text", "UTF-8")
    rows = exports.join(texts, "book_id", "left")
    n_assets = F.lit(0).cast("bigint")
    if assets is not None:
        rows = rows.join(assets.groupBy("book_id").agg(F.count("*").alias("n_assets")), "book_id", "left")
        n_assets = F.coalesce("n_assets", F.lit(0))
    return rows.select("export_id", "book_id", "format", F.col("text").isNotNull().alias("valid"), F.octet_length(data).alias("n_bytes"), F.sha2(data, 256).alias("sha256"), F.when(F.col("format") == "txt", n_assets).otherwise(0).alias("omitted_non_text_assets"))


def documents_to_json(books: DataFrame, sections: DataFrame, blocks: DataFrame, assets: DataFrame | None = None, toc: DataFrame | None = None) -> DataFrame:
    """book_id, json: the whole nested book; asset bytes as lower-case hex, the contents as a list by toc_ordinal.

    toc has book_id, toc_ordinal and other columns; entries of a tree name their parent's toc_ordinal in one of them. A book
    without sections, assets or contents has a null there.
    """
    block = [c for c in blocks.columns if c not in ("book_id", "section_id", "section_ordinal")]
    inner = blocks.groupBy("book_id", "section_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in block if c != "ordinal" and c != "metadata"], *([F.to_json("metadata").alias("metadata")] if "metadata" in block else [])))).alias("blocks"))
    section = [c for c in sections.columns if c != "book_id" and c != "ordinal" and c != "metadata"]
    whole = sections.join(inner, ["book_id", "section_id"], "left").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *section, "blocks"))).alias("sections"))
    out = books.join(whole, "book_id", "left")
    if assets is not None:
        asset = [F.lower(F.hex("data")).alias("data") if c == "data" else F.col(c) for c in assets.columns if c != "book_id"]
        out = out.join(assets.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct(*asset))).alias("assets")), "book_id", "left")
    if toc is not None:
        entry = F.struct("toc_ordinal", *[c for c in toc.columns if c not in ("book_id", "toc_ordinal")])
        out = out.join(toc.groupBy("book_id").agg(F.sort_array(F.collect_list(entry)).alias("toc")), "book_id", "left")
    return out.select("book_id", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("json"))


def documents_from_json(df: DataFrame, schema: str) -> dict[str, DataFrame]:
    """books, sections, blocks and, where the schema has them, assets and toc of documents_to_json; schema is that of the nested JSON."""
    rows = df.select(F.from_json("json", schema).alias("d"))
    top = rows.select("d.*")
    sections = top.select("book_id", F.explode("sections").alias("s"))
    tables = {
        "books": top.drop("sections", "assets", "toc"),
        "sections": sections.select("book_id", "s.*").drop("blocks"),
        "blocks": sections.select("book_id", "s.section_id", F.col("s.ordinal").alias("section_ordinal"), F.explode("s.blocks").alias("b")).select("book_id", "section_id", "section_ordinal", "b.*"),
    }
    if "assets" in top.columns:
        assets = top.select("book_id", F.explode("assets").alias("a")).select("book_id", "a.*")
        tables["assets"] = assets.withColumn("data", F.unhex("data")) if "data" in assets.columns else assets
    if "toc" in top.columns:
        tables["toc"] = top.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")
    return tables
