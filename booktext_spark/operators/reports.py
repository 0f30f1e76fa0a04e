"""Summaries of books, jobs and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of jobs and books.
PROCESSING = ("validating", "parsing", "translating", "reviewing", "assembling", "validating_output")
JOB_STATES = ("queued", "validating", "parsing", "awaiting_review", "translating", "reviewing", "assembling", "validating_output", "completed", "paused", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
PARSING = ("uploaded", "queued", "parsing", "validating")
IN_REVIEW, IN_WORK = ("awaiting_review", "context_changed"), ("translating", "reviewing", "assembling", "validating_output")
NO_TITLE = "书稿信息不可用"


def stalled_jobs(jobs: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Jobs with attempts left that are queued, or in work with an expired lease; all in order of creation, the oldest first. Null states and attempts are not stalled."""
    expired = F.col("state").isin(*PROCESSING) & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)
    return jobs.where((F.col("attempts") < max_attempts) & ((F.col("state") == "queued") | expired)).orderBy("created_at", "job_id")


def alignment_state(mode: Column, status: Column) -> Column:
    return F.when(mode == "style_only", "not_applicable").when(status == "ready", "ready").when(status == "awaiting_review", "review").otherwise("pending")


def export_state(status: Column) -> Column:
    return F.when(status == "completed", "ready").when(status == "failed", "failed").when(status == "building", "building").otherwise("queued")


def job_state(state: Column) -> Column:
    return F.when(state.isin(*JOB_STATES), state).otherwise("failed")


def derive_status(df: DataFrame, kind: str) -> DataFrame:
    """df with derived_status of libraries, exports or jobs."""
    made = {"library": lambda: alignment_state(F.col("mode"), F.col("status")), "export": lambda: export_state(F.col("status")), "job": lambda: job_state(F.col("state"))}
    return df.withColumn("derived_status", made[kind]())


def book_summary(books: DataFrame, projects: DataFrame) -> DataFrame:
    """book_id, title, target_locales (sorted), cover_policy, state, updated_at; the latest project decides policy and time."""
    any_of = lambda *states: F.bool_or(F.col("status").isin(*states))
    per = projects.groupBy("book_id").agg(
        F.array_sort(F.collect_set("target_locale")).alias("target_locales"), F.max_by("cover_policy", F.struct("updated_at", "project_id")).alias("cover_policy"), F.max("updated_at").alias("project_updated_at"),
        any_of("completed").alias("done"), any_of(*IN_REVIEW).alias("in_review"), any_of(*IN_WORK).alias("in_work"),
    )
    rows = books.join(per, "book_id", "left")
    state = (
        F.when(F.col("parse_status") == "failed", "failed").when(F.col("parse_status").isin(*PARSING), "parsing").when(F.col("done").isNull(), "ready")
        .when(F.col("done"), "completed").when(F.col("in_review"), "review").when(F.col("in_work"), "translating").otherwise("ready")
    )
    title = F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.col("title")).otherwise(F.col("filename"))
    return rows.select("book_id", title.alias("title"), F.coalesce("target_locales", F.array().cast("array<string>")).alias("target_locales"), F.coalesce("cover_policy", F.lit("preserve")).alias("cover_policy"), state.alias("state"), F.coalesce("project_updated_at", "updated_at", "created_at").alias("updated_at"))


def job_summary(jobs: DataFrame, projects: DataFrame, books: DataFrame) -> DataFrame:
    """job_id, project_id, book_id, book_title, locale, state, completed_blocks, total_blocks, issue_count with their defaults.

    book_id is a string, empty where the project or its book is unknown; an unknown or null state is failed; a checkpoint that is null or no JSON
    has no counts; repeated projects and books repeat the job's row.
    """
    number = lambda name: F.get_json_object("checkpoint", f"$.{name}").cast("int")
    rows = jobs.join(projects.select("project_id", "book_id", F.col("name").alias("project_name"), F.col("target_locale").alias("locale")), "project_id", "left").join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
    rows = rows.withColumn("total_blocks", number("total_blocks"))
    reckoned = F.when(F.coalesce("total_blocks", F.lit(0)) > 0, F.floor(F.col("progress") * F.col("total_blocks"))).otherwise(0)
    return rows.select(
        "job_id", "project_id", F.coalesce(F.col("book_id").cast("string"), F.lit("")).alias("book_id"), F.coalesce("book_title", "project_name", F.lit(NO_TITLE)).alias("book_title"), F.coalesce("locale", F.lit("zh-CN")).alias("locale"),
        job_state(F.col("state")).alias("state"), F.coalesce(number("completed_blocks"), reckoned).cast("bigint").alias("completed_blocks"), "total_blocks",
        F.coalesce(number("issue_count"), F.when(F.length(F.coalesce("error_code", F.lit(""))) > 0, 1).otherwise(0)).alias("issue_count"),
    )


def project_lookup(projects: DataFrame) -> DataFrame:
    """book_id, target_locale, project_id of the latest updated project."""
    return projects.groupBy("book_id", "target_locale").agg(F.max_by("project_id", F.struct("updated_at", "project_id")).alias("project_id"))
