"""Admission by what an owner holds, and the states of leased jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.ledger import first_violation

ACTIVE = ("waiting_configuration", "pending", "leased", "running")


def holdings(books: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """``owner_id, books, bytes, jobs``: ``books`` and ``sources`` (``byte_size``) count while ``deleted_at`` is null,
    ``jobs`` while their ``state`` is active. Each is aggregated before the three are joined."""
    alive = F.col("deleted_at").isNull()
    b = books.where(alive).groupBy("owner_id").agg(F.count(F.lit(1)).alias("books"))
    s = sources.where(alive).groupBy("owner_id").agg(F.sum("byte_size").alias("bytes"))
    j = jobs.where(F.col("state").isin(*ACTIVE)).groupBy("owner_id").agg(F.count(F.lit(1)).alias("jobs"))
    return b.join(s, "owner_id", "full").join(j, "owner_id", "full").fillna(0, ["books", "bytes", "jobs"])


def admission(requests: DataFrame, limits: DataFrame, books: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """``request_id, code`` of uploads (``request_id, owner_id, byte_size``), each against what the owner holds:
    the first of ``upload_size_exceeded``, ``book_quota_exceeded``, ``library_storage_exceeded`` and
    ``active_job_limit_exceeded`` that applies, ``no_policy`` for an owner without limits, else ``admitted``.

    ``limits``: ``owner_id, max_upload, max_library, max_books, max_jobs``; the others as for ``holdings``.
    """
    rows = requests.join(limits, "owner_id", "left").join(holdings(books, sources, jobs), "owner_id", "left").fillna(0, ["books", "bytes", "jobs"])
    code = first_violation(
        (F.col("max_upload").isNotNull(), "no_policy"),
        (F.col("byte_size") <= F.col("max_upload"), "upload_size_exceeded"),
        (F.col("books") < F.col("max_books"), "book_quota_exceeded"),
        (F.col("bytes") + F.col("byte_size") <= F.col("max_library"), "library_storage_exceeded"),
        (F.col("jobs") < F.col("max_jobs"), "active_job_limit_exceeded"),
    )
    return rows.select("request_id", code.alias("code"))


def holds_lease(now: Column) -> Column:
    """Whether a claim (``claim_token, claim_attempt``) still owns its job: fencing by token, attempt and time."""
    same = F.col("claim_token").eqNullSafe(F.col("token")) & (F.col("claim_attempt") == F.col("attempt_count"))
    return F.coalesce(F.col("state").isin("leased", "running") & same & (F.col("lease_until") > now), F.lit(False))


def fail(claims: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """``job_id, state, run_after`` after failed attempts (``job_id, claim_token, claim_attempt, retryable,
    retry_seconds``): ``lost`` where the lease is not the claim's any more, ``cancelled`` where that was asked
    for, ``pending`` again after the delay while attempts are left, else ``failed``."""
    rows = claims.join(jobs, "job_id")
    again = F.col("retryable") & (F.col("attempt_count") < F.col("max_attempts"))
    state = F.when(~holds_lease(now), "lost").when(F.col("cancel_requested"), "cancelled").when(again, "pending").otherwise("failed")
    after = F.when(state == "pending", F.timestamp_add("SECOND", F.col("retry_seconds"), now))
    return rows.select("job_id", state.alias("state"), after.alias("run_after"))


def expire(jobs: DataFrame, now: Column) -> DataFrame:
    """``job_id, state`` of leased jobs whose lease has run out: ``cancelled`` if asked for, ``pending`` while
    attempts are left, else ``failed``."""
    gone = jobs.where(F.col("state").isin("leased", "running") & (F.col("lease_until") <= now))
    state = F.when(F.col("cancel_requested"), "cancelled").when(F.col("attempt_count") < F.col("max_attempts"), "pending").otherwise("failed")
    return gone.select("job_id", state.alias("state"))


def usage(owners: DataFrame, held: DataFrame, ledger: DataFrame, holds: DataFrame) -> DataFrame:
    """What each owner uses of its limits: ``books, bytes, jobs`` (see ``holdings``), ``spent`` and ``reserved`` (``owner_id, micro``); zeros for none."""
    total = lambda df, name: df.groupBy("owner_id").agg(F.sum("micro").alias(name))
    rows = owners.select("owner_id").join(held, "owner_id", "left").join(total(ledger, "spent"), "owner_id", "left").join(total(holds, "reserved"), "owner_id", "left")
    return rows.fillna(0, ["books", "bytes", "jobs", "spent", "reserved"])


def commits(claims: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """``job_id, outcome`` of finished chapters (jobs with ``claim_token, claim_attempt`` and ``chapter_key, content_hash``): ``lost`` without the
    lease, ``no-op`` where the same content has a receipt, ``changed`` where other content has one (an error, nothing is
    rewritten), else ``append``."""
    had = receipts.groupBy("chapter_key").agg(F.collect_set("content_hash").alias("_had"))
    rows = claims.join(had, "chapter_key", "left")
    outcome = (
        F.when(~holds_lease(now), "lost").when(F.col("_had").isNull(), "append").when(F.array_contains("_had", F.col("content_hash")), "no-op").otherwise("changed")
    )
    return rows.select("job_id", outcome.alias("outcome"))
