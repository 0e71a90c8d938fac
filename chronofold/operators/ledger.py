"""Spend, reservations, limits and row-level changes as folds over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_violation(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that fails, in order; ``admitted`` if none does."""
    out = F.lit("admitted")
    for ok, code in reversed(checks):
        out = F.when(~ok, code).otherwise(out)
    return out


def open_holds(log: DataFrame) -> DataFrame:
    """Holds without a settlement: ``log`` has ``hold_id, op`` (``hold`` or ``settle``)."""
    return log.where("op = 'hold'").join(log.where("op = 'settle'").select("hold_id"), "hold_id", "left_anti")


def deduplicated(receipts: DataFrame, keys: list[str], value: Column, entry: str) -> DataFrame:
    """Repeated receipts: identical ones collapse to the first entry, different ones are a conflict."""
    grouped = receipts.groupBy(*keys).agg(F.min(entry).alias("entry_id"), F.count_distinct(value).alias("values"), F.count(F.lit(1)).alias("rows"))
    return grouped.withColumn("outcome", F.when(F.col("values") > 1, "conflict").otherwise("kept"))


def new_marks(marks: DataFrame, bookmarks: DataFrame, highlights: DataFrame) -> DataFrame:
    """``mark_id, outcome`` of asked-for marks (``mark_id, book_id, anchor, linked_id``): ``ahead`` where the anchor
    lies beyond the atom after the bookmark, ``no highlight`` where the linked one (``mark_id, book_id,
    deleted_at``) is not a live one of the book, else ``created``."""
    alive = highlights.where("deleted_at is null").select(F.col("mark_id").alias("linked_id"), "book_id", F.lit(True).alias("linked"))
    rows = marks.join(bookmarks, "book_id", "left").join(alive, ["book_id", "linked_id"], "left")
    ahead = F.col("anchor") > F.coalesce("bookmark", F.lit(0)) + 1
    loose = F.col("linked_id").isNotNull() & F.col("linked").isNull()
    return rows.select("mark_id", F.when(ahead, "ahead").when(loose, "no highlight").otherwise("created").alias("outcome"))


def migrations(pinned: str, current: str, parts: tuple[str, ...]) -> Column:
    """The parts of an identity (fields of two structs) that differ and have to be made anew, in order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{pinned}.{p}").eqNullSafe(F.col(f"{current}.{p}")), F.lit(p)) for p in parts]))


def projected(requests: DataFrame, ledger: DataFrame, holds: DataFrame) -> DataFrame:
    """``request_id, outcome``: what ledger, open reservations and a request make together against its book's ceilings: ``input``,
    ``output`` or ``usd``, the first that is exceeded, else ``ok``. ``ledger`` and ``holds``: ``book_id, input_tokens, output_tokens,
    micro``; ``requests`` has these, ``request_id`` and the ceilings ``max_input, max_output, max_micro`` (null: none)."""
    amounts = ("input_tokens", "output_tokens", "micro")
    total = lambda df: df.groupBy("book_id").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    used = ledger.select("book_id", *amounts).unionByName(holds.select("book_id", *amounts))
    rows = requests.join(total(used), "book_id", "left")
    under = lambda a, top: F.col(top).isNull() | (F.coalesce(F.col(f"_{a}"), F.lit(0)) + F.col(a) <= F.col(top))
    checks = [(under(a, top), name) for a, top, name in zip(amounts, ("max_input", "max_output", "max_micro"), ("input", "output", "usd"))]
    code = first_violation(*checks)
    return rows.select("request_id", F.when(code == "admitted", "ok").otherwise(code).alias("outcome"))


def pinned_first(asked: DataFrame, pins: DataFrame, order: list[str]) -> DataFrame:
    """``book_id, pin, outcome``: a book's first request (``book_id, space``) pins its space where none is pinned (``pins``: ``book_id, space``):
    ``pinned``; the space it has is ``kept``, another one a ``conflict``, which changes nothing."""
    first = asked.groupBy("book_id").agg(F.min_by("space", F.struct(*order)).alias("asked"))
    rows = first.join(pins.select("book_id", F.col("space").alias("had")), "book_id", "left")
    outcome = F.when(F.col("had").isNull(), "pinned").when(F.col("had") == F.col("asked"), "kept").otherwise("conflict")
    return rows.select("book_id", F.coalesce("had", "asked").alias("pin"), outcome.alias("outcome"))


def repinned(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``book_id, pin``: a new space (``book_id, space``) is taken only where no live row (``book_id, space, retracted_at``) is in another one;
    null where it is refused."""
    live = rows.where("retracted_at is null").select("book_id", F.col("space").alias("other"))
    strangers = asked.join(live, "book_id").where(~F.col("other").eqNullSafe(F.col("space"))).select("book_id", F.lit(True).alias("refused")).distinct()
    return asked.join(strangers, "book_id", "left").select("book_id", F.when(F.col("refused").isNull(), F.col("space")).alias("pin"))


# The limits that may be changed.
LIMITS = (
    "max_upload_bytes", "max_library_bytes", "max_books", "max_active_jobs", "requests_per_window", "request_window_seconds",
    "max_provider_concurrency", "max_spend_usd",
)


def updated_limits(limits: DataFrame, updates: DataFrame) -> DataFrame:
    """``limits`` (``owner_id`` and columns of ``LIMITS``) after ``updates`` (``owner_id, field, value, at``; the last of a field counts), with ``outcome``:
    ``updated``, ``refused`` where any field is none of ``LIMITS`` (nothing of it is taken), ``unchanged`` without an update; and rows
    of nulls, ``unknown``, for owners without limits."""
    last = updates.groupBy("owner_id", "field").agg(F.max_by("value", "at").alias("value"))
    given = last.groupBy("owner_id").agg(
        F.bool_or(~F.col("field").isin(*LIMITS)).alias("_bad"), *[F.max(F.when(F.col("field") == c, F.col("value"))).alias(f"_{c}") for c in limits.columns if c in LIMITS]
    )
    rows = limits.withColumn("_known", F.lit(True)).join(given, "owner_id", "full")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_bad").isNull(), "unchanged").when(F.col("_bad"), "refused").otherwise("updated")
    take = lambda c: F.when((F.col("outcome") == "updated") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}").cast(dict(limits.dtypes)[c])).otherwise(F.col(c)).alias(c)
    return rows.withColumn("outcome", outcome).select("owner_id", *[take(c) for c in limits.columns if c in LIMITS], "outcome")
