"""The type of a book from counts over its sections; ``unknown`` where signals are weak or conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns: titles of each kind, cues of plays, verbs of stories.
TITLES = {
    "drama": r"(?i)\b(?:act|scene)\s+(?:[ivxlcdm]+|\d+)\b",
    "poetry": r"(?i)\b(?:sonnet|ode|canto|poem|verse|stanza)\b",
    "anthology": r"(?i)\b(?:story|stories|tale|tales|adventure|adventures|essay|essays)\b",
    "reference": r"(?i)\b(?:lesson|exercise|glossary|reference|definition|procedure|tutorial|manual|index|appendix)\b",
    "nonfiction": r"(?i)\b(?:lecture|memoir|history|biography|treatise|meditation)\b",
    "chapter": r"(?i)\bchapter\s+(?:[ivxlcdm]+|\d+)\b",
}
SPEAKER = r"\b[A-Z][A-Z' -]{2,24}:\s"
STAGE = r"(?i)\b(?:enter|exit|exeunt)\b|\[(?:scene|stage|aside)\b"
VERBS = (
    r"(?i)\b(?:said|asked|answered|replied|arrived|left|went|came|met|remembered|thought|felt|"
    r"saw|heard|told|summoned|spoke|waited|returned|walked|stood|sat)\b"
)
# Base, weight and cap of each score, and what the best one needs.
SCORES = {"drama": (0.35, 0.65, 0.99), "poetry": (0.3, 0.65, 0.98), "anthology": (0.25, 0.7, 0.96), "reference": (0.3, 0.68, 0.98), "nonfiction": (0.25, 0.65, 0.9)}
SHORT, LONG, LEAST, MARGIN = 300, 500, 0.65, 0.15


def book_types(sections: DataFrame) -> DataFrame:
    """``book_id, sections, book_type, confidence`` of ``sections`` (``book_id, title, text``): one aggregate of
    counts per book, pre-aggregated, and scores from them."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    each = sections.select(
        "book_id", (words <= SHORT).alias("short"), (words >= LONG).alias("long"), F.regexp_count(text, F.lit(VERBS)).alias("verbs"),
        (F.regexp_count(text, F.lit(SPEAKER)) + F.regexp_count(text, F.lit(STAGE))).alias("cues"), *[title.rlike(p).alias(k) for k, p in TITLES.items()],
    )
    g = each.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("short").alias("shorts"), F.count_if("long").alias("longs"), F.sum("verbs").alias("verbs"), F.sum("cues").alias("cues"),
        *[F.count_if(k).alias(k) for k in TITLES],
    )
    share = lambda c: F.col(c) / F.col("n")
    more = {
        "drama": F.least(F.lit(0.2), F.col("cues") / (F.col("n") * 10)), "poetry": F.when(share("shorts") >= 0.75, 0.1).otherwise(0.0),
        "reference": F.when(share("shorts") >= 0.5, 0.05).otherwise(0.0),
    }
    scores = {k: F.least(F.lit(cap), base + weight * share(k) + more.get(k, F.lit(0.0))) for k, (base, weight, cap) in SCORES.items()}
    told = F.col("verbs") >= F.col("n") * 2
    novel = F.when((share("longs") >= 0.6) & told, 0.82 + F.least(F.lit(0.12), F.col("verbs") / (F.col("n") * 100))).when((share("chapter") >= 0.75) & told, 0.76).otherwise(0.0)
    scores["novel"] = F.when(share("anthology") >= 0.75, F.least(novel, F.lit(0.5))).otherwise(novel)
    order = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in scores.items()]))
    top, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    unsure = (-top["s"] < LEAST) | (second["s"] - top["s"] < MARGIN)
    confidence = F.when(unsure, F.greatest(F.lit(0.0), F.least(F.lit(0.64), -top["s"]))).otherwise(-top["s"])
    return g.select("book_id", F.col("n").alias("sections"), F.when(unsure, "unknown").otherwise(top["k"]).alias("book_type"), F.round(confidence, 3).alias("confidence"))
