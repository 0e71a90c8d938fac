"""URL filtering by rules and a character language-model ratio (DataFrame functions only).

Rules name a host (with its subdomains) and a path start; the longest that fits decides.
The URLs that rules decide are the accepted and the rejected examples. From each class a
smoothed variable-order Markov model of characters is counted, over all contexts of up to
``ORDER`` characters, in partitioned tables that grow with the input.
P(c | context) mixes the context's counts with the next shorter context's estimate,
which weighs as much as ``PRIOR`` observations. A URL's score is the difference of its
log-likelihoods under the two models over its length. Each distinct pair of character and
context is scored once, and URLs get the scores by a join; pairs that make up at least a
``HOT_GRAMS``-th of all positions, and model tables of at most ``BROADCAST_ROWS`` rows, are broadcast for it
in place of being shuffled. URLs are read in pieces, so that a very long one takes time in proportion to its length. The threshold is calibrated on
labelled URLs that the models were not counted on: the score with the least balanced
error in a histogram of fixed width.

Defined results: a null URL, or one without ``://``, has an empty host and path and no
rule; a null or empty URL scores 0; repeated rows count as often as they occur and are
judged alike; where one class has no example the score is 0 and the verdict ``allow``;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import UPPER, settled, table

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5
PIECE = 512
BROADCAST_ROWS = 200_000
HOT_GRAMS = 20_000
UNIT = 1_000_000_000
PRIOR = 4.0
BIN_WIDTH = 0.005
START = "\u0002"
# What both models give a character that they never saw.
BASE = 1.0 / 97


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host, path, rule, ruling``. The longest rule wins; of equally long ones the first listed."""
    host, path = split_url(F.col("url"))
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    out = pages.withColumn("host", host).withColumn("path", path)
    pick = lambda value: F.coalesce(
        *[F.when(_fits(F.col("host"), F.col("path"), h, p), F.lit(value(h, p, v))) for h, p, v in ranked],
        F.lit(None).cast("string"),
    )
    return out.withColumn("rule", pick(lambda h, p, v: h + p)).withColumn("ruling", pick(lambda h, p, v: v))


def _text(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), START, "\ufffd")


def _pieces(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row per ``PIECE`` characters of a URL: ``_s``, the characters with the up to ORDER ones before them
    (for the first piece START), and ``_from``, the first position that is its own. So a character's row never
    carries a whole URL, and work is in proportion to a URL's length."""
    parts = urls.select(*keep, F.regexp_extract_all(F.col("_url"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("_parts"))
    before = lambda i: F.when(i == 0, F.lit(START)).otherwise(F.right(F.get("_parts", i - 1), F.lit(ORDER)))
    each = parts.select(*keep, F.explode(F.transform("_parts", lambda p, i: F.struct(F.concat(before(i), p).alias("s"), i.alias("i")))).alias("p"))
    return each.select(*keep, F.col("p.s").alias("_s"), F.when(F.col("p.i") == 0, 2).otherwise(ORDER + 1).alias("_from"))


def _positions(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character: the character ``c`` and its longest context ``x``, of up to ORDER characters."""
    each = _pieces(urls, keep).select(*keep, "_s", F.explode(F.sequence("_from", F.length("_s"))).alias("i"))
    x = F.expr(f"substring(_s, greatest(i - {ORDER}, 1), least({ORDER}, i - 1))")
    return each.select(*keep, F.expr("substring(_s, i, 1)").alias("c"), x.alias("x"))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def train(labelled: DataFrame) -> list[DataFrame]:
    """Per order a table ``x, c, pa, pr``: smoothed probabilities under the accepted and the
    rejected model; the row with a null ``c`` has the factors that a character unseen there multiplies
    the shorter context's estimate with. ``labelled``: ``_url, ok, rows``."""
    # Characters are counted once, after their longest contexts; shorter contexts' counts are sums of these.
    counted = [F.sum(F.when(F.col("ok") == ok, F.col("rows")).otherwise(0)).cast("double").alias(n) for ok, n in ((True, "na"), (False, "nr"))]
    longest = settled(_positions(labelled, ["ok", "rows"]).groupBy("x", "c").agg(*counted))
    tables: list[DataFrame] = []
    for k in range(ORDER + 1):
        grams = longest.where(F.length("x") >= k).groupBy(F.right("x", F.lit(k)).alias("x"), "c").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        # A context has at most one row per character.
        same = Window.partitionBy("x")
        each = settled(grams.select("*", F.sum("na").over(same).alias("ta"), F.sum("nr").over(same).alias("tr")))
        if k == 0:
            mixed = each.withColumn("qa", F.lit(BASE)).withColumn("qr", F.lit(BASE))
        else:
            # A context's suffix occurs at least as often, at a place of every shorter order too.
            seen = tables[k - 1].where(F.col("c").isNotNull()).select(
                F.col("x").alias("y"), F.col("c").alias("d"), F.col("pa").alias("qa"), F.col("pr").alias("qr")
            )
            mixed = each.withColumn("_y", F.expr("substring(x, 2, length(x))")).join(
                _small(seen), (F.col("_y") == F.col("y")) & (F.col("c") == F.col("d")), "left"
            )
        mixed = mixed.select(
            "x",
            "c",
            ((F.col("na") + PRIOR * F.coalesce("qa", F.lit(BASE))) / (F.col("ta") + PRIOR)).alias("pa"),
            ((F.col("nr") + PRIOR * F.coalesce("qr", F.lit(BASE))) / (F.col("tr") + PRIOR)).alias("pr"),
        )
        unseen = each.select("x", "ta", "tr").distinct().select(
            "x",
            F.lit(None).cast("string").alias("c"),
            (PRIOR / (F.col("ta") + PRIOR)).alias("pa"),
            (PRIOR / (F.col("tr") + PRIOR)).alias("pr"),
        )
        tables.append(settled(mixed.unionByName(unseen)))
    return tables


def score(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``_uid`` and ``score``, the log-likelihood ratio per character. ``urls``: ``_uid, _url``."""
    at = _positions(urls, ["_uid"])
    each = at.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n"))
    ratio: Column = F.lit(0.0)
    for k, model in enumerate(tables):
        log = (F.log("pa") - F.log("pr")).alias(f"g{k}")
        gram = _small(model.where(F.col("c").isNotNull()).select(F.col("x").alias(f"gx{k}"), F.col("c").alias(f"gc{k}"), log))
        back = _small(model.where(F.col("c").isNull()).select(F.col("x").alias(f"bx{k}"), log.alias(f"b{k}")))
        each = each.withColumn(f"x{k}", F.when(F.length("x") >= k, F.right("x", F.lit(k))))
        each = each.join(gram, (F.col(f"x{k}") == F.col(f"gx{k}")) & (F.col("c") == F.col(f"gc{k}")), "left")
        each = each.join(back, F.col(f"x{k}") == F.col(f"bx{k}"), "left")
        # Seen here: this order's estimate. Else the shorter one's, times this context's factor if it occurs.
        ratio = F.coalesce(F.col(f"g{k}"), ratio + F.coalesce(F.col(f"b{k}"), F.lit(0.0)))
    pairs = settled(each.select("x", "c", "n", F.round(ratio * UNIT).cast("long").alias("r")))
    total = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = F.col("n") * HOT_GRAMS >= total
    hot = at.join(F.broadcast(pairs.where(often)), ["x", "c"])
    rest = at.join(F.broadcast(pairs.where(often).select("x", "c")), ["x", "c"], "left_anti").join(pairs.where(~often), ["x", "c"])
    # Whole numbers of 1 / UNIT, so the order of the sums does not matter.
    sums = hot.select("_uid", "r").unionByName(rest.select("_uid", "r")).groupBy("_uid")
    return sums.agg((F.sum("r") / F.count(F.lit(1)) / UNIT).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least balanced error among the bins' lower ends. ``scored``: ``score, ok, rows``."""
    # Smoothing bounds a score by some hundreds, and so the number of bins.
    hist = (
        scored.groupBy(F.floor(F.col("score") / BIN_WIDTH).alias("bin"))
        .agg(*[F.sum(F.when(F.col("ok") == ok, F.col("rows")).otherwise(0)).alias(n) for ok, n in ((True, "a"), (False, "r"))])
        .orderBy("bin")
        .collect()
    )
    a, r = sum(x["a"] for x in hist), sum(x["r"] for x in hist)
    if not a or not r:
        return 0.0
    # Between two occupied bins every threshold errs alike; the middle of the gap is taken.
    lost, caught, best, below = 0, 0, [], hist[0]["bin"]
    for x in hist:
        best.append((lost / a + (r - caught) / r, (below + x["bin"]) / 2))
        lost, caught, below = lost + x["a"], caught + x["r"], x["bin"] + 1
    best.append((1.0, float(below)))
    least = min(b[0] for b in best)
    level = [b[1] for b in best if b[0] == least]
    return level[len(level) // 2] * BIN_WIDTH


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; ``score`` is null where a rule decided."""
    ruled = with_rules(pages.select("page_id", "url"), rules)
    # Equal URLs are scored once: their characters' rows then never gather under one hot key.
    urls = settled(
        ruled.groupBy(_text(F.col("url")).alias("_url"), "ruling").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("_uid", F.monotonically_increasing_id())
    )
    labelled = urls.where(F.col("ruling").isNotNull()).select("_uid", "_url", "rows", (F.col("ruling") == "allow").alias("ok"))
    classes = labelled.agg(F.bool_or("ok").alias("a"), F.bool_or(~F.col("ok")).alias("r")).first()
    plain = F.coalesce("ruling", F.lit("allow"))
    if not (classes["a"] and classes["r"]):
        return ruled.select("page_id", "host", "path", "rule", plain.alias("verdict"), F.lit(0.0).alias("score"))
    fold = F.crc32("_url") % 5
    tables = train(labelled.where(fold != 0))
    scored = settled(score(urls.where(F.col("ruling").isNull() | (fold == 0)).select("_uid", "_url"), tables))
    level = calibrate(labelled.join(scored, "_uid"))
    scores = urls.where(F.col("ruling").isNull()).join(scored, "_uid").select("_url", "score")
    out = ruled.withColumn("_key", F.when(F.col("ruling").isNull(), _text(F.col("url")))).join(
        scores.select(F.col("_url").alias("_key"), "score"), "_key", "left"
    )
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= level, "allow").otherwise("block")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruling", by_model).alias("verdict"),
        F.when(F.col("ruling").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
