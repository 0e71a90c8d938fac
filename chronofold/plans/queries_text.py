"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import text as X
from chronofold.plans.registry import query
from chronofold.plans.standins import bind

W = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}]+')"
STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def joined(tokens):
    return F.array_join(tokens, " ")


@query("str_normalize", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \n\t\r]+', ' ', 'g'))) AS h FROM documents")
def str_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.normalise_fast(F.col("text"))).alias("h"))


@query("str_normalize_nfc", r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))) AS h FROM documents")
def str_normalize_nfc(spark, sf):
    """NFC and case folding; SQL lower-cases, and the texts hold no folded letter but the sharp s."""
    return docs(spark, sf).select("doc_id", F.md5(X.normalise("text")).alias("h"))


@query("str_words", "SELECT doc_id, len(" + W.format("text") + ") AS n, md5(array_to_string(" + W.format("text") + ", ' ')) AS h FROM documents")
def str_words(spark, sf):
    w = X.words(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n"), F.md5(joined(w)).alias("h"))


@query("str_word_tokens", "SELECT doc_id, md5(array_to_string(list_filter(" + W.format("lower(text)") + r", lambda w: regexp_matches(w, '\p{L}') AND length(w) >= 2), ' ')) AS h FROM documents")
def str_word_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(joined(X.word_tokens(F.col("text"), 2))).alias("h"))


PROPER = r"CASE WHEN regexp_extract({0}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') <> '' THEN regexp_matches(regexp_extract({0}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]'), '[\p{{Lu}}\p{{Lt}}]') ELSE length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 2 END"


@query("str_is_proper", "SELECT doc_id, len(list_filter(" + W.format("text") + ", lambda w: " + PROPER.format("w") + ")) AS n FROM documents")
def str_is_proper(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.filter(X.words(F.col("text")), X.is_proper)).cast("long").alias("n"))


@query("str_proper_words", r"SELECT doc_id, len(regexp_extract_all(text, '\p{Lu}[\p{L}\p{M}\p{N}]*(?:[-''’][\p{L}\p{M}\p{N}]+)*')) AS n FROM documents")
def str_proper_words(spark, sf):
    """Capitalised words with the lower-case parts of their compounds."""
    found = F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}\p{M}\p{N}]*(?:[-'’][\p{L}\p{M}\p{N}]+)*"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.size(found).cast("long").alias("n"))


@query("str_clean", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def str_clean(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.clean(F.col("text"))).alias("h"))


@query("str_content_hash", "SELECT doc_id, substring(sha256(text), 1, 16) AS h FROM documents")
def str_content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("h"))


@query("str_metadata", r"SELECT doc_id, nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 512), '') AS m FROM documents")
def str_metadata(spark, sf):
    return docs(spark, sf).select("doc_id", X.metadata(F.col("text")).alias("m"))


@query("str_split_bytes", "SELECT doc_id, text AS whole FROM documents")
def str_split_bytes(spark, sf):
    """Pieces of at most 700 bytes, put together again."""
    rows = X.split_rows(docs(spark, sf), "doc_id", "text", 700)
    fits = F.forall("p", lambda x: F.octet_length(x) <= 700)
    return rows.where(fits).select("doc_id", F.array_join("p", "").alias("whole"))


# Without lookahead in SQL, the letter behind an initial is kept by a group; twice, as it may be an initial too.
INITIAL = r"'(^|[^\p{L}\p{N}_])([A-ZÀ-Ý])\.(\s+[A-ZÀ-Ý])', '\1\2\3', 'g'"
SAFE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Ms|Dr|St|Mme|Mlle|Prof|Rev|Fr|Sr|Jr|Capt|Gen|Col|Lt)\.', '\1', 'g'), '\bNo\.(\s*\d)', 'No\1', 'g'), " + INITIAL + "), " + INITIAL + ")"


@query("str_sentences", "SELECT doc_id, len(list_filter(regexp_extract_all(" + SAFE + r", '[^.!?…\n]+[.!?…]*'), lambda s: trim(s) <> '')) AS n FROM documents")
def str_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(F.col("text").isNotNull(), F.size(X.sentences(F.col("text")))).cast("long").alias("n"))


@query("str_clauses", r"SELECT item_id, len(list_filter(string_split_regex(text, '[;:,()—]| – |\b(?:and|but|while|whereas|yet)\b'), lambda c: trim(c) <> '')) AS n FROM benchmark")
def str_clauses(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.size(X.clauses(F.col("text"))).cast("long").alias("n"))


FOLD = "CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%ly' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"
CONTENT = ", t AS (SELECT item_id, unnest(" + W.format("lower(text)") + r") AS w FROM benchmark), c AS (SELECT DISTINCT item_id, " + FOLD + r" AS f FROM t WHERE length(w) >= 2 AND regexp_matches(w, '\p{L}') AND w NOT IN " + STOP + ") "


@query("str_fold", "SELECT item_id, md5(string_agg(f, ' ' ORDER BY w)) AS h FROM (SELECT item_id, w, " + FOLD + " AS f FROM (SELECT DISTINCT item_id, unnest(" + W.format("lower(text)") + ") AS w FROM benchmark) u) v GROUP BY 1")
def str_fold(spark, sf):
    w = F.array_sort(F.array_distinct(X.words(F.lower("text"))))
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.md5(joined(F.transform(w, X.fold))).alias("h"))


@query("str_content_words", CONTENT + "SELECT item_id, string_agg(f, ' ' ORDER BY f) AS words FROM c GROUP BY 1")
def str_content_words(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", joined(F.array_sort(X.content_words(F.col("text")))).alias("words"))


STEMS = "(" + "|".join(s for s in X.EVENT_STEMS if len(s) >= 4) + ")"
SHORT = ", ".join(f"'{s}'" for s in X.EVENT_STEMS if len(s) < 4)


@query("str_event_stem", ", t AS (SELECT doc_id, unnest(" + W.format("lower(text)") + f") AS w FROM documents) SELECT doc_id, bool_or(regexp_matches(w, '^{STEMS}') OR w IN ({SHORT})) AS hit FROM t GROUP BY 1")
def str_event_stem(spark, sf):
    rows = docs(spark, sf).select("doc_id", X.words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", X.has_event_stem(F.col("w")).alias("hit"))


PAST = ", ".join(f"'{s}'" for s in X.IRREGULAR_PAST)


@query("str_past_tense", ", t AS (SELECT doc_id, unnest(" + W.format("lower(text)") + f") AS w FROM documents) SELECT doc_id, count(*) AS n FROM t WHERE length(w) >= 4 AND w NOT IN {STOP} AND (w LIKE '%ed' OR w IN ({PAST})) GROUP BY 1")
def str_past_tense(spark, sf):
    n = F.size(X.past_tense(X.words(F.lower("text")))).cast("long")
    return docs(spark, sf).select("doc_id", n.alias("n")).where("n > 0")


@query("str_prolepsis", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '" + X.PROLEPSIS + "'))), '|') AS hits FROM documents")
def str_prolepsis(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.prolepsis(F.col("text")), "|").alias("hits"))


@query("str_foreshadow", "SELECT doc_id, regexp_matches(lower(text), '" + X.FORESHADOW + "') AS hit FROM documents")
def str_foreshadow(spark, sf):
    return docs(spark, sf).select("doc_id", X.foreshadows(F.col("text")).alias("hit"))


# Each document's first two words as a name, with titles, possessives and roles by its number.
FORM = "CASE doc_id % 6 WHEN 0 THEN 'Father ' || w1 WHEN 1 THEN w1 || chr(39) || 's' WHEN 2 THEN 'the ' || w1 || '’s' WHEN 3 THEN 'Mother' || chr(39) || 's ' || w2 WHEN 4 THEN 'An Old ' || w2 || chr(39) ELSE w1 || ' ' || w2 END"
FIRST, SECOND = r"([\p{L}\p{M}\p{N}]+)", r"[\p{L}\p{M}\p{N}]+[^\p{L}\p{M}\p{N}]+([\p{L}\p{M}\p{N}]+)"
NAMES = f"(SELECT doc_id, {FORM} AS form FROM (SELECT doc_id, regexp_extract(text, '{FIRST}', 1) AS w1, regexp_extract(text, '{SECOND}', 1) AS w2 FROM documents) q WHERE w1 <> '' AND w2 <> '') n"


def names(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.regexp_extract("text", FIRST, 1).alias("w1"), F.regexp_extract("text", SECOND, 1).alias("w2"))
    return rows.where("w1 <> '' and w2 <> ''").select("doc_id", F.expr(FORM).alias("form"))


ROLES = ", ".join(f"'{w}'" for w in sorted({*X.ROLE_NOUNS, *X.PRONOUNS}))


@query("str_depossess", f"SELECT form, regexp_replace(lower(form), '(''s|’s|''|’)$', '') AS bare FROM {NAMES}")
def str_depossess(spark, sf):
    return names(spark, sf).select("form", X.depossess(F.lower("form")).alias("bare"))


@query("str_proper_tokens", f"SELECT form, array_to_string(list_filter([regexp_replace(t, '(''s|’s|''|’)$', '') FOR t IN string_split(lower(form), ' ')], lambda t: length(t) >= 2 AND t NOT IN ({ROLES})), ' ') AS tokens FROM {NAMES}")
def str_proper_tokens(spark, sf):
    return names(spark, sf).select("form", joined(X.proper_tokens(F.col("form"))).alias("tokens"))


@query("str_norm_key", f"SELECT form, array_to_string([regexp_replace(t, '(''s|’s|''|’)$', '') FOR t IN string_split(lower(form), ' ')], ' ') AS k FROM {NAMES}")
def str_norm_key(spark, sf):
    return names(spark, sf).select("form", X.name_key(F.col("form")).alias("k"))


HON = ", ".join(f"'{w}'" for w in X.NAME_HONORIFICS)


@query("str_honorific", f"SELECT form, CASE WHEN len(t) = 2 AND t[1] IN ({HON}) AND length(t[2]) >= 2 AND t[2] NOT IN ({ROLES}) THEN t[2] END AS k FROM (SELECT form, [regexp_replace(x, '(''s|’s|''|’)$', '') FOR x IN string_split(lower(form), ' ')] AS t FROM {NAMES}) u")
def str_honorific(spark, sf):
    return names(spark, sf).select("form", X.honorific_key(F.col("form")).alias("k"))


LABEL = "CASE o_orderkey % 6 WHEN 0 THEN 'Father of' WHEN 1 THEN 'the SISTERS relation' WHEN 2 THEN 'mother (daughter) tie' WHEN 3 THEN 'Geschwister ü' WHEN 4 THEN 'brothers ties' ELSE o_orderpriority || ' Relationship' END"


@query("str_label_key", r", n AS (SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(" + LABEL + r"), '\b(relationship|relation|tie)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM orders) SELECT o_orderkey, CASE WHEN k IN ('father of', 'father son') THEN 'father-child' WHEN k IN ('mother of', 'mother son', 'mother daughter') THEN 'mother-child' WHEN k IN ('brother of', 'sister of', 'brothers', 'sisters', 'sibling', 'siblings') THEN 'siblings' ELSE k END AS k FROM n")
def str_label_key(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", X.label_key(F.expr(LABEL)).alias("k"))


@query("str_wrap_names", r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w IN ('the', 'thein'))) AS n FROM documents")
def str_wrap_names(spark, sf):
    """Names marked at Unicode word boundaries, the longest first; a longer name begins with a shorter one here, so words tell their number."""
    listed = ["the hein", "thein", "the"]
    pattern = r"(?<![\p{L}\p{N}])(" + "|".join(sorted(listed, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return docs(spark, sf).select("doc_id", F.regexp_count(F.lower("text"), F.lit(pattern)).alias("n"))


@query("str_href_norm", r"SELECT page_id, url_decode(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', ''), '^(\./|/)+', '')) AS href FROM pages")
def str_href_norm(spark, sf):
    return pages(spark, sf).select("page_id", X.href_norm(F.regexp_replace("url", "^[a-z]+:/", "")).alias("href"))


@query("flt_language", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'und' ELSE lower(lang) || '-x' || CAST(doc_id % 10 AS VARCHAR) END AS tag FROM documents")
def flt_language(spark, sf):
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit("not a tag!")).otherwise(F.concat(F.upper("lang"), F.lit("_x"), (F.col("doc_id") % 10).cast("string")))
    return docs(spark, sf).select("doc_id", X.language_tag(raw).alias("tag"))


@query("flt_book_id", "SELECT doc_id, regexp_matches('bk' || source || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '' END, '^bk[a-z0-9]{1,64}$') AS ok FROM documents")
def flt_book_id(spark, sf):
    raw = F.concat(F.lit("bk"), "source", F.when(F.col("doc_id") % 3 == 0, "-").otherwise(""))
    return docs(spark, sf).select("doc_id", X.book_id_ok(raw).alias("ok"))


@query("math_offset", "SELECT event_id, CAST(CASE WHEN k > 98 THEN NULL WHEN k % 10 = 0 THEN 1000 * k ELSE floor(1000 * k + (least(greatest(event_id % 12, 1), k % 10) - 1) * 1000 / (k % 10)) END AS BIGINT) AS pos FROM reports")
def math_offset(spark, sf):
    page = F.least(F.greatest(F.col("event_id") % 12, F.lit(1)), F.col("k") % 10)
    inside = F.floor(1000 * F.col("k") + (page - 1) * 1000 / (F.col("k") % 10))
    pos = F.when(F.col("k") > 98, F.lit(None)).when(F.col("k") % 10 == 0, 1000 * F.col("k")).otherwise(inside)
    return bind(spark, sf, "reports").select("event_id", pos.cast("long").alias("pos"))


@query("math_usd", "SELECT event_id, CAST(round(1e9 * CASE kind WHEN 'view' THEN k * 0.15e-6 + 7 * 0.60e-6 WHEN 'click' THEN k * 2.5e-6 + 7 * 10e-6 WHEN 'purchase' THEN k * 0.02e-6 ELSE 0 END) AS BIGINT) AS nano_usd FROM reports")
def math_usd(spark, sf):
    """Prices by the first listed model name that the identity holds; unknown models cost nothing."""
    model = F.when(F.col("kind") == "view", "gpt-4o-mini").when(F.col("kind") == "click", "x/gpt-4o").when(F.col("kind") == "purchase", "text-embedding-3-small").otherwise("other")
    # Dollars per input and output token.
    prices = (("gpt-4o-mini", 0.15e-6, 0.60e-6), ("gpt-4o", 2.50e-6, 10.0e-6), ("text-embedding-3-small", 0.02e-6, 0.0))
    usd = F.lit(0.0)
    for name, i, o in reversed(prices):
        usd = F.when(F.contains(model, F.lit(name)), F.col("k") * i + 7 * o).otherwise(usd)
    return bind(spark, sf, "reports").select("event_id", F.round(usd * 1e9).cast("long").alias("nano_usd"))


@query("math_token_estimate", "SELECT doc_id, CAST(strlen(text) + strlen(source) + 64 AS BIGINT) AS tokens FROM documents")
def math_token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", (F.octet_length("text") + F.octet_length("source") + 64).cast("long").alias("tokens"))


@query("json_state", "SELECT state_id, json_extract_string(status_json, '$.status') AS status, CAST(json_extract_string(status_json, '$.rank') AS BIGINT) AS rank FROM states")
def json_state(spark, sf):
    s = F.from_json("status_json", "status string, rank bigint")
    return bind(spark, sf, "states").select("state_id", s["status"].alias("status"), s["rank"].alias("rank"))


@query("json_canonical", "SELECT state_id, '{\"rank\":' || json_extract_string(status_json, '$.rank') || ',\"status\":\"' || json_extract_string(status_json, '$.status') || '\"}' AS j FROM states")
def json_canonical(spark, sf):
    """Keys sorted, separators compact."""
    s = F.from_json("status_json", "rank bigint, status string")
    return bind(spark, sf, "states").select("state_id", F.to_json(s).alias("j"))


@query("arr_roundrobin_index", "SELECT doc_id, array_to_string([CAST(round_even(x * (n_chars - 1) / 5.0, 0) AS BIGINT) FOR x IN range(0, 6)], ',') AS at FROM documents")
def arr_roundrobin_index(spark, sf):
    at = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: F.bround(x * (F.col("n_chars") - 1) / 5.0, 0).cast("long").cast("string"))
    return docs(spark, sf).select("doc_id", F.array_join(at, ",").alias("at"))


@query("uuid_stable", """, h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws(':', source, 'doc', CAST(doc_id AS VARCHAR)))) AS h FROM documents)
SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM h""")
def uuid_stable(spark, sf):
    """UUIDv5 of owner, kind and value: SHA-1 of name space and name, with version and variant set."""
    space = "6ba7b8109dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(F.concat_ws(":", "source", F.lit("doc"), F.col("doc_id").cast("string")), "utf-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble + 1)
    return docs(spark, sf).select("doc_id", F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)).alias("id"))


@query("src_html_text", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS n, regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) AS heading FROM pages")
def src_html_text(spark, sf):
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " ")
    return pages(spark, sf).select("page_id", F.length(body).cast("long").alias("n"), F.regexp_extract("html", r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1).alias("heading"))


