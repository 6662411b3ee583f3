"""Text functions, keyword features and model answers."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import query, rounded
from kerbside import fixed_values as fixed
from kerbside.functions import text as T
from kerbside.operators import responses as R
from kerbside.operators import text_features as TF
from kerbside.sources import driver_tables as D
from kerbside.sources import rendered as RD

LITRES = "CASE WHEN engine_volume IS NULL THEN 2.5 ELSE engine_volume END::DOUBLE"


@query("title_brand_model", "listings", "SELECT listing_id, brand, model FROM listings")
def _(spark, sf):
    title = F.when(F.col("listing_id") % 2 == 0, F.col("title")).otherwise(
        F.concat(F.col("brand"), F.lit(" (alias) "), F.col("model"), F.lit(", 2019, 45 000 km"))
    )
    brand = T.title_brand(title)
    return D.listings(spark, sf).select(
        "listing_id",
        F.when(F.col("listing_id") % 2 == 0, brand).otherwise(F.replace(brand, F.lit(" (alias)"), F.lit(""))).alias("brand"),
        T.title_model(title).alias("model"),
    )


@query("title_year", "listings", "SELECT listing_id, CASE WHEN listing_id % 5 = 0 THEN 0 ELSE year END AS year FROM listings")
def _(spark, sf):
    title = F.when(F.col("listing_id") % 5 == 0, "Brand 12345 x").otherwise(F.col("title"))
    return D.listings(spark, sf).select("listing_id", T.title_year(title).alias("year"))


@query(
    "title_specs",
    "listings",
    f"SELECT listing_id, {LITRES} AS engine_volume, 'АКПП' AS transmission, mileage FROM listings",
)
def _(spark, sf):
    # thousands are separated by no-break spaces
    km = F.translate(F.format_number(F.col("mileage"), 0), ",", " ")
    title = F.concat_ws(", ", F.col("title"), F.concat(km, F.lit(" км")))
    return D.listings(spark, sf).select(
        "listing_id", T.title_engine_volume(title).alias("engine_volume"), T.title_transmission(title).alias("transmission"),
        T.title_mileage(title).alias("mileage"),
    )


@query(
    "parse_engine",
    "listings",
    f"""
SELECT listing_id, {LITRES} AS engine_volume, power_hp, CASE WHEN listing_id % 2 = 0 THEN 'Бензин' ELSE 'дизель' END AS engine_type
FROM listings
""",
)
def _(spark, sf):
    volume = F.concat(F.coalesce("engine_volume", F.lit(2.5)).cast("string"), F.lit(" л"))
    power = F.concat(F.col("power_hp").cast("string"), F.lit(" л.с."))
    slashed = F.concat_ws(" / ", volume, power, F.lit("Бензин"))
    listed = F.concat_ws(", ", volume, power, F.lit("дизель"))
    even = F.col("listing_id") % 2 == 0
    return (
        D.listings(spark, sf)
        .withColumn("e", F.when(even, T.parse_engine(slashed)).otherwise(T.parse_engine_list(listed)))
        .select("listing_id", "e.engine_volume", "e.power_hp", "e.engine_type")
    )


@query("parse_int_digits", "listings", "SELECT listing_id, CAST(mileage AS BIGINT) AS km FROM listings")
def _(spark, sf):
    return D.listings(spark, sf).select(
        "listing_id", T.digits(F.concat(F.format_number(F.col("mileage"), 0), F.lit(" км"))).alias("km")
    )


@query(
    "parse_bool_words",
    "listings",
    "SELECT listing_id, CASE listing_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cleared FROM listings",
)
def _(spark, sf):
    word = F.when(F.col("listing_id") % 3 == 0, " Растаможен ").when(F.col("listing_id") % 3 == 1, "НЕ растаможен").otherwise("?")
    return D.listings(spark, sf).select("listing_id", T.yes_no(word).alias("cleared"))


@query(
    "displacement_litres",
    None,
    f"SELECT p_partkey, CASE WHEN p_retailprice > 100 THEN {rounded('p_retailprice / 1000', 1)} ELSE p_retailprice END AS litres FROM part",
)
def _(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.displacement_litres(F.col("p_retailprice")).alias("litres"))


@query(
    "color_from_hex",
    "listings",
    """
SELECT color, count(*) AS n FROM (SELECT CASE listing_id % 4 WHEN 0 THEN 'black' WHEN 1 THEN 'white' WHEN 2 THEN 'pink' ELSE '123456' END
  AS color FROM listings) t GROUP BY color
""",
)
def _(spark, sf):
    code = (
        F.when(F.col("listing_id") % 4 == 0, "#040001").when(F.col("listing_id") % 4 == 1, "FAFBFB")
        .when(F.col("listing_id") % 4 == 2, "ff69b4").otherwise("123456")
    )
    return D.listings(spark, sf).groupBy(T.color_from_hex(code).alias("color")).agg(F.count("*").alias("n"))


@query("clean_phone", "listings", "SELECT listing_id, CASE WHEN listing_id % 9 = 0 THEN 'call me' ELSE '7900' || CAST(listing_id AS VARCHAR) END AS phone FROM listings")
def _(spark, sf):
    phone = F.when(F.col("listing_id") % 9 == 0, "call me").otherwise(
        F.concat(F.lit("+7 (900) "), F.col("listing_id").cast("string"))
    )
    return D.listings(spark, sf).select("listing_id", T.clean_phone(phone).alias("phone"))


@query(
    "clean_text",
    None,
    r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN\pM_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents
""",
)
def _(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.clean_text(F.col("description")).alias("cleaned"))


@query("nbsp_normalise", None, "SELECT doc_id, replace(text, chr(160), ' ') AS text FROM documents")
def _(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.nbsp_normalise(F.col("description")).alias("text"))


@query(
    "mask_secrets",
    None,
    r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '(https?://)?([^:@\s]+):([^@\s]+)@([^:\s]+):(\d+)', '\2:***@\4:\5', 'g'),
  '((?:password|pass|token|api[_-]?key|secret|auth|session)["'']?\s*[:=]\s*["''])([^"'']+)(["''])', '\1***\3', 'gi') AS masked
FROM documents
""",
)
def _(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.mask_secrets(F.col("description")).alias("masked"))


@query(
    "seller_type_dealer",
    "listings",
    "SELECT listing_id, listing_id % 3 <> 0 AS dealer FROM listings",
)
def _(spark, sf):
    kind = F.when(F.col("listing_id") % 3 == 0, "частное лицо").when(F.col("listing_id") % 3 == 1, "Автосалон").otherwise("Dealer")
    return D.listings(spark, sf).select("listing_id", T.is_dealer_type(kind).alias("dealer"))


def _with_photos(spark, sf):
    n = F.col("photo_count")
    return D.listings(spark, sf).withColumn(
        "photos",
        F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.col("url"), F.lit("/"), i.cast("string")))),
    )


@query("photo_count", "listings", "SELECT listing_id, photo_count AS photos FROM listings")
def _(spark, sf):
    return _with_photos(spark, sf).select("listing_id", T.photo_count(F.col("photos")).alias("photos"))


@query("first_photo", "listings", "SELECT listing_id, CASE WHEN photo_count > 0 THEN url || '/1' END AS photo FROM listings")
def _(spark, sf):
    return _with_photos(spark, sf).select("listing_id", T.first_photo(F.col("photos")).alias("photo"))


# All keyword patterns, and Latin stand-ins that the documents do hold
PATTERNS = fixed.KEYWORD_PATTERNS | {"kw_one": r"outre|eauou", "kw_two": r"tion\w*\s*en", "kw_three": r"the\s*(?:er|on)", "kw_four": r"zzzz"}
# the SQL engine knows no look-behind; without it a pattern holds no less, and on Latin texts not more
KW_SQL = ", ".join(
    f"CAST(regexp_matches(text, '{re.sub(r'[(][?]<[!=][^)]*[)]', '', p).replace(chr(92) + 'w', '[' + chr(92) + 'pL' + chr(92) + 'pN_]')}', 'i') AS INTEGER) AS {n}"
    for n, p in PATTERNS.items()
)


@query("keyword_features", None, f"SELECT doc_id, {KW_SQL} FROM documents")
def _(spark, sf):
    flags = T.keyword_flags(F.col("description"), PATTERNS)
    return D.documents(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "keyword_support",
    None,
    "WITH k AS (SELECT " + KW_SQL + " FROM documents) SELECT keyword, share, share > 0.01 AS kept FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS keyword, round(avg({n}), 6) AS share FROM k" for n in PATTERNS)
    + ") t",
)
def _(spark, sf):
    return TF.keyword_support(D.documents(spark, sf), "description", PATTERNS)


STAND_IN_FLAGS = {"first": "outre", "second": "THINTION", "third": "inging"}
FLAG_SQL = ", ".join(
    f"CASE WHEN regexp_matches(text, '{p.replace(chr(92) + 'w', '[' + chr(92) + 'pL' + chr(92) + 'pN_]')}', 'i') THEN '{n}' END"
    for n, p in (fixed.CONDITION_FLAGS | STAND_IN_FLAGS).items()
)


@query(
    "condition_flags",
    None,
    f"SELECT flags, count(*) AS n FROM (SELECT concat_ws(',', {FLAG_SQL}) AS flags FROM documents) t GROUP BY flags",
)
def _(spark, sf):
    flags = T.condition_flags(F.col("description"), fixed.CONDITION_FLAGS | STAND_IN_FLAGS)
    return D.documents(spark, sf).groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count("*").alias("n"))


# all stop words, and two that the documents do hold
STOPPED = [*fixed.STOP_WORDS, "the", "les"]


@query(
    "tokenise_text",
    None,
    """
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS w FROM documents)
SELECT w AS token, count(*) AS n FROM t WHERE length(w) > 2 AND w NOT IN ("""
    + ", ".join(f"'{w}'" for w in STOPPED)
    + ") GROUP BY w",
)
def _(spark, sf):
    words = D.documents(spark, sf).select(F.explode(T.tokens(F.col("description"), STOPPED)).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "red_flag_text",
    "text_flags",
    "SELECT doc_id, red_flag, bars_training FROM text_flags",
)
def _(spark, sf):
    return D.text_flags(spark, sf)


# ------------------------------------------------------------------ model answers
SHAPE = "doc_id % 6"


@query(
    "parse_model_response",
    "document_analysis",
    f"""
SELECT doc_id, {SHAPE} NOT IN (4, 5) AS parsed, CASE WHEN {SHAPE} IN (4, 5) THEN 'clean' ELSE category END AS category,
  CASE WHEN {SHAPE} IN (4, 5) THEN 0.3 ELSE confidence END::DOUBLE AS confidence,
  CASE WHEN {SHAPE} IN (4, 5) THEN '' ELSE 'f1,f2' END AS flags,
  CASE WHEN {SHAPE} IN (4, 5) THEN 'parse error' ELSE 'because' END AS reasoning FROM document_analysis
""",
)
def _(spark, sf):
    out = R.parse_model_response(RD.model_responses(spark, sf))
    return out.select("doc_id", "parsed", "category", "confidence", F.array_join("flags", ",").alias("flags"), "reasoning")


@query(
    "repair_truncated_json",
    "document_analysis",
    f"""
SELECT doc_id, {SHAPE} <> 5 AS parsed, CASE WHEN {SHAPE} = 5 THEN 'clean' ELSE category END AS category,
  CASE WHEN {SHAPE} = 5 THEN 'parse error' WHEN {SHAPE} = 4 THEN 'beca' ELSE 'because' END AS reasoning FROM document_analysis
""",
)
def _(spark, sf):
    out = R.parse_model_response(RD.model_responses(spark, sf), repair=True)
    return out.select("doc_id", "parsed", "category", "reasoning")


@query("parse_model_batch_response", "document_analysis", "SELECT CAST(doc_id AS VARCHAR) AS item_id, category, confidence FROM document_analysis")
def _(spark, sf):
    return R.parse_model_batch_response(RD.batch_responses(spark, sf)).select("item_id", "category", "confidence")


@query(
    "resolve_category",
    "document_analysis",
    """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'bad_docs' WHEN 1 THEN 'damaged_body' WHEN 2 THEN 'debtor' WHEN 3 THEN 'complex_but_profitable'
  WHEN 4 THEN 'bad_docs' WHEN 5 THEN 'clean' ELSE category END AS category FROM document_analysis
""",
)
def _(spark, sf):
    doc = F.col("doc_id") % 7
    raw = (
        F.when(doc == 0, "Bad Docs").when(doc == 1, "total junk").when(doc == 2, "owner-debtor").when(doc == 3, "Complex")
        .when(doc == 4, "bad-docs").when(doc == 5, "zzz").otherwise(F.col("category"))
    )
    return D.document_analysis(spark, sf).select("doc_id", R.resolve_category(raw).alias("category"))


# ------------------------------------------------------------------ TF-IDF (the decomposition has no SQL)
STOP_SQL = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


@query(
    "tfidf_terms",
    None,
    f"""
WITH t AS (
  SELECT list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})) AS w FROM documents
), terms AS (
  SELECT unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM t
)
SELECT term, round(ln(((SELECT count(*) FROM t) + 1.0) / (count(*) + 1.0)), 6) AS idf FROM terms GROUP BY term
HAVING count(*) >= 5 AND count(*) <= 0.8 * (SELECT count(*) FROM t)
""",
)
def _(spark, sf):
    terms = TF.term_statistics(D.documents(spark, sf), "description")
    return terms.select("term", F.round("idf", 6).alias("idf"))


_fitted: dict = {}


def features(spark, sf):
    """The decomposition, once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = TF.fit_description_features(D.documents(spark, sf), "description", components=20)
    return _fitted[key]


@query("tfidf_svd_values")
def _(spark, sf):
    out = features(spark, sf).transform(D.documents(spark, sf), "description", "doc_id")
    return out.select("doc_id", *[F.round(F.get("svd", i), 6).alias(f"tfidf_{i}") for i in range(20)])


@query("tfidf_svd", None, "SELECT doc_id, true AS fits_in_row, true AS zero_without_terms FROM documents")
def _(spark, sf):
    """A row of unit length keeps at most its length in the components, and a text without known terms has none."""
    out = features(spark, sf).transform(D.documents(spark, sf), "description", "doc_id")
    kept = F.aggregate("svd", F.lit(0.0), lambda n, x: n + x * x)
    return out.select("doc_id", (kept <= 1 + 1e-9).alias("fits_in_row"), (F.col("has_terms") | (kept == 0)).alias("zero_without_terms"))


@query(
    "svd_explained_variance",
    None,
    "SELECT CAST(range AS INTEGER) AS component, true AS is_share, true AS is_falling, true AS is_what_rows_keep FROM range(20)",
)
def _(spark, sf):
    """Shares of the fitted singular values: each between 0 and 1, falling, and equal to what the projected rows hold."""
    fitted = features(spark, sf)
    out = fitted.transform(D.documents(spark, sf), "description", "doc_id")
    shares = TF.cumulative_explained_variance(TF.explained_variance(fitted, out))
    entries = F.array(*[F.struct(F.lit(c).alias("component"), F.get("svd", c).alias("x")) for c in range(20)])
    kept = out.select("has_terms", F.inline(entries)).groupBy("component").agg((F.sum(F.col("x") * F.col("x")) / F.sum(F.col("has_terms").cast("int"))).alias("kept"))
    before = F.lag("share").over(Window.orderBy("component"))
    return shares.join(kept, "component").select(
        "component", (F.col("share").between(0.0, 1.0) & (F.col("cumulative") <= 1 + 1e-6)).alias("is_share"),
        F.coalesce(before >= F.col("share"), F.lit(True)).alias("is_falling"), (F.abs(F.col("share") - F.col("kept")) < 1e-6).alias("is_what_rows_keep"),
    )


@query(
    "cum_explained_variance",
    None,
    f"""
WITH s AS (SELECT label AS component, sum(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum')) AS v FROM embeddings GROUP BY label),
c AS (SELECT component, v / (SELECT sum(v) FROM s) AS share FROM s)
SELECT component, round(share, 6) AS share, round(sum(share) OVER (ORDER BY component), 6) AS cumulative FROM c
""",
)
def _(spark, sf):
    energy = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sums = D.table(spark, sf, "embeddings").groupBy(F.col("label").alias("component")).agg(F.sum(energy).alias("v"))
    total = sums.agg(F.sum("v")).scalar()
    shares = sums.select("component", (F.col("v") / total).alias("share"))
    return TF.cumulative_explained_variance(shares).withColumn("share", F.round("share", 6))
