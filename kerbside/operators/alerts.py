"""Which user is told about which listing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kerbside.common import MAX_BROADCAST_BYTES, all_of, blank_to_null, settle, table_bytes, union_all

# Cells of a numeric bound: about equally many listings lie in each. Cells come in groups of GROUP.
CELLS, GROUP = 64, 8
# Tasks that share the listings of one cell among the filters without brand, model and city.
SALTS = 16
# Key of a filter field that may be anything, and of a listing without the field.
ANY, NONE = "*", "!"
# Users with at most this many filters have their pairs told apart row by row, without a shuffle of the pairs.
FEW_FILTERS = 8
# A listing carries the users it was sent to while they are at most this many; beyond, its pairs meet the log in a join.
FEW_TOLD = 1_000

#: Columns of an alert; the last ones also say which of several listings at one address is told.
ALERT = ["user_id", "url", "listing_id", "brand", "model", "year", "price", "price_diff_pct", "deal_score"]

# bound -> (filter column, value of a listing, whether the bound is a maximum)
BOUNDS = {
    "price": ("f_max_price", lambda: F.col("price"), True),
    "year": ("f_min_year", lambda: F.col("year"), False),
    "discount": ("f_min_discount", lambda: F.coalesce("price_diff_pct", F.lit(0.0)), False),
    "score": ("f_min_deal_score", lambda: F.col("deal_score"), False),
}


def matches(field: Callable[[str], Column] = lambda name: F.col(f"f_{name}")) -> Column:
    """The whole predicate between a listing and a filter; a NULL or empty filter field means anything."""
    brand, model, city = (blank_to_null(field(name)) for name in ("brand", "model", "city"))
    listing_city = blank_to_null(F.col("city"))
    tests = [
        field("max_price").isNull() | (F.col("price") <= field("max_price")),
        field("min_year").isNull() | (F.col("year") >= field("min_year")),
        field("min_discount").isNull() | (F.coalesce("price_diff_pct", F.lit(0.0)) >= field("min_discount")),
        field("min_deal_score").isNull() | (F.col("deal_score") >= field("min_deal_score")),
        brand.isNull() | (F.lower("brand") == F.lower(brand)),
        model.isNull() | (F.lower("model") == F.lower(model)),
        city.isNull() | listing_city.isNull() | F.contains(F.lower(listing_city), F.lower(city)),
    ]
    return F.coalesce(all_of(tests), F.lit(False))


def cell_limits(rows: DataFrame, values: dict[str, Column]) -> dict[str, list[float]]:
    """CELLS - 1 limits per value between cells with about equally many rows; one small aggregate per task."""
    parts = [i / CELLS for i in range(1, CELLS)]
    found = rows.agg(*[F.percentile_approx(v.cast("double"), parts, 1_000).alias(n) for n, v in values.items()]).first()
    return {n: [float(x) for x in found[n] or []] for n in values}


def cell_of(value: Column, limits: list[float]) -> Column:
    """Number of limits below the value: grows with the value, so it keeps the order of any two values."""
    return F.size(F.filter(F.lit(limits), lambda x: x < value)) if limits else F.lit(0)


def nodes_of(value: Column, limits: list[float]) -> Column:
    """Where a listing is found: its cell, and the group of its cell. NULL, which meets no bound, is nowhere."""
    cell = cell_of(value, limits)
    return F.when(value.isNotNull(), F.array(cell, F.lit(CELLS) + F.floor(cell / GROUP).cast("int")))


def cover(bound: Column, limits: list[float], at_most: bool) -> Column:
    """Cells and groups that together hold every value within the bound, each once."""
    cell = cell_of(bound, limits)
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    if at_most:
        whole = F.floor((cell + 1) / GROUP).cast("int")
        groups, cells = run(F.lit(0), whole - 1), run(whole * GROUP, cell)
    else:
        whole = F.ceil(cell / GROUP).cast("int")
        groups, cells = run(whole, F.lit(CELLS // GROUP - 1)), run(cell, whole * GROUP - 1)
    return F.concat(cells, F.transform(groups, lambda g: g + CELLS))


def share_within(bound: Column, limits: list[float], at_most: bool) -> Column:
    """About which share of the listings lies within the bound."""
    below = cell_of(bound, limits) / CELLS
    return below if at_most else 1 - below


def keyed_filters(filters: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """Filters with one row per key: make, model and city or anything, and the cover of the tightest bound."""
    named = filters.select([F.col(c).alias(f"f_{c}") if c != "user_id" else F.col(c) for c in filters.columns])
    field = lambda c: F.coalesce(F.concat(F.lit("="), F.lower(blank_to_null(F.col(f"f_{c}")))), F.lit(ANY))
    tightness, covers = [], F.array(F.lit(0))
    for bound, (column, _, at_most) in BOUNDS.items():
        number = F.col(column).cast("double")
        share = F.when(number.isNotNull(), share_within(number, limits[bound], at_most))
        tightness.append(F.struct(share.alias("share"), F.lit(bound).alias("bound")))
    known = F.filter(F.array(*tightness), lambda t: t["share"].isNotNull())
    keyed = named.withColumns(
        {"k_brand": field("brand"), "k_model": field("model"), "own_city": field("city"), "k_bound": F.coalesce(F.array_min(known)["bound"], F.lit(ANY))}
    )
    for bound, (column, _, at_most) in BOUNDS.items():
        covers = F.when(F.col("k_bound") == bound, cover(F.col(column).cast("double"), limits[bound], at_most)).otherwise(covers)
    open_to_all = (F.col("k_brand") == ANY) & (F.col("k_model") == ANY) & (F.col("own_city") == ANY)
    cities = F.when(F.col("own_city") == ANY, F.array(F.lit(ANY))).otherwise(F.array("own_city", F.lit(NONE)))
    keyed = keyed.withColumn("k_node", F.explode(covers)).withColumn("k_city", F.explode(cities))
    return keyed.withColumn("k_salt", F.explode(F.sequence(F.lit(0), F.when(open_to_all, F.lit(SALTS - 1)).otherwise(0)))).drop("own_city")


def named_cities(filters: DataFrame) -> DataFrame:
    """(named): the distinct cities of the filters, in lower case."""
    return filters.select(F.lower(blank_to_null(F.col("city"))).alias("named")).filter("named IS NOT NULL").distinct()


def substrings(text: Column) -> Column:
    """All distinct substrings of a short text."""
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.char_length(text) - i + 1), lambda n: F.substr(text, i, n))
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text)))
    return F.array_distinct(F.flatten(F.transform(starts, ends)))


def with_named_city(listings: DataFrame, filters: DataFrame) -> DataFrame:
    """Listings once per city of the filters that their own city contains, as ``named``.

    An equi-join on substrings, done on the distinct cities of a table and on the rows of a stream.
    """
    city = F.lower(blank_to_null(F.col("city")))
    if listings.isStreaming:
        rows = listings.withColumn("named", F.explode(substrings(city)))
        return rows.join(named_cities(filters), "named")
    held = listings.select(city.alias("__city")).filter("__city IS NOT NULL").distinct()
    held = held.withColumn("named", F.explode(substrings(F.col("__city")))).join(named_cities(filters), "named")
    return listings.withColumn("__city", city).join(held, "__city").drop("__city")


def candidate_pairs(listings: DataFrame, filters: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Listings beside the filters that they may match: same make, model and city where named, and the tightest bound.

    An equi-join, not a nested loop. Every filter is keyed by what it names and by cells that cover its tightest bound; a
    listing by what it has, under the kinds of key that some filter uses (at most 60), and by its own cell and group. A
    pair meets under one key only. The cells come from ``profile`` (by default the listings themselves; the filters' own
    bounds for a stream without one); they decide how many candidates there are, not which of them match. Filters that name
    nothing meet the listings of a cell in ``SALTS`` parts, dealt by listing.
    """
    profile = listings if profile is None and not listings.isStreaming else profile
    if profile is not None:
        limits = cell_limits(profile, {b: value() for b, (_, value, _) in BOUNDS.items()})
    else:
        limits = cell_limits(filters, {b: F.col(column[2:]) for b, (column, _, _) in BOUNDS.items()})
    keyed = keyed_filters(filters, limits)
    flag = lambda c: (F.col(c) != ANY).alias(c)
    kinds = keyed.filter(F.col("k_city") != NONE).select(flag("k_brand"), flag("k_model"), flag("k_city"), "k_bound").distinct().collect()
    own = lambda c: F.concat(F.lit("="), F.lower(F.col(c)))
    part = F.pmod(F.xxhash64("listing_id"), F.lit(SALTS)).cast("int")
    # The kind as a number and a hash of the names: keys of fixed size. Names are compared when the filter is tested.
    bounds = [ANY, *BOUNDS]
    named = lambda c: (F.col(c) != ANY).cast("int")
    kind_of = named("k_brand") + 2 * named("k_model") + 4 * named("k_city") + 8 * (F.array_position(F.lit(bounds), F.col("k_bound")).cast("int") - 1)
    keyed = keyed.select(
        *[c for c in keyed.columns if not c.startswith("k_")], kind_of.alias("k_kind"), F.xxhash64("k_brand", "k_model", "k_city").alias("k_names"), "k_node", "k_salt"
    )

    def keys(kind) -> Column:
        """Keys of a listing under one kind; none where the listing lacks what the kind names."""
        brand, model = own("brand") if kind.k_brand else F.lit(ANY), own("model") if kind.k_model else F.lit(ANY)
        city = F.coalesce(F.concat(F.lit("="), F.col("named")), F.lit(NONE)) if kind.k_city else F.lit(ANY)
        salt = part if not (kind.k_brand or kind.k_model or kind.k_city) else F.lit(0)
        nodes = F.array(F.lit(0)) if kind.k_bound == ANY else nodes_of(BOUNDS[kind.k_bound][1]().cast("double"), limits[kind.k_bound])
        number = kind.k_brand + 2 * kind.k_model + 4 * kind.k_city + 8 * bounds.index(kind.k_bound)
        fields = {"k_kind": F.lit(number), "k_names": F.xxhash64(brand, model, city), "k_salt": salt}
        found = F.transform(nodes, lambda n: F.struct(*[v.alias(k) for k, v in fields.items()], n.alias("k_node")))
        return F.when(brand.isNotNull() & model.isNotNull(), found)

    def offered(rows: DataFrame, some: list) -> DataFrame:
        every = F.flatten(F.filter(F.array(*[keys(k) for k in some]), lambda k: k.isNotNull()))
        return rows.withColumn("k", F.explode(every)).select(*listings.columns, "k.*")

    plain, by_city = [k for k in kinds if not k.k_city], [k for k in kinds if k.k_city]
    parts = [offered(listings.withColumn("named", F.lit(None).cast("string")), plain)] if plain else []
    if by_city:
        nowhere = listings.filter(blank_to_null(F.col("city")).isNull()).withColumn("named", F.lit(None).cast("string"))
        parts += [offered(with_named_city(listings, filters), by_city), offered(nowhere, by_city)]
    if not parts:
        parts = [offered(listings.filter(F.lit(False)).withColumn("named", F.lit(None).cast("string")), [_NO_KIND])]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.join(keyed, ["k_kind", "k_names", "k_node", "k_salt"])


_NO_KIND = Row(k_brand=False, k_model=False, k_city=False, k_bound=ANY)


def numbered_filters(filters: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Filters of users with few of them, each beside the user's ``earlier`` ones; the other filters, if any; the most that
    stand beside one. Repeated filters count once."""
    fields = [c for c in filters.columns if c != "user_id"]
    once = filters.distinct()
    busy = settle(once.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > FEW_FILTERS).select(F.col("user_id").alias("__busy")))
    many = None
    if not busy.isEmpty():
        many = once.join(busy, F.col("user_id").eqNullSafe(F.col("__busy")), "left_semi")
        once = once.join(busy, F.col("user_id").eqNullSafe(F.col("__busy")), "left_anti")
    own = once.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("own"))  # at most FEW_FILTERS
    few = settle(own.select("user_id", "own", F.posexplode("own").alias("at", "f")).select("user_id", "f.*", F.slice("own", 1, F.col("at")).alias("earlier")))
    return few, many, few.agg(F.coalesce(F.max(F.size("earlier")), F.lit(0))).first()[0]


def first_matches(listings: DataFrame, filters: DataFrame, profile: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Matching (user, listing) rows in two parts: those that occur once per user and ``key``, and those that may repeat.

    A pair is told under the first filter of the user that it matches, which is seen on the row itself, so the pairs are not
    shuffled. Pairs of users with many filters, and of listings that share their ``key``, may repeat; None if there are none.
    """
    profile = listings if profile is None else profile
    few, many, most = numbered_filters(filters)
    shared = settle(listings.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).filter("n > 1").select("__key"))
    loose = [matching_pairs(listings, many, profile)] if many is not None else []
    if not shared.isEmpty():
        same = F.col(key).eqNullSafe(F.col("__key"))
        loose.append(matching_pairs(listings.join(shared, same, "left_semi"), few, profile))
        listings = listings.join(shared, same, "left_anti")
    return matching_pairs(listings, few, profile, most), union_all(loose) if loose else None


def matching_pairs(listings: DataFrame, filters: DataFrame, profile: DataFrame | None, earlier: int = 0) -> DataFrame:
    """(user, listing) per filter that matches and, of ``numbered_filters``, none of whose ``earlier`` ones does."""
    wanted = matches()
    for i in range(earlier):
        before = F.get("f_earlier", F.lit(i))
        wanted = wanted & ~((F.size("f_earlier") > i) & matches(lambda name: before[name]))  # noqa: B023
    return candidate_pairs(listings, filters, profile).filter(wanted).select("user_id", *listings.columns)


def filter_match_join(listings: DataFrame, filters: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(user, listing) rows with at least one matching filter: the candidates that pass the whole filter."""
    once, repeated = first_matches(listings, filters, profile, "listing_id")
    return once if repeated is None else once.unionByName(repeated.dropDuplicates(["user_id", "listing_id"]))


def without_muted(matched: DataFrame, muted: DataFrame) -> DataFrame:
    """Drop rows whose brand the user muted (muted brands are stored in lower case)."""
    quiet = settle(muted.select("user_id", F.col("brand").alias("__brand")).distinct())
    if table_bytes(quiet) <= MAX_BROADCAST_BYTES:
        quiet = F.broadcast(quiet)
    return (
        matched.withColumn("__brand", F.lower("brand")).join(quiet, ["user_id", "__brand"], "left_anti").drop("__brand")
    )


def with_told(listings: DataFrame, sent: DataFrame) -> DataFrame:
    """Listings with the users their address was sent to in ``__told``; ``__widely`` if they are too many to carry."""
    by_url = sent.groupBy("url").agg(F.count("*").alias("n"))
    widely = settle(by_url.filter(F.col("n") > FEW_TOLD).select("url", F.lit(True).alias("__widely")))
    few = sent.select("user_id", "url").join(widely, "url", "left_anti")
    told = few.groupBy("url").agg(F.collect_set("user_id").alias("__told"))  # at most FEW_TOLD
    return listings.join(told, "url", "left").join(widely, "url", "left").withColumn("__widely", F.coalesce("__widely", F.lit(False)))


def untold(matched: DataFrame, sent: DataFrame) -> DataFrame:
    """Matches of ``with_told`` listings without those already sent to the user, by address."""
    fresh = matched.filter(~F.coalesce(F.array_contains("__told", F.col("user_id")), F.lit(False))).drop("__told")
    rest = fresh.filter("NOT __widely").drop("__widely")
    if sent.groupBy("url").count().filter(F.col("count") > FEW_TOLD).isEmpty():
        return rest
    return rest.unionByName(without_sent(fresh.filter("__widely").drop("__widely"), sent))


def without_sent(matched: DataFrame, sent: DataFrame) -> DataFrame:
    """Drop rows already sent to the user, by address."""
    return matched.join(sent.select("user_id", "url"), ["user_id", "url"], "left_anti")


def unsent_matches(listings: DataFrame, filters: DataFrame, sent: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``without_sent`` of ``filter_match_join``: what was sent is looked up per listing, the pairs are not shuffled for it."""
    told = with_told(listings, sent)
    return untold(filter_match_join(told, filters, listings if profile is None else profile), sent)


def served(listings: DataFrame, filters: DataFrame, users: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Listings that are no duplicates, filters of active users."""
    if users is not None:
        filters = filters.join(users.filter("is_active").select("user_id"), "user_id", "left_semi")
    return listings.filter(~F.col("is_duplicate")) if "is_duplicate" in listings.columns else listings, filters


def unmuted_matches(
    listings: DataFrame, filters: DataFrame, muted: DataFrame, users: DataFrame | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """The columns of an alert for every match, some more than once; a stream stays a stream.

    Duplicates of listings are not offered, inactive users not served, muted makes left out.
    """
    fresh, filters = served(listings, filters, users)
    few, many, most = numbered_filters(filters)
    pairs = matching_pairs(fresh, few, profile, most) if many is None else matching_pairs(fresh, filters, profile)
    return without_muted(pairs, muted).select(*ALERT)


def alerts(
    listings: DataFrame, filters: DataFrame, muted: DataFrame, sent: DataFrame, users: DataFrame | None = None, profile: DataFrame | None = None
) -> DataFrame:
    """One row per (user, address) to notify: the smallest of the listings that match."""
    fresh, filters = served(listings, filters, users)
    offered = settle(with_told(fresh.select(*ALERT[1:], "city"), sent))
    once, repeated = first_matches(offered, filters, fresh if profile is None else profile, "url")
    tell = lambda pairs: untold(without_muted(pairs, muted), sent).select(*ALERT)
    if repeated is None:
        return tell(once)
    first = F.min(F.struct(*ALERT[2:]))
    return tell(once).unionByName(tell(repeated).groupBy("user_id", "url").agg(first.alias("a")).select("user_id", "url", "a.*"))


def user_alert_stats(filters: DataFrame, sent: DataFrame) -> DataFrame:
    """Filters and alerts per user."""
    by_filter = filters.groupBy("user_id").agg(F.count("*").alias("filters"))
    by_alert = sent.groupBy("user_id").agg(F.count("*").alias("alerts"))
    zero = F.lit(0).cast("bigint")
    return by_filter.join(by_alert, "user_id", "full").select(
        "user_id", F.coalesce("filters", zero).alias("filters"), F.coalesce("alerts", zero).alias("alerts")
    )
