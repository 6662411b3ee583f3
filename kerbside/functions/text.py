"""Column functions on titles, free text and addresses. All run as built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import blank_to_null, contains_any, let, lookup


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when the pattern does not occur."""
    return let(F.regexp_extract(text, pattern, group), blank_to_null)


def first_found(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    return F.coalesce(*[found(text, p, group) for p in patterns])


def title_brand(title: Column) -> Column:
    return _brand_and_model(title)[0]


def title_model(title: Column) -> Column:
    return _brand_and_model(title)[1]


def _brand_and_model(title: Column) -> tuple[Column, Column]:
    head = F.split(title, r"(?U),\s*\d{4}", 2)[0]
    head = F.trim(F.split(head, r"(?U)\d+\.\d+\s*(?:AT|MT|CVT|AMT)", 2)[0])
    with_alias = r"(?s)^(.+?\([^)]+\))\s+(.*)"
    first_word = found(head, r"(?U)^(\S+)")
    brand = F.when(
        F.regexp_like(head, F.lit(with_alias)), F.trim(F.regexp_extract(head, with_alias, 1))
    ).otherwise(F.coalesce(first_word, F.trim(title)))
    model = F.when(
        F.regexp_like(head, F.lit(with_alias)), F.trim(F.regexp_extract(head, with_alias, 2))
    ).otherwise(F.trim(F.regexp_extract(head, r"(?Us)^\S+\s+(.*)$", 1)))
    return brand, model


def card_title_brand_model(title: Column) -> tuple[Column, Column]:
    """Variant for card pages: the name ends at the first decimal number, parentheses have no meaning."""
    head = F.split(title, r"(?U),\s*\d{4}", 2)[0]
    head = F.trim(F.split(head, r"\d+\.\d+", 2)[0])
    brand = F.coalesce(found(head, r"(?U)^(\S+)"), title)
    return brand, F.trim(F.regexp_extract(head, r"(?Us)^\S+\s+(.*)$", 1))


def title_year(title: Column) -> Column:
    return F.coalesce(F.try_to_number(found(title, r"(?U)\b((?:19|20)\d{2})\b"), F.lit("9999")).cast("int"), F.lit(0))


def title_engine_volume(title: Column) -> Column:
    return found(title, r"(?U)(\d+\.\d+)\s*(?:AT|MT|CVT|AMT)").try_cast("double")


def title_transmission(title: Column) -> Column:
    return lookup(found(title, r"(?U)\d+\.\d+\s*(AT|MT|CVT|AMT)"), fixed.TITLE_TRANSMISSION)


def title_mileage(title: Column) -> Column:
    return F.regexp_replace(found(title, r"(?U)(\d[\d\s]+)\s*(?:км|km)"), r"(?U)\s", "").try_cast("int")


def litres(text: Column) -> Column:
    """Decimal number with either separator, e.g. 2.0 or 2,0."""
    return F.replace(found(text, r"(\d+[.,]\d+)"), F.lit(","), F.lit(".")).try_cast("double")


def horse_power(text: Column) -> Column:
    return found(text, r"(?U)(\d+)\s*л\.?\s*с").try_cast("int")


def parse_engine(text: Column, separator: str = "/") -> Column:
    """Compound engine text -> struct(engine_volume, power_hp, engine_type).

    The parts are scanned in order; a part that gives the volume is not read again for power.
    """
    parts = F.transform(F.split(text, separator), lambda p: F.trim(p))
    volumes = F.filter(parts, lambda p: F.regexp_like(p, F.lit(r"\d+[.,]\d+")) & ~F.contains(p, F.lit("л.с")))
    volume_part = F.try_element_at(volumes, F.lit(1))
    powers = F.filter(
        parts,
        lambda p: F.regexp_like(p, F.lit(r"(?U)\d+\s*л\.?\s*с")) & ~p.eqNullSafe(volume_part),
    )
    fuels = F.filter(parts, lambda p: F.lower(p).isin(fixed.FUELS))
    return F.struct(
        litres(volume_part).alias("engine_volume"),
        horse_power(F.try_element_at(powers, F.lit(1))).alias("power_hp"),
        F.try_element_at(fuels, F.lit(1)).alias("engine_type"),
    )


def parse_engine_list(text: Column) -> Column:
    """Comma-separated variant; here the last fuel named wins."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    fuels = F.filter(parts, lambda p: F.lower(p).isin(fixed.FUELS))
    return F.struct(
        F.replace(found(text, r"(?U)(\d+[.,]\d+)\s*л"), F.lit(","), F.lit(".")).try_cast("double").alias("engine_volume"),
        horse_power(text).alias("power_hp"),
        F.try_element_at(fuels, F.lit(-1)).alias("engine_type"),
    )


def digits(text: Column) -> Column:
    """All digits as one number; NULL when there are none."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def yes_no(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(fixed.YES_WORDS), True).when(word.isin(fixed.NO_WORDS), False)


def yes_no_short(text: Column) -> Column:
    """Card-page variant: two words mean yes, any other text means no."""
    return F.when(blank_to_null(text).isNotNull(), F.lower(F.trim(text)).isin("да", "растаможен"))


def displacement_litres(cc: Column) -> Column:
    return F.when(cc > 100, F.round(cc / 1000, 1)).otherwise(cc.cast("double"))


def color_from_hex(code: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.ltrim(code, F.lit("#"))), fixed.COLOR_BY_HEX), code)


def _slug(url: Column, site: str) -> Column:
    host = site.replace(".", r"\.")
    path = found(url, rf"(?U)^https?://auto\.{host}/(\w+)/")
    subdomain = found(url, rf"(?U)^https?://(\w+)\.{host}/")
    return F.coalesce(path, F.when(subdomain != "auto", subdomain))


def city_from_url(url: Column, site: str) -> Column:
    """City from the path of a card address or the sub-domain of a list address of ``site``."""
    slug = _slug(url, site)
    return F.coalesce(lookup(slug, fixed.CITY_BY_SLUG), F.initcap(slug))


def region_from_url(url: Column, site: str) -> Column:
    slug = _slug(url, site)
    return F.coalesce(lookup(slug, fixed.REGION_BY_SLUG), lookup(slug, fixed.CITY_BY_SLUG))


def clean_phone(phone: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_replace(phone, r"\D", "")), phone)


def clean_text(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.coalesce(F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")), F.lit(""))


def nbsp_normalise(text: Column) -> Column:
    return F.coalesce(F.translate(text, "\u00a0", " "), F.lit(""))


# What is masked in a configuration text, in this order.
SECRET_PATTERNS = [
    (r"(?:https?://)?([^:@\s]+):([^@\s]+)@([^:\s]+):(\d+)", "$1:***@$3:$4"),
    (r"""(tg_token["']?\s*[:=]\s*["'])([^"']+)(["'])""", "$1***$3"),
    (r"""(tg_chat_id["']?\s*[:=]\s*)(\[?[^\]]*\]?)""", "$1***"),
    (r"""(proxy_change_url["']?\s*[:=]\s*["'])(?:[^"']*?(https?://[^/"']+)[^"']*)(["'])""", "$1$2/***$3"),
    (r"""(proxy_change_url["']?\s*[:=]\s*["'])(?![^"']*https?://[^/"'])([^"']+)(["'])""", "$1***$3"),
    (
        r"""(?i)((?:password|pass|token|api[_-]?key|secret|auth|session)["']?\s*[:=]\s*["'])([^"']+)(["'])""",
        "$1***$3",
    ),
]


def mask_secrets(text: Column) -> Column:
    return reduce(lambda col, rule: F.regexp_replace(col, rule[0], rule[1]), SECRET_PATTERNS, text)


def is_dealer_type(seller_type: Column) -> Column:
    return contains_any(F.lower(seller_type), fixed.DEALER_WORDS)


def photo_count(photos: Column) -> Column:
    return F.coalesce(F.array_size(photos), F.lit(0))


def first_photo(photos: Column) -> Column:
    return F.try_element_at(photos, F.lit(1))


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at ``|`` outside groups and classes."""
    return _parts(pattern)[0]


def groups(branch: str) -> list[str]:
    """The contents of the groups of a branch that every match goes through."""
    return _parts(branch)[1]


def _parts(pattern: str) -> tuple[list[str], list[str]]:
    alternatives, inside, depth, start, opened, i = [], [], 0, 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i)
        elif c == "(":
            opened, depth = (i if not depth else opened), depth + 1
        elif c == ")":
            depth -= 1
            group = pattern[opened + 1 : i]
            if not depth and pattern[i + 1 : i + 2] not in ("?", "*", "{") and not group.startswith(("?<", "?=", "?!")):
                inside.append(group.removeprefix("?:"))
        elif c == "|" and not depth:
            alternatives.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*alternatives, pattern[start:]], inside


def stem(branch: str) -> str:
    """The longest run of letters or digits outside groups that every match of the branch holds, in lower case; may be empty."""
    plain = re.sub(r"\\.", "\0", branch)
    while plain != (inner := re.sub(r"\[[^\]]*\]|\([^()\[\]]*\)", "\0", plain)):
        plain = inner
    # what may be left out does not count: a letter before ?, * or {
    plain = re.sub(r".[?*{]", "\0", plain)
    return max(re.findall(r"[^\W_]+", plain), key=len, default="").lower()


def stems(pattern: str) -> list[str]:
    """Literals of which every match of the pattern holds at least one; none where a branch has no literal of two letters."""
    found = set()
    for branch in branches(pattern):
        own = stem(branch)
        some = [own] if len(own) > 1 else next((x for x in map(stems, groups(branch)) if x), [])
        if not some:
            return []
        found.update(some)
    return sorted(found)


def folded(text: Column) -> Column:
    """Text in which a stem is found wherever a pattern that ignores case would match it: upper and then lower case."""
    # the dotted capital would become two characters; its replacement also keeps the two conversions from being merged into one
    return F.lower(F.replace(F.upper(F.coalesce(text, F.lit(""))), F.lit("İ"), F.lit("I")))


def pattern_hits(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Whether each pattern occurs, Unicode-aware and in any case.

    A pattern is tried only on texts that hold one of its stems; the folded text is worked out once for all patterns.
    """
    filled, low = F.coalesce(text, F.lit("")), folded(text)
    hits = {}
    for name, pattern in patterns.items():
        hit = F.regexp_like(filled, F.lit(f"(?iuU){pattern}"))
        hits[name] = contains_any(low, stems(pattern)) & hit if stems(pattern) else hit
    return hits


def keyword_flags(text: Column, patterns: dict[str, str] = fixed.KEYWORD_PATTERNS) -> dict[str, Column]:
    """One 0/1 column per pattern; Unicode-aware and case-insensitive."""
    return {name: hit.cast("int") for name, hit in pattern_hits(text, patterns).items()}


def condition_flags(text: Column, patterns: dict[str, str] = fixed.CONDITION_FLAGS) -> Column:
    """Array of the flags whose pattern occurs in the text."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in pattern_hits(text, patterns).items()]))


def tokens(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Lower-case word list without stop words and words of one or two letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([а-яёa-z0-9]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(list(stop_words)) & (F.length(w) > 2))


def red_flag_hit(
    text: Column,
    phrases: Sequence[str] = fixed.DEAL_RED_FLAGS,
    negatable: Sequence[str] = fixed.DAMAGE_WORDS,
    negations: Sequence[str] = fixed.NEGATIONS,
) -> Column:
    """True when a red-flag phrase occurs, or a damage word whose first occurrence is not negated just before."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def damaged(word: str) -> Column:
        at = F.locate(word, lowered)
        before = F.substring(lowered, F.greatest(at - 4, F.lit(1)), F.least(at - 1, F.lit(4)))
        return (at > 0) & ~contains_any(before, negations)

    hits = [contains_any(lowered, phrases)] + [damaged(w) for w in negatable]
    return reduce(lambda a, b: a | b, hits)
