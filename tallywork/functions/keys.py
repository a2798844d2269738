"""Dimension keys, instants as text and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_entries(dimensions: Column) -> Column:
    """Dimensions as an array of entries in key order; null becomes empty.

    Keys are compared by UTF-16 code unit, the order of the wire contract, so
    that the identifiers built from this array agree for every key text. For
    plain ASCII keys, the usual case, that is the order Spark sorts strings in,
    and the array is sorted without a lambda.
    """
    dims = F.coalesce(dimensions, F.create_map().cast("map<string,string>"))
    entries = F.map_entries(dims)
    text = F.concat_ws("", F.map_keys(dims))
    ranked = F.transform(
        entries,
        lambda e: F.struct(
            F.encode(e["key"], "UTF-16BE").alias("rank"),
            e["key"].alias("key"),
            e["value"].alias("value"),
        ),
    )
    unranked = F.transform(
        F.sort_array(ranked),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.sort_array(entries)).otherwise(unranked)


def canonical_dimensions(dimensions: Column) -> Column:
    """The same map with its entries in key order, never null."""
    return F.map_from_entries(sorted_entries(dimensions))


def _pair(entry: Column) -> Column:
    return F.concat(entry["key"], F.lit("="), entry["value"])


def entries_key(entries: Column) -> Column:
    """``k1=v1;k2=v2`` from sorted entries; empty text when there are none."""
    return F.array_join(F.transform(entries, _pair), ";")


def dimension_key(dimensions: Column) -> Column:
    """``k1=v1;k2=v2`` in key order."""
    return entries_key(sorted_entries(dimensions))


def iso_instant(ts: Column) -> Column:
    """ISO-8601 text of a UTC instant with no, three or six fraction digits, as needed."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000).cast("bigint"))
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit("Z"))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3), F.lit("Z")))
        .otherwise(F.concat(F.lit("."), digits, F.lit("Z")))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def name_uuid(text: Column) -> Column:
    """Name-based UUID (version 3, no namespace): MD5 with version and variant bits set."""
    digest = F.md5(text.cast("binary"))
    # The variant digit keeps the two low bits of the digest digit.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    dash = F.lit("-")
    return F.concat(
        F.substring(digest, 1, 8),
        dash,
        F.substring(digest, 9, 4),
        F.lit("-3"),
        F.substring(digest, 14, 3),
        dash,
        variant,
        F.substring(digest, 18, 3),
        dash,
        F.substring(digest, 21, 12),
    )


def charge_id(
    tenant_id: Column,
    meter_code: Column,
    window: Column,
    entries: Column,
    plan_version: Column,
) -> Column:
    """Identifier of a charge, a function of its billing coordinates only.

    The dimension part ends every pair with ``;``, unlike :func:`entries_key`.
    Quantity and amount are left out on purpose: a re-rated reading keeps its id.
    """
    dims = F.concat_ws("", F.transform(entries, lambda e: F.concat(_pair(e), F.lit(";"))))
    return name_uuid(
        F.concat_ws(
            "|",
            tenant_id,
            meter_code,
            iso_instant(window["start"]),
            iso_instant(window["end"]),
            dims,
            plan_version.cast("string"),
        )
    )


def natural_id(*parts: Column) -> Column:
    """Identifier derived from a natural key, stable across retries."""
    return name_uuid(F.concat_ws("|", *[p.cast("string") for p in parts]))


UUID_CUTS = ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))  # first character and length of each part
OTHER = 17  # bytes put behind any other text, which make it longer than the 16 bytes of a UUID


def packed_id(text: Column) -> Column:
    """An identifier in fewer bytes, to shuffle it: a UUID as its 16 bytes, any other text as its own and a mark.

    Different texts have different bytes; null stays null. Parts are cut from bytes, not from
    characters, and outside of branches, where Spark works out what they share once.
    """
    own, dash = text.cast("binary"), F.lit("-").cast("binary")
    is_uuid = (F.octet_length(text) == 36) & (F.lower(text) == text)
    for at, _ in UUID_CUTS[1:]:
        is_uuid = is_uuid & (F.substring(own, at - 1, 1) == dash)
    whole = F.when(is_uuid, own)
    digits = F.concat(*[F.substring(whole, at, n) for at, n in UUID_CUTS]).cast("string")
    return F.coalesce(F.unhex(digits), F.concat(own, F.unhex(F.lit("00" * OTHER))))


def unpacked_id(packed: Column) -> Column:
    """The text of :func:`packed_id`."""
    digits = F.lower(F.hex(F.when(F.octet_length(packed) == 16, packed))).cast("binary")
    parts = [F.substring(digits, at - dashes, n) for dashes, (at, n) in enumerate(UUID_CUTS)]
    dashed = [parts[0], *[x for part in parts[1:] for x in (F.lit("-").cast("binary"), part)]]
    own = F.substring(packed, F.lit(1), F.octet_length(packed) - OTHER)
    return F.coalesce(F.concat(*dashed), own).cast("string")
