"""Symbols of venues: split, check, canonical form and instrument ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange names and their MIC.
US_MICS = {
    "NASDAQ": "XNAS", "NAS": "XNAS", "XNAS": "XNAS", "NYSE": "XNYS", "XNYS": "XNYS", "NYSE ARCA": "ARCX", "ARCA": "ARCX", "ARCX": "ARCX",
    "NYSE AMERICAN": "XASE", "AMEX": "XASE", "XASE": "XASE", "CBOE": "BATS", "BATS": "BATS",
}
CN_VENUES, HK_VENUES = ["XSHG", "XSHE"], ["XHKG"]


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def split_symbol(symbol: Column) -> Column:
    """Struct of venue and code of MIC:code, SHxxxxxx, SZxxxxxx, code.SH/.SS, code.SZ and code.HK; else no venue."""
    return bound(F.struct(F.upper(F.trim(symbol)).alias("said"), F.trim(symbol).alias("given")), lambda s: _split(s["said"], s["given"]))


def _split(said: Column, given: Column) -> Column:
    prefixed = F.length(said) == 8
    rules = [
        (said.contains(":"), F.substring_index(said, ":", 1), F.regexp_replace(said, "^[^:]*:", "")),
        (prefixed & said.startswith("SH"), F.lit("XSHG"), F.substring(said, 3, 6)),
        (prefixed & said.startswith("SZ"), F.lit("XSHE"), F.substring(said, 3, 6)),
        (said.rlike(r"\.S[HS]$"), F.lit("XSHG"), F.regexp_replace(said, r"\.S[HS]$", "")),
        (said.endswith(".SZ"), F.lit("XSHE"), F.regexp_replace(said, r"\.SZ$", "")),
        (said.endswith(".HK"), F.lit("XHKG"), F.regexp_replace(said, r"\.HK$", "")),
    ]
    venue, code = F.lit(None).cast("string"), given
    for test, v, c in reversed(rules):
        venue, code = F.when(test, v).otherwise(venue), F.when(test, c).otherwise(code)
    return F.struct(venue.alias("venue"), code.alias("code"))


def regional_symbol(region: Column, venue: Column, symbol: Column) -> Column:
    """Struct of venue, code, canonical and issue of a CN or HK symbol; the venue is never guessed."""

    def padded(p: Column) -> Column:
        code = F.when((region == "HK") & p["own"]["code"].rlike("^[0-9]{1,5}$"), F.lpad(p["own"]["code"], 5, "0")).otherwise(p["own"]["code"])
        return F.struct(p["own"]["venue"].alias("own"), p["given"].alias("given"), F.coalesce(p["own"]["venue"], p["given"]).alias("used"), code.alias("code"))

    def judged(p: Column) -> Column:
        issue = (
            F.when(p["own"].isNotNull() & (p["given"] != "") & (p["given"] != p["own"]), "venue_conflict")
            .when(~region.isin("CN", "HK"), "unsupported_region")
            .when(((region == "CN") & ~p["used"].isin(CN_VENUES)) | ((region == "HK") & ~p["used"].isin(HK_VENUES)), "unsupported_venue")
            .when(((region == "CN") & ~p["code"].rlike("^[0-9]{6}$")) | ((region == "HK") & ~p["code"].rlike("^[0-9]{5}$")), "malformed_code")
        )
        return F.struct(p["used"].alias("used"), p["code"].alias("code"), issue.alias("issue"))

    start = F.struct(split_symbol(symbol).alias("own"), F.upper(F.trim(F.coalesce(venue, F.lit("")))).alias("given"))
    return bound(bound(bound(start, padded), judged), _result)


def _result(p: Column) -> Column:
    good = p["issue"].isNull()
    return F.struct(F.when(good, p["used"]).alias("venue"), F.when(good, p["code"]).alias("code"), F.when(good, F.concat_ws(":", p["used"], p["code"])).alias("canonical"), p["issue"].alias("issue"))


def us_mic(exchange: Column) -> Column:
    """MIC of an exchange name; unknown names give null."""
    key = F.regexp_replace(F.translate(F.upper(F.trim(exchange)), "_-", "  "), r"\s+", " ")
    return F.create_map(*[F.lit(x) for kv in US_MICS.items() for x in kv])[key]


def us_symbol(symbol: Column, exchange: Column) -> Column:
    """Struct of venue, code, canonical and issue of a US symbol, with a MIC of its own or an exchange."""

    def parted(p: Column) -> Column:
        own = p["said"].contains(":")
        venue = F.when(own, F.upper(F.trim(F.substring_index(p["said"], ":", 1)))).otherwise(p["mic"])
        code = F.upper(F.trim(F.when(own, F.regexp_replace(p["said"], "^[^:]*:", "")).otherwise(p["said"])))
        return F.struct(own.alias("own"), p["mic"].alias("mic"), venue.alias("used"), code.alias("code"))

    def judged(p: Column) -> Column:
        issue = (
            F.when(p["code"].isNull() | (p["code"] == ""), "empty_symbol")
            .when(~p["own"] & exchange.isNull(), "exchange_required")
            .when(exchange.isNotNull() & p["mic"].isNull(), "unsupported_exchange")
            .when(p["own"] & ~p["used"].isin(sorted(set(US_MICS.values()))), "unsupported_exchange")
            .when(p["own"] & exchange.isNotNull() & (p["mic"] != p["used"]), "ambiguous_alias")
        )
        return F.struct(p["used"].alias("used"), p["code"].alias("code"), issue.alias("issue"))

    start = F.struct(F.trim(symbol).alias("said"), us_mic(exchange).alias("mic"))
    return bound(bound(bound(start, parted), judged), _result)


def canonical_symbol(symbol: Column) -> Column:
    """MIC:LOCAL in upper case, or null if the MIC is not four letters or digits or there is no local part."""
    said = F.trim(symbol)
    mic, local = F.upper(F.trim(F.substring_index(said, ":", 1))), F.upper(F.trim(F.substring_index(said, ":", -1)))
    return F.when(said.rlike("^[^:]*:[^:]*$") & mic.rlike("^[A-Z0-9]{4}$") & (local != ""), F.concat_ws(":", mic, local))


def us_instrument_id(first_symbol: Column, first_day: Column) -> Column:
    return F.concat(F.lit("ins_us_"), F.substring(F.sha2(F.concat(canonical_symbol(first_symbol), first_day.cast("string")), 256), 1, 16))


#: The digits of lower-case base32.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def instrument_id(region: Column, key: Column) -> Column:
    """ins_ and 26 characters of the lower-case base32 SHA-256 of region|key, cut from the hash by fives of bits."""
    said = F.sha2(F.concat(region, F.lit("|"), key), 256)
    signs = []
    for n in range(26):
        first = 5 * n // 4  # the hexadecimal digit in which the five bits begin
        two = F.conv(F.substring(said, first + 1, 2), 16, 10).cast("int")
        place = F.shiftright(two, 3 - 5 * n % 4).bitwiseAND(31)
        signs.append(F.substring(F.lit(BASE32), place + 1, F.lit(1)))
    return F.concat(F.lit("ins_"), *signs)


def us_alias(symbol: Column, exchange: Column, first_symbol: Column, first_day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Struct of an alias: its symbol as it came and as it counts, the instrument's id, its days and what is wrong with it."""
    own = us_symbol(symbol, exchange)
    issue = F.coalesce(own["issue"], F.when(canonical_symbol(first_symbol).isNull(), "malformed_first_symbol").when(valid_to <= valid_from, "empty_range"))
    return F.struct(
        F.trim(symbol).alias("source_symbol"), own["venue"].alias("venue_mic"), own["code"].alias("local_symbol"), own["canonical"].alias("canonical_symbol"),
        us_instrument_id(first_symbol, first_day).alias("instrument_id"), valid_from.alias("valid_from"), valid_to.alias("valid_to"), issue.alias("issue"),
    )


def days_overlap(left_from: Column, left_to: Column, right_from: Column, right_to: Column) -> Column:
    """Half-open ranges overlap; no end means open."""
    far = F.lit("9999-12-31").cast("date")
    return (left_from < F.coalesce(right_to, far)) & (right_from < F.coalesce(left_to, far))
