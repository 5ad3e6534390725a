"""Column expressions that type an identifier: website, App Store id, Android package, CTV platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard.functions.cells import once, strip

WEBSITE, IOS, ANDROID, CTV = "website", "ios_app", "android_app", "ctv_app"

# Endings that make a value a website.
PRIMARY = ("com", "org", "net", "edu", "gov", "mil", "int")
COUNTRY = ("us", "uk", "de", "fr", "es", "it", "nl", "au", "ca", "jp", "cn", "ru", "br", "in", "kr", "mx", "pl", "se", "ch", "at", "be", "dk", "fi", "no", "nz", "za", "ie", "pt", "cz", "hu", "gr", "ro", "il", "sg", "hk", "tw", "th", "my", "ph", "vn", "id", "ar", "cl")
SEMI_PRIMARY = ("io", "co")
# Endings of websites as well as of packages.
AMBIGUOUS = ("me", "tv", "ai", "app", "dev", "tech", "info", "biz", "xyz", "online", "site", "website", "gg", "fm", "ly", "to", "cc", "ws", "so", "ac", "sh")
# First labels of Android packages.
PACKAGE_FIRST = ("com", "net", "org", "io", "co", "me", "app", "dev", "ai", "tv", "in", "de", "fr", "uk", "jp", "kr", "cn", "ru", "br", "it", "es", "au", "ca")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "file://", "mailto:", "tel:", "sms:", "//")
PUNCTUATION = r"[/:?#&=@!$'()*+,;\[\]%]"
# Spellings of types in a column that states them.
TYPE_SPELLINGS = {
    IOS: ("ios", "ios_app", "iosapp", "iphone", "ipad", "apple", "app store", "appstore", "itunes"),
    ANDROID: ("android", "android_app", "androidapp", "google play", "googleplay", "play store", "playstore", "gplay"),
    WEBSITE: ("website", "web", "web site", "site", "domain", "url", "webpage"),
}


def _one_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def is_website(value: Column) -> Column:
    """Marks that only websites have; `value` is trimmed."""
    low = F.lower(value)
    first = F.regexp_extract(low, "^" + f"({'|'.join(PACKAGE_FIRST)})" + r"\.", 1)
    last = F.regexp_extract(low, r"\." + f"({'|'.join(AMBIGUOUS)})$", 1)
    store_like = last.isin("app", "tech", "ai") & ~first.isin("app", "dev")
    undecided = first.isin("com", "org", "net") | store_like
    ambiguous = (last != "") & ((first == "") | (~undecided & (first != last)))
    return (
        F.lit(False)
        | low.rlike("^(?:" + "|".join(s.replace("/", "\\/") for s in SCHEMES) + "|www\\.|localhost)")
        | value.rlike(PUNCTUATION)
        | value.contains("-")
        | value.rlike(r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}$")
        | low.rlike(r"\." + _one_of((*PRIMARY, *COUNTRY, *SEMI_PRIMARY)) + "$")
        | ambiguous
    )


def is_package(value: Column) -> Column:
    return F.lower(value).rlike(r"^[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+$")


def has_package_first(value: Column) -> Column:
    return F.lower(value).rlike("^" + _one_of(PACKAGE_FIRST) + r"\.")


def is_digits(value: Column) -> Column:
    return value.rlike(r"^\p{Nd}+$")


def leaf(value: Column) -> Column:
    return F.substring_index(F.lower(value), ".", -1)


def typed(value: Column, leaf_is_tld: Column) -> Column:
    """The type of a value, given whether its last label is a top-level domain."""

    def of(x: Column) -> Column:
        v, known = x["v"], x["known"]
        deep = F.size(F.split(v, r"\.")) >= 5
        return (
            F.when(v.isNull() | (v == "") | is_website(v), WEBSITE)
            .when(is_digits(v), IOS)
            .when(is_package(v) & (has_package_first(v) | ~known | deep), ANDROID)
            .otherwise(WEBSITE)
        )

    return once(F.struct(strip(value).alias("v"), leaf_is_tld.alias("known")), of)


def looks_processable(value: Column) -> Column:
    v = strip(value)
    domain = r"^(?:https?://)?[A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,}(?:[/:?#].*)?$"
    return F.coalesce(F.when(is_digits(v), F.length(v) >= 6).otherwise(v.rlike(domain) | (has_package_first(v) & is_package(v))), F.lit(False))


def stated_type(value: Column) -> Column:
    """The type that a spelling states, or NULL."""
    v = F.lower(strip(value))
    out = F.lit(None).cast("string")
    for kind, spellings in TYPE_SPELLINGS.items():
        out = F.when(v.isin(*spellings), kind).otherwise(out)
    return out


def ctv_platform(value: Column) -> Column:
    """Platform by the conventions of bundle ids, first rule wins."""
    v = strip(value)
    low, up = F.lower(v), F.upper(v)
    return (
        F.when(v.isNull() | (v == ""), "Unknown")
        .when(is_digits(v), "Roku")
        .when(up.startswith("B0"), "Fire TV")
        .when(low.startswith("com."), "Android TV")
        .when(low.startswith("vizio."), "Vizio")
        .when(low.startswith("tv."), "Apple TV")
        .when(up.rlike(r"^G\p{Nd}+$"), "Samsung TV")
        .when(v.rlike(r"^9[\p{L}\p{N}]*$"), "Xbox")
        .when(low.endswith(".roku"), "Roku")
        .when(low.startswith("xbox."), "Xbox")
        .when(low.startswith("playstation."), "PlayStation")
        .otherwise("Unknown")
    )
