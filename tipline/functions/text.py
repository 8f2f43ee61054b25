"""Names, hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(c: Column) -> Column:
    """Lower case, 'and' for '&', letters, digits and blanks only, blanks squeezed."""
    text = F.regexp_replace(F.lower(F.trim(c)), "&", " and ")
    text = F.regexp_replace(text, "[^a-z0-9 ']", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


# Other names of teams, by the name as spelled after evening out.
TEAM_ALIASES = {
    "uconn": "connecticut", "unc": "north carolina", "nc state": "north carolina state", "lsu": "louisiana state", "vcu": "virginia commonwealth", "smu": "southern methodist", "tcu": "texas christian",
    "byu": "brigham young", "unlv": "nevada las vegas", "utep": "texas el paso", "utsa": "texas san antonio", "uab": "alabama birmingham", "ucf": "central florida", "fiu": "florida international",
    "liu": "long island university", "umass": "massachusetts", "usc": "southern california", "ucsd": "california san diego", "ucsb": "california santa barbara", "uci": "california irvine",
    "ucr": "california riverside", "cal": "california", "pitt": "pittsburgh", "ole miss": "mississippi", "miami": "miami florida", "miami fl": "miami florida", "miami oh": "miami ohio",
    "penn": "pennsylvania", "nc": "north carolina", "sc": "south carolina", "the ohio state": "ohio state", "the citadel": "citadel", "st johns": "st john's", "st josephs": "st joseph's",
    "st marys": "st mary's", "st peters": "st peter's", "st bonaventure": "st bonaventure", "massachusetts lowell": "umass lowell", "texas arlington": "ut arlington",
    "texas rio grande valley": "ut rio grande valley", "texas san antonio": "utsa",
}


def team_key(c: Column, aliases: dict[str, str] = TEAM_ALIASES) -> Column:
    """A team's name in one spelling: small letters, 'and' for '&', 'st' apart, letters, digits, blanks and apostrophes only; then its alias, if it is one."""
    text = F.replace(F.replace(F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit("and")), F.lit("st."), F.lit("st ")), F.lit("st  "), F.lit("st "))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s']", ""), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text, F.lit(""))


def row_hash(columns: list[Column], bits: int = 256) -> Column:
    """SHA-2 of all values, joined by '|'; null counts as an empty text, so that no part is skipped."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), bits)


def local_date(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def season(ts: Column) -> Column:
    """The year in which the season ends; a season begins in July."""
    return (F.year(ts) + F.when(F.month(ts) >= 7, 1).otherwise(0)).cast("long")
