"""Feeds of nested JSON whose shape varies: parsed once into the variant type, then read along alternative paths. Text that is no JSON gives null, a node of another
kind than asked for counts as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipline.functions.columns import num, whole


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once for each row: within lambdas Spark works an expression out wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(v: Column, paths: str, kind: str = "string") -> Column:
    """The first value found along the paths (separated by blanks, from the node itself); objects and lists are no value of a plain kind."""
    plain = F.lit(True)
    found = []
    for p in paths.split():
        path = "$" if p == "." else f"$.{p}"
        if kind == "string":
            plain = ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(True))
        found.append(F.when(plain, F.try_variant_get(v, path, kind)))
    return F.coalesce(*found)


def some(v: Column, paths: str) -> Column:
    """The first text along the paths that says something: neither empty, 0 nor false."""
    texts = [read(v, p) for p in paths.split()]
    return F.coalesce(*[F.when(~t.isin("", "0", "0.0", "false"), t) for t in texts])


def _read(v: Column, paths: str, kind: str = "string") -> Column:
    """read() for use in lambdas. The first value found along the paths (separated by blanks, from the node itself); objects and lists are no value of a plain kind."""
    def plain(node: Column) -> Column:
        return F.when(~F.coalesce(F.schema_of_variant(node).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(True)), F.try_variant_get(node, "$", kind))

    at = ["$" if p == "." else f"$.{p}" for p in paths.split()]
    return F.coalesce(*[_bound(F.try_variant_get(v, p, "variant"), plain) if kind == "string" else F.try_variant_get(v, p, kind) for p in at])


def _some(v: Column, paths: str) -> Column:
    """some() for use in lambdas. The first text along the paths that says something: neither empty, 0 nor false."""
    return F.coalesce(*[_bound(_read(v, p), lambda t: F.when(~t.isin("", "0", "0.0", "false"), t)) for p in paths.split()])


def items(v: Column, paths: str) -> Column:
    """The list found first along the paths, as an array of variants; empty if there is none."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}" if p != "." else "$", "array<variant>") for p in paths.split()], F.array().cast("array<variant>"))


def stat_map(statistics: Column) -> Column:
    """Name to shown value, from a list of {name, displayValue} or of {labels or keys, stats}: lists of unequal length are cut to the shorter. A statistic is found
    under each of its names; of equal names the last one counts."""
    names = "name abbreviation shortDisplayName displayName label"

    def table(z: Column) -> Column:
        n = F.least(F.size(z["k"]), F.size(z["v"]))
        pairs = F.arrays_zip(F.slice(z["k"], 1, n).alias("k"), F.slice(z["v"], 1, n).alias("v"))
        return F.when(n > 0, F.transform(pairs, lambda p: F.struct(p["k"].try_cast("string").alias("k"), p["v"].try_cast("string").alias("v"))))

    def entries(item: Column) -> Column:
        labels = _bound(items(item, "labels"), lambda found: F.when(F.size(found) > 0, found).otherwise(items(item, "keys")))
        single = _bound(_read(item, "displayValue value"), lambda shown: F.filter(F.array(*[F.struct(_some(item, k).alias("k"), shown.alias("v")) for k in names.split()]), lambda e: e["k"].isNotNull()))
        return F.coalesce(_bound(F.struct(labels.alias("k"), items(item, "stats").alias("v")), table), single)

    def last(every: Column) -> Column:
        # The first place of a key from behind; a null key has none.
        behind = F.reverse(F.transform(every, lambda e: e["k"]))
        return _bound(behind, lambda keys: F.filter(every, lambda e, i: F.array_position(keys, e["k"]) == F.size(every) - i))

    return F.map_from_entries(_bound(F.flatten(F.transform(statistics, entries)), last))


def _moneyline(o: Column, side: str) -> Column:
    keys = [f"{side}TeamOdds", f"{side}Odds", f"{side}MoneyLine", f"{side}Moneyline"]
    return F.coalesce(*[whole(F.coalesce(some(o, " ".join(f"{k}.{n}" for n in ("moneyLine", "moneyline", "american", "value"))), read(o, k))) for k in keys])


def odds(competition: Column) -> Column:
    """Provider, details, spread, total and moneylines of the first odds of a competition."""
    o = F.get(items(competition, "odds"), F.lit(0))
    return F.struct(
        some(o, "provider.name provider.id").alias("odds_provider"), some(o, "details displayValue").alias("odds_details"), num(read(o, "spread")).alias("spread"),
        num(read(o, "overUnder")).alias("over_under"), _moneyline(o, "home").alias("home_moneyline"), _moneyline(o, "away").alias("away_moneyline"),
    )


def injuries(team: Column) -> Column:
    """An array with a row for each injury: under the team, beside it, or under its athletes. Entries without an athlete are left out."""
    direct = items(team, "team.injuries injuries")
    nested = F.flatten(F.transform(items(team, "athletes"), lambda a: F.transform(items(a, "injuries"), lambda e: F.struct(e.alias("entry"), F.coalesce(F.try_variant_get(e, "$.athlete", "variant"), F.try_variant_get(a, "$.athlete", "variant"), a).alias("athlete")))))
    pairs = F.when(F.size(direct) > 0, F.transform(direct, lambda e: F.struct(e.alias("entry"), F.try_variant_get(e, "$.athlete", "variant").alias("athlete")))).otherwise(nested)
    none = F.lit("")

    def row(p: Column) -> Column:
        e, a = p["entry"], p["athlete"]
        return F.struct(
            F.coalesce(some(team, "team.displayName team.name"), F.lit("Unknown")).alias("team"), F.coalesce(read(a, "id"), none).alias("athlete_id"), F.coalesce(some(a, "displayName shortName fullName"), F.lit("Unknown")).alias("player"),
            F.coalesce(some(a, "position.abbreviation position.name position"), none).alias("position"), F.coalesce(some(e, "status"), none).alias("status"), F.coalesce(some(e, "type.description type.abbreviation type.name type"), none).alias("injury_type"),
            F.coalesce(some(e, "details.detail longComment shortComment"), none).alias("detail"), F.coalesce(some(e, "details.side"), none).alias("side"), F.coalesce(some(e, "details.returnDate"), none).alias("return_date"),
        )

    return F.transform(F.filter(pairs, lambda p: F.coalesce(F.schema_of_variant(p["athlete"]).startswith("OBJECT"), F.lit(False))), row)
