"""Column expressions that read toxicity sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"
# Patterns and token lists that results depend on.
UNITS = "mg/kg|mg/m³|ppm|g/kg|mL/kg|mg/L|µg/kg|mg/m3|ppb"
TOKENS = "rat|mouse|rabbit|dog|guinea pig|human|oral|dermal|inhalation|ip|iv|sc|ld50|lc50|fish|trout|daphnia|algae|aquatic"
ROUTES = ["oral", "dermal", "inhalation", "ip", "iv", "sc"]
ENDPOINTS = "LC50|EC50|LC10|LC20|LC90|EC10|EC20|EC90|NOEC|LOEC"
DURATION = r"(\d+\s*(?:h|hr|hrs|hour|hours|d|day|days))\b"
ECOTOX_VALUE = r"([<>~]?\s*\d+(?:[.,]\d+)?)\s*(mg/L|µg/L|ug/L|mg/kg|g/L|mg/l)\b"
INTERVAL = r"(?:CI|confidence interval)[^0-9]*([0-9]+(?:\.\d+)?)\s*[–-]\s*([0-9]+(?:\.\d+)?)"
AQUATIC = ["fish", "trout", "daphnia", "algae", "aquatic"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DASH = "—"
# Before the alternatives of UNITS and TOKENS, patterns ask for one of their first letters.


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def with_once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with c as a column that is computed once for each row. A plain column is computed again in every use: filters, branches, and
    lower and upper are dear on texts that aren't ASCII."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without one."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def number(c: Column) -> Column:
    """Text to double; what isn't a plain number is null."""
    return F.when(F.rlike(strip(c), F.lit(NUMBER)), strip(c).try_cast("double"))


def has_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def unit_of(text: Column) -> Column:
    """The first dose unit, as written. Alternatives are tried in order at each place, so '5 ug/kg' has the unit g/kg."""
    return extract(text, rf"(?iu)(?=[mpgµ])({UNITS})(?![\p{{L}}\p{{N}}_])", 1)


def species_route_tokens(text: Column) -> Column:
    """All species and route tokens, each spelling once, in the order they are first seen; null without any."""
    return once(F.array_distinct(_tokens(text)), lambda x: F.when(F.size(x) > 0, x))


def with_species_route(df: DataFrame, value: str) -> DataFrame:
    """df with the column species_route of species_route_tokens()."""
    return with_once(df, "__found", _tokens(F.col(value))).withColumn("species_route", F.when(F.size("__found") > 0, F.array_distinct("__found"))).drop("__found")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?i)\b(?=[rmdghoislfta])({TOKENS})\b"), 1)


def has_number(text: Column) -> Column:
    """Whether the text starts with a number, which <, > or ~ may precede."""
    return F.coalesce(F.rlike(strip(text), F.lit(r"^[<>~]?\s*\d+(?:[.,]\d+)?")), F.lit(False))


def aquatic_species(low: Column) -> Column:
    return F.when(has_any(low, ["fish", "trout"]), "fish").when(F.contains(low, F.lit("daphnia")), "Daphnia").when(F.contains(low, F.lit("algae")), "algae").otherwise("aquatic")


def route_and_species(value: Column, tokens: Column) -> Column:
    """Struct of route and species. The first rule that holds gives the route: aquatic, dermal, inhalation, oral, other.

    Rules look for parts of words, so 'concentration' counts as rat; species come from the tokens, else from such parts."""
    # What later rules read is computed once, not in every rule.
    read = lambda x: F.struct(x["low"].alias("low"), _others(x["own"]).alias("species"), _route(x["low"], x["own"]).alias("route"))
    return once(once(F.struct(F.lower(F.coalesce(value, F.lit(""))).alias("low"), _own(tokens).alias("own")), read), lambda x: F.struct(x["route"].alias("route"), _species(x["low"], x["species"], x["route"]).alias("species")))


def with_route_and_species(df: DataFrame, value: str, tokens: str) -> DataFrame:
    """df with the columns route and species of route_and_species(), in about half its time: rules inside lambdas aren't compiled."""
    low, own = F.col("__low"), F.col("__own")
    t = with_once(with_once(df, "__low", F.lower(F.coalesce(value, F.lit("")))), "__own", _own(F.col(tokens)))
    t = t.withColumns({"route": _route(low, own), "__species": _others(own)})
    return t.withColumn("species", _species(low, F.col("__species"), F.col("route"))).drop("__low", "__own", "__species")


def _own(tokens: Column) -> Column:
    return F.coalesce(F.transform(tokens, lambda x: F.lower(strip(x))), F.array().cast("array<string>"))


def _others(own: Column) -> Column:
    """Tokens that are species."""
    return F.array_except(own, F.array(*map(F.lit, [*ROUTES, "ld50", "lc50", None])))


def _route(low: Column, tokens: Column) -> Column:
    has = lambda p: F.contains(low, F.lit(p))
    return (
        F.when(has_any(low, AQUATIC), "Ecotoxicity (aquatic)")
        .when(has("dermal") | has("skin") | F.array_contains(tokens, "dermal"), "Dermal")
        .when(has("inhalation") | has("inhaled") | has("mg/m") | has("ppm") | F.array_contains(tokens, "inhalation"), "Inhalation")
        .when(has("oral") | has("po ") | F.array_contains(tokens, "oral") | (has("rat") & ~has("dermal") & ~has("inhalation")), "Oral")
        .otherwise("Other")
    )


def _species(low: Column, species: Column, route: Column) -> Column:
    has = lambda p: F.contains(low, F.lit(p))
    none = F.size(species) == 0
    named = F.when(none, F.lit(DASH)).otherwise(F.array_join(species, ", "))
    pick = lambda *names: _first(none, named, [(has(n), n) for n in names])
    return (
        F.when(route == "Ecotoxicity (aquatic)", F.when(none, aquatic_species(low)).otherwise(named))
        .when(route == "Dermal", pick("rabbit", "rat"))
        .when(route == "Inhalation", pick("rat"))
        .when(route == "Oral", pick("rat", "mouse"))
        .otherwise(named)
    )


def _first(none: Column, named: Column, tests: list[tuple[Column, str]]) -> Column:
    out = F.when(~none, named)
    for test, name in tests:
        out = out.when(test, name)
    return out.otherwise(named)


def ecotox(value: Column) -> Column:
    """Struct (endpoint, duration, value_num, unit, ci_low, ci_high, conditions) read from a sentence; commas are dropped from
    the value, and any 'ci' before two numbers counts as an interval."""
    # A text is searched once for each pattern; what it found is taken apart. Blanks become nulls only at the end, as nullif computes
    # its first argument twice here.
    dose, interval, get = "(?iu)" + ECOTOX_VALUE, "(?iu)" + INTERVAL, F.regexp_extract
    found = lambda t: F.struct(t.alias("text"), get(t, rf"(?i)\b(?=[len])({ENDPOINTS})\b", 1).alias("endpoint"), get(t, "(?i)" + DURATION, 1).alias("duration"), get(t, dose, 0).alias("dose"), get(t, interval, 0).alias("interval"))
    parts = lambda x: F.struct(x["text"].alias("text"), x["endpoint"].alias("endpoint"), x["duration"].alias("duration"), *[F.when(x[c] != "", get(x[c], p, i)).otherwise("").alias(f"{c}{i}") for c, p in (("dose", dose), ("interval", interval)) for i in (1, 2)])
    plain = lambda c: strip(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"[<>~]\s*", "")).try_cast("double")
    return once(once(once(strip(value), found), parts), lambda x: F.struct(
        F.upper(blank_to_null(x["endpoint"])).alias("endpoint"),
        blank_to_null(x["duration"]).alias("duration"),
        plain(blank_to_null(x["dose1"])).alias("value_num"),
        blank_to_null(x["dose2"]).alias("unit"),
        blank_to_null(x["interval1"]).try_cast("double").alias("ci_low"),
        blank_to_null(x["interval2"]).try_cast("double").alias("ci_high"),
        x["text"].alias("conditions"),
    ))


def study_category(study_type: Column) -> Column:
    """One of nine categories; the first rule that holds wins. Null counts as empty."""
    low = F.lower(F.coalesce(study_type, F.lit("")))
    return (
        F.when(has_any(low, ["ld50", "lc50", "acute", "lethal"]), "acute_toxicity")
        .when(has_any(low, ["carcinogen", "cancer"]), "carcinogenicity")
        .when(has_any(low, ["genotox", "mutagen", "ames"]), "genotoxicity")
        .when(F.contains(low, F.lit("repeat")) & F.contains(low, F.lit("dose")), "repeated_dose")
        .when(F.contains(low, F.lit("develop")), "developmental")
        .when(F.contains(low, F.lit("reproduc")), "reproductive")
        .when(F.contains(low, F.lit("neuro")), "neurotoxicity")
        .when(has_any(low, ["ecotox", "fish", "daphnia", "algae"]), "ecotoxicity")
        .otherwise("other")
    )


def band(dose: Column, thresholds: list[float]) -> Column:
    """1 for the first threshold that the dose doesn't exceed, and so on; 5 above the last."""
    out = None
    for n, t in enumerate(thresholds, 1):
        out = F.when(dose <= t, n) if out is None else out.when(dose <= t, n)
    return F.when(dose.isNotNull(), out.otherwise(5))
