"""Nested annotation documents: flattening, texts, statements, metrics, endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.landing import land

MARKUP = "array<struct<String: string, Markup: array<struct<URL: string, Extra: string>>>>"
# Headings whose items are toxicity texts; names and headings of metrics.
TOX_HEADINGS = "tox|safety|hazard|health|exposure|pharmacokinetics|carcinogen"
METRICS = {"flash_point": "flash point", "vapor_pressure": "vapor pressure", "nfpa": "nfpa", "iarc": "iarc"}


def flatten(docs: DataFrame, key: str = "doc_id", doc: str = "doc", step: int = 4) -> DataFrame:
    """(key, path, info_pos, own_heading, heading, name, raw): a row for each Information item of the section tree, however deep.

    ``path`` holds the section's place at each level; with ``info_pos`` it gives the document order. ``heading`` is the
    section's own or the nearest above it. Documents that are no JSON, or have no list of sections, have no rows; what is no
    object where a section or an item should be is left out.

    A document is parsed once, straight into ``step`` levels. A pass goes down these in one stage and lands its items beside the
    sections it didn't enter, which are variants; these alone feed the next pass, until there are none. Most documents end in
    the first."""
    levels = _levels(step)
    rows = docs.select(key, _sections(F.col(doc), levels).alias("below"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("heading"))
    passes = []
    while True:
        landed = land(_descend(rows, key, step))
        passes.append(landed.filter("info_pos >= 0").drop("below"))
        deeper = landed.filter("info_pos < 0")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, passes)
        section = levels.removeprefix("array<").removesuffix(">")
        rows = deeper.select(key, F.transform("below", lambda s: F.try_variant_get(s, "$", section)).alias("below"), "path", "heading")


def _sections(doc: Column, levels: str) -> Column:
    """A document's sections, down to the given levels. A document that doesn't fit their types throughout (a reader marks it as
    corrupt, or it is no object) is read again as a VARIANT, from which what fits is taken."""
    strict = {"columnNameOfCorruptRecord": "__corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    read = F.from_json(doc, f"struct<Record: struct<Section: {levels}>, __corrupt: string>", strict)
    return T.once(read, lambda r: F.when(F.startswith(F.ltrim(doc), F.lit("{")) & r["__corrupt"].isNull(), r["Record"]["Section"]).otherwise(F.try_variant_get(F.try_parse_json(doc), "$.Record.Section", levels)))


def _levels(step: int) -> str:
    """The type of a list of sections down to ``step`` levels; a cast to it gives null for what is no object."""
    below = "array<variant>"
    for _ in range(step):
        below = f"array<struct<TOCHeading: string, Information: array<struct<Name: string, Value: string>>, Section: {below}>>"
    return below


def _descend(rows: DataFrame, key: str, step: int) -> DataFrame:
    """Items of the next ``step`` levels under rows(key, path, heading, below), and a row at -1 for each section with more below it."""
    none = F.lit(None)
    rows = rows.withColumns({"own": none.cast("string"), "info": none.cast("array<struct<Name: string, Value: string>>")})
    for left in range(step - 1, -1, -1):
        child = lambda s, i: F.struct(F.concat("path", F.array(i)).alias("path"), s["TOCHeading"].alias("own"), F.coalesce(T.blank_to_null(s["TOCHeading"]), F.col("heading")).alias("heading"), s["Information"].alias("info"), s["Section"].alias("below"))
        own = F.array(F.struct("path", "own", "heading", "info", none.cast(_levels(left)).alias("below")))
        rows = rows.select(key, F.explode(F.concat(own, F.coalesce(F.transform("below", child), F.array().cast(f"array<struct<path: array<int>, own: string, heading: string, info: array<struct<Name: string, Value: string>>, below: {_levels(left)}>>")))).alias("s"))
        rows = rows.select(key, "s.*")
    item = lambda x, i: F.struct(i.alias("info_pos"), x["Name"].alias("name"), x["Value"].alias("raw"), x.isNotNull().alias("fits"), none.cast("array<variant>").alias("below"))
    deeper = F.when(F.size("below") > 0, F.array(F.struct(F.lit(-1).alias("info_pos"), none.cast("string").alias("name"), none.cast("string").alias("raw"), F.lit(True).alias("fits"), "below")))
    found = rows.select(key, "path", F.col("own").alias("own_heading"), "heading", F.explode(F.flatten(F.array_compact(F.array(F.transform("info", item), deeper)))).alias("x")).filter("x.fits")
    return found.select(key, "path", "x.info_pos", "own_heading", "heading", "x.name", "x.raw", "x.below")


def _markup(raw: Column) -> Column:
    """The strings of a value. One pass reads a list of objects, which nearly all are; the rest is read as it comes."""
    return F.coalesce(F.from_json(raw, f"struct<StringWithMarkup: {MARKUP}>")["StringWithMarkup"], F.from_json(F.get_json_object(raw, "$.StringWithMarkup"), MARKUP))


def _text_of(markup: Column, raw: Column) -> Column:
    is_object = F.startswith(F.ltrim(raw), F.lit("{"))
    joined = F.array_join(F.filter(F.transform(markup, lambda x: x["String"]), lambda x: x.isNotNull()), " ")
    found = F.when(is_object, T.once(joined, lambda j: F.coalesce(F.when(j != "", j), F.get_json_object(raw, "$.String")))).otherwise(raw)
    return T.once(T.strip(found), lambda s: F.when(s != "", s))


def text(raw: Column) -> Column:
    """The text of a value: its strings joined by blanks, its String, or the scalar itself; null if blank."""
    return T.once(_markup(raw), lambda m: _text_of(m, raw))


def urls(raw: Column, most: int = 5) -> Column:
    """The first addresses that the value's strings link to."""
    return _urls_of(_markup(raw), most)


def _urls_of(markup: Column, most: int = 5) -> Column:
    found = F.flatten(F.transform(markup, lambda x: F.coalesce(F.filter(F.transform(x["Markup"], lambda m: m["URL"]), lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))))
    return F.slice(found, 1, most)


def _with_text(items: DataFrame) -> DataFrame:
    """Items that have a text, with it and their links, read once: a row comes out of the list that holds them if there is a text."""
    read = F.transform(F.array(_markup(F.col("raw"))), lambda m: F.struct(_text_of(m, F.col("raw")).alias("text"), _urls_of(m).alias("links")))
    kept = [c for c in items.columns if c not in ("text", "links")]
    return items.select(*kept, F.explode(F.filter(read, lambda x: x["text"].isNotNull())).alias("x")).select(*kept, "x.*")


def ordinal() -> Column:
    return F.struct("path", "info_pos")


def statements(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, code, at): hazard (H) and precautionary (P) codes under headings with GHS or Classification, each once, with
    the place it is first seen. Percentages in brackets go; P305+P351 splits after the first plus and number, as the pattern has it."""
    own = F.coalesce(F.col("own_heading"), F.lit(""))
    low = F.lower(F.coalesce(F.col("name"), F.lit("")))
    has = lambda p: F.contains(low, F.lit(p))
    kind = F.when(has("pictogram") | has("signal"), None).when(has("hazard"), "H").when(has("precautionary"), "P")
    near = items.filter(F.contains(own, F.lit("GHS")) | F.contains(own, F.lit("Classification"))).withColumn("kind", kind).filter("kind is not null")
    near = near.withColumn("text", text(F.col("raw")))
    return codes(near, key, "kind", "text", ordinal())


def codes(rows: DataFrame, key: str, kind: str, value: str, at: Column) -> DataFrame:
    """(key, kind, code, at) of texts whose kind is H or P; a code once, where it is first seen."""
    found = F.regexp_extract_all(value, F.when(F.col(kind) == "H", r"H\d+(?:\+\d+)?(?:\s*\([^)]+\))?").otherwise(r"P\d+(?:\+\d+)?(?:\s*\([^)]+\))?"), F.lit(0))
    long = rows.select(key, kind, at.alias("o"), F.posexplode(found).alias("pos", "code"))
    long = long.withColumn("code", T.strip(F.regexp_replace("code", r"\s*\([^)]+\)", "")))
    return long.groupBy(key, F.col(kind).alias("kind"), "code").agg(F.min(F.struct("o", "pos")).alias("at"))


def signal_words(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, signal_word): the last one in document order."""
    own, low = F.coalesce(F.col("own_heading"), F.lit("")), F.lower("name")
    near = items.filter((F.contains(own, F.lit("GHS")) | F.contains(own, F.lit("Classification"))) & F.contains(low, F.lit("signal")) & ~F.contains(low, F.lit("pictogram")))
    return near.groupBy(key).agg(F.max_by(F.coalesce(text(F.col("raw")), F.col("name")), ordinal()).alias("signal_word"))


def pictograms(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pictogram, at): names of pictograms, each once."""
    own = F.coalesce(F.col("own_heading"), F.lit(""))
    near = items.filter((F.contains(own, F.lit("GHS")) | F.contains(own, F.lit("Classification"))) & F.contains(F.lower("name"), F.lit("pictogram")))
    extra = F.flatten(F.transform(_markup(F.col("raw")), lambda x: F.coalesce(F.transform(x["Markup"], lambda m: T.strip(m["Extra"])), F.array().cast("array<string>"))))
    long = near.select(key, ordinal().alias("o"), F.posexplode(extra).alias("pos", "pictogram")).filter("pictogram <> ''")
    return long.groupBy(key, "pictogram").agg(F.min(F.struct("o", "pos")).alias("at"))


def metrics(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, metric, text, at): distinct texts of physical and rating metrics; a text may feed several."""
    name, head = F.lower(F.coalesce(F.col("name"), F.lit(""))), F.lower(F.coalesce(F.col("heading"), F.lit("")))
    tests = [F.when(F.contains(name, F.lit(p)) | F.contains(head, F.lit(p)), F.lit(m)) for m, p in METRICS.items()]
    tests.append(F.when(F.contains(name, F.lit("proposition 65")) | F.contains(name, F.lit("prop 65")), F.lit("prop65")))
    long = items.select(key, "path", "info_pos", "raw", F.explode(F.array_compact(F.array(*tests))).alias("metric"))
    long = _with_text(long)
    return long.groupBy(key, "metric", "text").agg(F.min(ordinal()).alias("at"))


def tox_endpoints(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path, info_pos, type, value, unit, species_route, source_section, reference_urls) of items under toxicity headings."""
    near = _with_text(items.filter(F.rlike(F.lower(F.coalesce(F.col("heading"), F.lit(""))), F.lit(TOX_HEADINGS))))
    return near.select(key, "path", "info_pos", F.coalesce(T.blank_to_null(F.col("name")), F.lit("Toxicity")).alias("type"), F.substring("text", 1, 400).alias("value"), T.unit_of(F.col("text")).alias("unit"), T.species_route_tokens(F.col("text")).alias("species_route"), F.col("heading").alias("source_section"), F.when(F.size("links") > 0, F.col("links")).alias("reference_urls"))
