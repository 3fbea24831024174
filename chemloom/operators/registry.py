"""Substance registries: cleaning, merging, look-ups, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cas
from ..functions.text import strip

FIELDS = ["cas", "dtxsid", "preferred_name", "systematic_name", "molecular_formula", "average_mass", "monoisotopic_mass", "inchi", "inchikey", "smiles"]
# Accepted headers of each field, the first present wins.
ALIASES = {
    "cas": ["CASRN", "CAS", "CAS NUMBER", "CAS_NO"],
    "dtxsid": ["DTXSID", "DTXCID", "SUBSTANCE KEY", "DSSTOX_SUBSTANCE_ID"],
    "preferred_name": ["PREFERRED_NAME", "PREFERRED NAME", "CHEMICAL_NAME", "NAME", "SUBSTANCE_NAME"],
    "systematic_name": ["SYSTEMATIC_NAME", "SYSTEMATIC NAME", "IUPAC_NAME"],
    "molecular_formula": ["MOLECULAR_FORMULA", "MOLECULAR FORMULA", "FORMULA", "MF"],
    "average_mass": ["AVERAGE_MASS", "AVERAGE MASS", "AVG_MASS"],
    "monoisotopic_mass": ["MONOISOTOPIC_MASS", "MONOISOTOPIC MASS", "EXACT_MASS"],
    "inchi": ["INCHI", "INCHI_STRING"],
    "inchikey": ["INCHIKEY", "INCHI KEY"],
    "smiles": ["SMILES", "CANONICAL SMILES", "ISOMERIC_SMILES"],
}
# Texts that stand for a missing value, by loader.
BLANK_TOKENS = ["", "nan", "none"]
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalize_headers(df: DataFrame) -> DataFrame:
    """Headers trimmed and in upper case."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Renames the first header of each field that is there; other columns stay."""
    df = normalize_headers(df)
    found = {next(a for a in names if a in df.columns): field for field, names in aliases.items() if any(a in df.columns for a in names)}
    return df.select([F.col(f"`{c}`").alias(found.get(c, c.lower())) for c in df.columns])


def require_key_columns(df: DataFrame, key: str = "cas") -> DataFrame | None:
    """None for a source without the key, which the caller leaves out; without dtxsid, an empty one is added."""
    if key not in df.columns:
        return None
    return df if "dtxsid" in df.columns else df.withColumn("dtxsid", F.lit(""))


def conform_registry(df: DataFrame, extra: tuple[str, ...] = ("src_file", "row_idx")) -> DataFrame:
    """The ten fields as text, null where the source has none, and the provenance columns."""
    return df.select([F.col(f).cast("string").alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in FIELDS] + [c for c in extra if c in df.columns])


def na_to_null(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def scrub(c: Column) -> Column:
    t = strip(c)
    return F.when(~F.lower(t).isin(*BLANK_TOKENS), t)


def scrub_nulls(df: DataFrame, fields: list[str], key: str = "cas") -> DataFrame:
    """Trims, turns blank tokens into nulls, drops rows without a key or without any other field."""
    clean = df.withColumns({f: scrub(F.col(f)) for f in fields})
    others = [F.col(f) for f in fields if f != key]
    return clean.filter(F.col(key).isNotNull() & F.coalesce(*others).isNotNull())


def merge_registry(df: DataFrame, order: list[str], key: str = "cas") -> DataFrame:
    """One row for each key; each field is the first that isn't null, in the given order. One shuffle, map-side combined."""
    by = F.struct(*order)
    fields = [f for f in df.columns if f != key and f not in order]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), by)).alias(f) for f in fields])


def registry_simple(registry: DataFrame) -> DataFrame:
    """(cas, dtxsid, preferred_name): the projection that look-ups of two fields need, so that no other column is read."""
    return registry.select("cas", "dtxsid", "preferred_name")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, in the given order."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def lookup_by_cas(queries: DataFrame, registry: DataFrame, order: list[str], query: str = "query") -> DataFrame:
    """Each query row with its record: an exact number, else the first with the same digits, else nulls.

    Equal numbers have equal keys, so one join on the key and one ordered aggregate do; only queries that match anything and
    only distinct query texts take part in the aggregate."""
    rec = [c for c in registry.columns if c not in order]
    asked = queries.select(query).distinct().withColumn("cas_key", cas.compact(F.col(query))).filter("cas_key <> ''")
    own = registry.withColumn("cas_key", cas.compact(F.col("cas"))).filter("cas_key is not null")
    both = asked.join(own, "cas_key")
    first = both.groupBy(query).agg(F.min_by(F.struct(*rec), F.struct((F.col("cas") != F.col(query)).alias("other"), *order)).alias("r"))
    return queries.join(first, query, "left").select(*queries.columns, *[F.col(f"r.{c}").alias(c) for c in rec])


def lookup_by_dtxsid(queries: DataFrame, registry: DataFrame, order: list[str], query: str = "query") -> DataFrame:
    """Each query row with the first record of its substance id, else nulls."""
    rec = [c for c in registry.columns if c not in order]
    first = registry.filter(F.col("dtxsid").isNotNull()).groupBy("dtxsid").agg(F.min_by(F.struct(*rec), F.struct(*order)).alias("r")).withColumnRenamed("dtxsid", query)
    return queries.join(first, query, "left").select(*queries.columns, *[F.col(f"r.{c}").alias(c) for c in rec])


def completeness(registry: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, and rows with a non-empty value of each field."""
    return registry.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(f) != "", F.lit(False))).alias(f"with_{f}") for f in fields])


def sections(registry: DataFrame, key: str = "cas") -> DataFrame:
    """(key, section, label, value): a record as labelled rows; a long InChI is cut to 77 characters and dots."""
    inchi = F.when(F.length("inchi") > 80, F.concat(F.substring("inchi", 1, 77), F.lit("..."))).otherwise(F.col("inchi"))
    # Labels of the sections.
    rows = [("DTXSID", "DTXSID", F.col("dtxsid")), ("Names", "Preferred name", F.col("preferred_name")), ("Names", "Systematic name", F.col("systematic_name")), ("Molecular", "Formula", F.col("molecular_formula")), ("Molecular", "Average mass", F.col("average_mass")), ("Molecular", "Monoisotopic mass", F.col("monoisotopic_mass")), ("Structure", "InChI", inchi), ("Structure", "InChI Key", F.col("inchikey")), ("Structure", "SMILES", F.col("smiles"))]
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("label"), v.cast("string").alias("value")) for s, n, v in rows]))
    return registry.select(key, long.alias("x")).select(key, "x.*").filter("value is not null")


def cas_audit(df: DataFrame, column: str, source: str, compat: bool = False) -> DataFrame:
    """Rows of each source by status of the registry number."""
    return df.groupBy(source, cas.status(F.col(column), compat).alias("status")).agg(F.count("*").alias("n"))
