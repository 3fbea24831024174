"""Hazard and precautionary statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases of the statements.
PHRASES = {
    "H220": "Extremely flammable gas.",
    "H225": "Highly flammable liquid and vapour.",
    "H226": "Flammable liquid and vapour.",
    "H302": "Harmful if swallowed.",
    "H312": "Harmful in contact with skin.",
    "H314": "Causes severe skin burns and eye damage.",
    "H315": "Causes skin irritation.",
    "H319": "Causes serious eye irritation.",
    "H332": "Harmful if inhaled.",
    "H335": "May cause respiratory irritation.",
    "H340": "May cause genetic defects.",
    "H350": "May cause cancer.",
    "H351": "Suspected of causing cancer.",
    "H360": "May damage fertility or the unborn child.",
    "H373": "May cause damage to organs through prolonged or repeated exposure.",
    "H400": "Very toxic to aquatic life.",
    "H410": "Very toxic to aquatic life with long lasting effects.",
    "H411": "Toxic to aquatic life with long lasting effects.",
    "P210": "Keep away from heat, hot surfaces, sparks, open flames and other ignition sources. No smoking.",
    "P261": "Avoid breathing dust/fume/gas/mist/vapours/spray.",
    "P273": "Avoid release to the environment.",
    "P280": "Wear protective gloves/protective clothing/eye protection/face protection/hearing protection/...",
    "P305+P351+P338": "IF IN EYES: Rinse continuously with water for several minutes. Remove contact lenses, if present and easy to do. Continue rinsing.",
    "P310": "Immediately call a POISON CENTER or doctor/physician.",
    "P501": "Dispose of contents/container to ...",
}
NO_SIGNAL = ["none", "n/a", ""]


def phrases(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(p).alias("phrase")) for c, p in PHRASES.items()]))
    return spark.range(1).select(rows.alias("x")).select("x.*")


def expand(codes: DataFrame) -> DataFrame:
    """Adds phrase and line, the code and the phrase, to rows with a code; the 25 phrases are broadcast. The phrase of an unknown
    code says so, after the code, so its line has the code twice."""
    got = codes.join(F.broadcast(phrases(codes.sparkSession)), "code", "left")
    known = F.col("phrase").isNotNull()
    phrase = F.coalesce("phrase", F.concat("code", F.lit(": (phrase not found)")))
    return got.withColumns({"known": known, "phrase": phrase, "line": F.concat(F.col("code"), F.lit(": "), phrase)})


def known_only(codes: DataFrame) -> DataFrame:
    return expand(codes).filter("known").drop("known", "line")


def shown_signals(signals: DataFrame, column: str = "signal_word") -> DataFrame:
    """Rows with a signal word that says something."""
    return signals.filter(~F.lower(F.btrim(F.coalesce(F.col(column), F.lit("")))).isin(*NO_SIGNAL))


def aquatic(codes: DataFrame) -> DataFrame:
    return codes.filter(F.startswith("code", F.lit("H4")))


def counts(codes: DataFrame, key: str) -> DataFrame:
    """Known H and P statements of each chemical."""
    return known_only(codes).groupBy(key).agg(F.count_if(F.col("kind") == "H").alias("n_h"), F.count_if(F.col("kind") == "P").alias("n_p"))
