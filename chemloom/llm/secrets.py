"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (assignments, access identifiers, long hex runs) stand on their own. Weak parts (bare identifiers, bare secrets,
endpoints) are reported only when complementary parts lie within the same scope; an interval join finds those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The patterns of the strong kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts of a credential.
WEAK_ID = r"""(?i)(?<![A-Za-z0-9_])(?:client_id|access_id|account_id|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i)https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"
#: The order of kinds that start at the same place.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def spans(text: Column, pattern: str, kind: str, least: tuple[int, int] | None = None) -> Column:
    """Places of the leftmost non-overlapping matches: their lengths and those of the pieces between them, added up.

    least: a group of the pattern and the characters it must have; matches with fewer are dropped after the search."""
    p = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, p, 0), lambda x: F.length(x))
    group = F.transform(F.regexp_extract_all(text, p, least[0]), lambda x: F.length(x)) if least else found
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("long"), group.alias("inner"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    no = F.lit(KINDS.index(kind))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["long"]
        one = F.array(F.struct(start.alias("start"), no.alias("kind_no"), end.alias("end")))
        keep = x["inner"] >= (least[1] if least else 0)
        return F.struct(end.alias("at"), F.when(keep, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.when(F.rlike(text, p), F.aggregate(steps, zero, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def written(all_spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(all_spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"], x["end"])), ",")


def link(parts: DataFrame, scope: int) -> DataFrame:
    """parts(id, same, start, kind_no, end) -> the weak ones that have their complements within ``scope`` characters.

    A weak identifier needs a secret, a weak secret needs an identifier, and an endpoint needs both. Both sides are cut into
    cells of ``scope`` characters, so the join is one on equal cells; semi-joins return a part once, however many partners."""
    role = F.when(F.col("kind_no").isin(1, 3), "id").when(F.col("kind_no").isin(0, 2, 4), "secret").otherwise("endpoint")
    parts = parts.withColumn("role", role)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.filter("kind_no >= 3").withColumn("cell", cells(F.col("start"), F.col("end"))).alias("w")
    wide = parts.filter("role <> 'endpoint'").withColumn("cell", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))

    def near(left: DataFrame, wanted: str) -> DataFrame:
        right = wide.filter(F.col("role") == wanted).alias("p")
        on = F.expr(f"w.id <=> p.id and w.same = p.same and w.cell = p.cell and p.start - w.end <= {scope} and w.start - p.end <= {scope} and not (p.start = w.start and p.end = w.end)")
        kept = left.join(right, on, "left_semi").select("id", "same", "start", "kind_no", "end").distinct()
        return kept

    ids = near(weak.filter("role = 'id'"), "secret")
    secrets = near(weak.filter("role = 'secret'"), "id")
    ends = near(weak.filter("role = 'endpoint'"), "id").withColumn("cell", cells(F.col("start"), F.col("end"))).alias("w")
    return ids.unionByName(secrets).unionByName(near(ends, "secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans) of every row; places are code points, ends exclusive.

    ``base`` has the strong spans, ``spans`` those and the linked weak ones. Null texts count as empty; repeated rows each come
    back; spans of different kinds may overlap; null ids, empty tables and other columns are allowed. Overlong texts need no
    more than their own row; parts of one text are joined by cell, never all with all."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("same"), t.alias("t")).select(
        "id", "same",
        spans(F.col("t"), ASSIGN, "assign", (2, 6)).alias("assign"),
        F.when(F.contains("t", F.lit("AKIA")), spans(F.col("t"), ACCESS, "access")).otherwise(F.array().cast(SPAN)).alias("access"),
        spans(F.col("t"), HEX, "hex").alias("hex"),
        F.concat(spans(F.col("t"), WEAK_ID, "weak_id"), spans(F.col("t"), WEAK_SECRET, "weak_secret"), F.when(F.contains(F.lower("t"), F.lit("://")), spans(F.col("t"), ENDPOINT, "endpoint")).otherwise(F.array().cast(SPAN))).alias("weak"),
    )
    found, _ = cut(found.withColumn("base", F.concat("assign", "access", "hex")))
    parts = found.filter("size(weak) > 0").select("id", "same", F.explode(F.concat("base", "weak")).alias("p")).select("id", "same", "p.*").distinct()
    added = link(parts, scope).groupBy("id", "same").agg(F.collect_list(F.struct("start", "kind_no", "end")).alias("added"))
    both = found.alias("f").join(added.alias("a"), F.expr("f.id <=> a.id and f.same = a.same"), "left")
    size = lambda c: F.size(c).cast("long")
    return both.select("f.id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), written(F.col("base")).alias("base"), written(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))
