"""Registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, licenses, mixing, pst, repair, rules, runs, secrets, sharding, simhash, substring, toxicity
from .common import SPACE_WORD, table


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return s.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_suffix_tree_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"]))).alias("shards"))


def op5_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


def op6_multipart_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.scan(table(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_tfidf_neighbour_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_licence_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumn("found", F.to_json("found"))


def with_periods(docs: DataFrame) -> DataFrame:
    """documents in which every text whose hash ends in 0 turns periodic at a word that the hash names."""
    h, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("_words")
    n, g = F.size(w), F.floor(h / 10)
    split = docs.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD), F.lit(0))))
    split = split.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    at = lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get(w, (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return split.select("doc_id", F.when(n > 0, F.array_join(F.transform(w, at), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("top", top).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.n") / -F.col("top.p")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_risk_controlled_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conversations with turns dropped, emptied, without stops, repeated or of another role, as a hash of their number says."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(n == 1, "").when(n == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(n != 0).select("conv_id", "turn", F.when(n == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_four_russians_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair.repair(with_faults(rows)).withColumnRenamed("id", "found")
    whole = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_vector_bin_packing,
        op2_suffix_tree_substring_dedup,
        op3_simhash_near_dedup,
        op4_source_mixing,
        op5_nn_descent_search,
        op6_multipart_secret_links,
        op7_suffix_tree_scores,
        op8_wu_manber_decontamination,
        op9_tfidf_neighbour_toxicity,
        op10_licence_paragraph_classifier,
        op11_periodic_runs,
        op12_risk_controlled_quality_rules,
        op13_four_russians_conversation_repair,
    )
}

#: CRC-32 of an ASCII text, which DuckDB lacks: bytes, then bits, folded into the remainder.
DUCK_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
            lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)))"""



def _rules_sql() -> str:
    """Counts, then a path for each rule on what the mildest cutoffs before it leave, then the binomial test of each level."""
    names = rules.RULES
    parts = [r"""
        with raw as (select row_number() over () as row_no, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, CRC % 2 as fold from documents),
        wins as (select row_no, i, array_to_string(w[i : i + 2], ' ') as g from (select row_no, w, unnest(range(1, len(w) - 1)) as i from raw where len(w) > 2) x),
        again as (select row_no, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by row_no, g) as n from wins) x where n > 1),
        spots as (select row_no, count(distinct p) as n from again group by row_no),
        counted as (select raw.*, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(spots.n, 0) as n_repeat_words from raw left join spots using (row_no)),
        full_of as (select *, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
        rows_of as (select *, least(64 * n_symbols // greatest(n_words, 1), 1023) as b0, least(64 * n_dup_lines // greatest(len(lines), 1), 1023) as b1, least(64 * n_repeat_words // greatest(n_words, 1), 1023) as b2,
            least(16 * word_chars // greatest(n_words, 1), 1023) as b3, -least(16 * word_chars // greatest(n_words, 1), 1023) as b4 from full_of),
        known as (select r.*, good from rows_of r join (select doc_id, min(quality) as good from labels where quality is not null group by doc_id) l using (doc_id) where not base_failed),
        levels as (select unnest(range(1, LEVELS + 1)) as level, unnest(SHARES) as share),
        rest0 as (select * from known where fold = 0)"""]
    for r in range(len(names)):
        parts.append(f"""
        sum{r} as (select *, sum(g) over (partition by stratum order by w desc) as cg, sum(b) over (partition by stratum order by w desc) as cb, sum(g) over (partition by stratum) as total
            from (select stratum, b{r} as w, count(*) filter (good = 1) as g, count(*) filter (good <> 1) as b from rest{r} group by 1, 2) x),
        way{r} as (select stratum, level, arg_max(w, row(cb, w)) - 1 as cut from sum{r}, levels where cg <= share * total and cg <= cb and cb > 0 group by stratum, level),
        rest{r + 1} as (select x.* from rest{r} x left join way{r} y on y.stratum = x.stratum and y.level = 1 where not coalesce(x.b{r} > y.cut, false))""")
    cuts = ", ".join(f"way{r}.cut as c{r}" for r in range(len(names)))
    joins = " ".join(f"left join way{r} on way{r}.stratum = s.stratum and way{r}.level = l.level" for r in range(len(names)))
    breaks = " or ".join(f"coalesce(b{r} > c{r}, false)" for r in range(len(names)))
    parts.append(f"""
        strata as (select stratum from ({" union ".join(f"select stratum from way{r} where level = {len(rules.LEVELS)}" for r in range(len(names)))}) x),
        way as (select s.stratum, l.level, {cuts} from strata s cross join levels l {joins}),
        tests as (select stratum, level, count(*) as n, count(*) filter ({breaks}) as k from known join way using (stratum) where fold = 1 and good = 1 group by 1, 2),
        chances as (select stratum, level, (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05::double) + (n - j) * ln(0.95::double))) from (select unnest(range(0, k + 1)) as j) x) as p from tests),
        held as (select stratum, max(level) as level from (select *, max(p) over (partition by stratum order by level) as worst from chances) x where worst <= 0.05::double / (select count(*) from strata) group by stratum),
        chosen as (select way.* from way join held using (stratum, level))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({breaks}) as kept,
        concat_ws(',', {", ".join(f"case when b{r} > c{r} then '{n}' end" for r, n in enumerate(names))}) as broken from rows_of left join chosen using (stratum)""")
    return ",".join(parts).replace("CRC", DUCK_CRC32.format("cast(doc_id as varchar)")).replace("LEVELS", str(len(rules.LEVELS))).replace("SHARES", "[" + ", ".join(f"{x}::double" for x in rules.LEVELS) + "]")


ORACLE_SQL: dict[str, str] = {
    "op12_risk_controlled_quality_rules": _rules_sql(),
    "op2_suffix_tree_substring_dedup": r"""
        with docs as (select row_number() over () as row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as (select row_no, unnest(range(1, len(w) - 33)) as i, w from docs where len(w) >= 35),
        keyed as (select row_no, i, sha256(array_to_string(w[i : i + 34], ' ')) as g from windows),
        repeats as (select row_no, i from keyed where g in (select g from keyed group by g having count(*) > 1)),
        gone as (select distinct row_no, unnest(range(i, i + 35)) as p from repeats),
        kept as (select d.row_no, p, w[p] as word from (select row_no, w, unnest(range(1, len(w) + 1)) as p from docs) d anti join gone using (row_no, p)),
        texts as (select row_no, string_agg(word, ' ' order by p) as t from kept group by row_no),
        lost as (select row_no, count(*) as n from gone group by row_no)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(lost.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from docs left join texts using (row_no) left join lost using (row_no)""",
    "op8_wu_manber_decontamination": r"""
        with docs as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
        sized as (select item_id, w, least(13, len(w)) as n from items where len(w) > 0),
        patterns as (select distinct cast(item_id as varchar) as item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from sized) x),
        sizes as (select distinct n from patterns),
        grams as (select row_no, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select row_no, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n) x),
        hits as (select row_no, i, n, item_id from grams join patterns using (n, g)),
        words as (select row_no, count(distinct p) as k from (select row_no, unnest(range(i, i + n)) as p from hits) x group by row_no),
        own as (select row_no, count(*) as k, string_agg(item_id, ',' order by item_id) as names from (select distinct row_no, item_id from hits) x group by row_no)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(words.k, 0) as n_hit, coalesce(own.k, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
        coalesce(words.k, 0) > 0 and 20 * coalesce(words.k, 0) >= len(w) as contaminated from docs left join words using (row_no) left join own using (row_no)""",
    "op11_periodic_runs": r"""
        with raw as (select row_number() over () as row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, CRC as h from documents),
        put as (select *, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from raw),
        docs as (select row_no, doc_id, case when a is null then w else list_transform(range(0, len(w)), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) + 1] end) end as w from put),
        grams as (select row_no, i, array_to_string(w[i + 1 : i + 6], ' ') as g from (select row_no, w, unnest(range(0, len(w) - 5)) as i from docs where len(w) > 5) x),
        pairs as (select a.row_no, a.i, b.i - a.i as q from grams a join grams b on a.row_no = b.row_no and a.g = b.g and a.i < b.i),
        isles as (select row_no, q, min(i) as s, max(i) - min(i) + 6 + q as n from (select *, i - row_number() over (partition by row_no, q order by i) as isle from pairs) x group by row_no, q, isle),
        runs as (select row_no, s, n, min(q) as q from isles where n >= greatest(12, 2 * q) group by row_no, s, n),
        words as (select row_no, p, w[p + 1] as word from (select row_no, w, unnest(range(0, len(w))) as p from docs) x),
        gone as (select distinct row_no, unnest(range(s + q, s + n)) as p from runs),
        texts as (select row_no, string_agg(word, ' ' order by p) as t from (select * from words anti join gone using (row_no, p)) x group by row_no),
        best as (select row_no, count(*) as k, string_agg(concat(s, ',', n, ',', q, chr(10)), '' order by s, q) as told, arg_max(row(s, n, q), row(n, -s, -q)) as r from runs group by row_no)
        select doc_id, coalesce(k, 0) as n_runs, r[1] as start, r[2] as length, r[3] as period, (1000 * r[2]) // r[3] as exponent_milli, sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
        from docs left join best using (row_no) left join texts using (row_no)""".replace("CRC", DUCK_CRC32.format("cast(doc_id as varchar)")),
}
