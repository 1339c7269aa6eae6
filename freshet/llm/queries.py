"""Registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm import bpe, fingerprints, language, licenses, line_dedup, mixing, periodic_runs, prefix_trie, sanitise, shards, simhash, token_counts, vector_join
from freshet.llm.common import documents, kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after two edits of each document: its first 40 characters replace 20 in the middle, then 10 go after a quarter."""
    n = F.char_length("text")
    edits = F.array(
        F.struct((n / 2).cast("int").alias("start"), (n / 2 + 20).cast("int").alias("stop"), F.substring("text", 1, 40).alias("insert")),
        F.struct((n / 4).cast("int").alias("start"), (n / 4 + 10).cast("int").alias("stop"), F.lit("").alias("insert")),
    )
    state = token_counts.build(documents(spark, sf_dir).select("doc_id", "text"))
    state = state.withColumn("n_tokens", F.element_at("sums", 2)).withColumn("edits", edits)
    done = token_counts.update(state, "edits")
    return done.select("doc_id", "n_tokens", F.element_at("sums", 2).alias("edited_n_tokens"), F.size("leaf_chars").alias("n_leaves"), "encoded_chars", F.sha2("text", 256).alias("edited_sha256"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(documents(spark, sf_dir).select("doc_id", "source", mixing.sizes().alias("size")), "sizes")
    mixed = mixing.mix(rows, ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(data) + 16).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = shards.with_slots(shards.assign(rows, "doc_id", 40), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return bpe.decode(encoded).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", language.held_out("doc_id").alias("held_out"))
    model = language.fit(docs.where(~F.col("held_out")), "text", "lang", "doc_id")
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_kept", F.char_length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"), licenses.templates(spark))


@query
def op11_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.scan(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS bigint) AS n_{kind}") for kind in (*(k for k, _ in sanitise.KINDS), "word")]
    base = F.filter("spans", lambda s: s["action"] == "replace")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefix_trie.rebuilt(kept(prefix_trie.ordered(documents(spark, sf_dir, "conversations")), "placed"))
    nodes, ends = prefix_trie.trie(turns, members)
    spread = prefix_trie.digests(ends)
    ends_here = F.sha2(F.array_join(F.coalesce("ends", F.array().cast("array<bigint>")).cast("array<string>"), ","), 256)
    return nodes.join(spread, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", ends_here).alias("ends_sha256")
    )


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text, some of which are first made periodic from a word on, as their id says."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    docs = docs.withColumns({"g": F.floor(F.col("h") / 10), "w": words}).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.array_join(F.expr("transform(sequence(0, n - 1), i -> if(i >= a, w[a + (i - a) % p], w[i]))"), " ")
    found = periodic_runs.runs(docs.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text")))
    longest = F.array_max(F.expr("transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))"))
    found = found.withColumn("top", longest)
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE["op4_license_scan"] = """
with known(template, license, body) as (values {values}),
tw as (select template, license, string_split(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w from known),
tb as (select template, license, len(w) - 1 size, w[i] || ' ' || w[i + 1] bigram, count(*) c from tw, unnest(range(1, len(w))) r(i) group by all),
d as (select row_number() over () rw, doc_id, text from documents where text is not null),
u as (
  select rw, doc_id, 'line' unit, i - 1 as pos, string_split(text, chr(10))[i] raw from d, unnest(range(1, len(string_split(text, chr(10))) + 1)) r(i)
  union all
  select rw, doc_id, 'paragraph', i - 1, p[i] from (select rw, doc_id, regexp_split_to_array(text, '\\n\\s*\\n') p from d), unnest(range(1, len(p) + 1)) r(i) where contains(p[i], chr(10))
  union all
  select rw, doc_id, 'text', 0, text from d where len(regexp_split_to_array(text, '\\n\\s*\\n')) > 1),
uw as (select rw, doc_id, unit, pos, string_split(trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w from u),
ub as (select rw, doc_id, unit, pos, len(w) - 1 n, w[i] || ' ' || w[i + 1] bigram, count(*) c from uw, unnest(range(1, len(w))) r(i) group by all),
s as (
  select rw, doc_id, unit, pos, template, license, 2.0::double * sum(least(ub.c, tb.c)) / (n + size) dice
  from ub join tb using (bigram) group by rw, doc_id, unit, pos, n, template, license, size)
select doc_id, unit, cast(pos as int) as pos, license, cast(dice as double) dice from s where dice >= 0.8
qualify row_number() over (partition by rw, unit, pos order by dice desc, template) = 1
""".replace("{values}", ", ".join(f"({i}, {_quoted(a)}, {_quoted(t)})" for i, (a, t) in enumerate(licenses.TEMPLATES))).replace("{{", "{").replace("}}", "}")


@query
def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_copies(documents(spark, sf_dir, "embeddings"))


ORACLE["op3_vector_join"] = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
least as (select a, min(b) m from reach group by a),
n as (select a, count(*) n from l group by a)
select vec_id, cast(coalesce(n, 0) as bigint) n_links, least(vec_id, coalesce(m, vec_id)) component_id, least(vec_id, coalesce(m, vec_id)) = vec_id kept
from embeddings left join n on n.a = vec_id left join least on least.a = vec_id
"""
