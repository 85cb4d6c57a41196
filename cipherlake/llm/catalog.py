"""Queries of the operators in this folder, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm import op1_lines, op2_quality, op3_packing, op4_matrices, op5_jaccard, op6_decontamination, op7_language, op8_pii, op9_neighbours, op10_toxicity, op11_ranking, op12_spans, op13_trie
from cipherlake.llm.common import fold, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1_lines.dedup(docs).select("doc_id", F.col("dedup_lines").alias("n_lines"), F.size("dedup_removed").alias("n_removed"), F.col("dedup_removed").alias("removed_lines"),
                                        F.col("dedup_sources").alias("source_ids"), "text")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op2_quality.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 3, 1), metadata_cols=("n_chars",))
    score = op2_quality.score(model, F.col("text"), F.col("n_chars"))
    return docs.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing.pack(table(spark, sf_dir, "documents"))


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_matrices.pack_matrices(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_jaccard.classes(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item of which it holds a copy."""
    docs = table(spark, sf_dir, "documents")
    indexes = op6_decontamination.fit(docs, table(spark, sf_dir, "benchmark"))
    found = docs.select("doc_id", op6_decontamination.leaks(indexes, F.col("text")).alias("leaks"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op7_language.fit(docs, ~fold(F.col("doc_id"), 5, 0))
    return docs.select("doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), op7_language.predict(model, F.col("text")).alias("found")).select("doc_id", "held_out", "found.*")


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in op8_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(op8_pii.listed(base), 256).alias("base_sha256"), op8_pii.listed(F.col("found")).alias("spans"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flagged uses the thresholds by language; predicted uses 0.3 for all."""
    docs = table(spark, sf_dir, "documents")
    model = op10_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 4, 2), lang_col="lang")
    scored = docs.select("doc_id", "lang", fold(F.col("doc_id"), 4, 2).alias("held_out"), op10_toxicity.score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         F.coalesce(op10_toxicity.flagged(model, F.col("score"), F.col("lang")), F.lit(False)).alias("flagged"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op12_spans.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv, path, bytes): each conversation's own turns after the first h, behind the first h of the conversation whose
    id is the multiple of five at or before it (towards zero); h from a hash of the id."""
    own = op13_trie.paths(turns)
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9)).cast("int")
    heads = own.where(F.col("conv") % 5 == 0).select(F.col("conv").alias("base"), F.col("turns").alias("head"))
    both = own.withColumns({"base": F.col("conv") - F.col("conv") % 5, "h": h}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    made = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.withColumn("made", made).select("conv", F.col("made.digest").alias("path"), F.col("made.bytes").alias("bytes"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    nodes = op13_trie.trie(rebuilt).join(op13_trie.id_digests(op13_trie.ends(rebuilt)), "key", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


RANKED_SEARCH = r"""
with docs as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
items as (select item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from (select distinct item_id, text from benchmark where text is not null)),
total as (select cast(count(*) filter (where len(w) > 0) as bigint) as nd, cast(sum(len(w)) as bigint) as l from docs),
tf as (select r, term, cast(count(*) as bigint) as tf from (select r, unnest(w) as term from docs) group by all),
df as (select term, cast(count(*) as bigint) as df from tf group by all),
asked as (select item_id, text, term, count(*) as times from (select item_id, text, unnest(w) as term from items) group by all),
scored as (
  select a.item_id, a.text, d.doc_id, d.r,
         cast(sum(a.times * cast(floor(1000 * ln((2 * total.nd + 2) / (2 * df.df + 1))) as bigint) * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len(d.w) * total.nd) // total.l)))) as bigint) as score
  from asked a join tf using (term) join df using (term) join docs d on d.r = tf.r cross join total group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""

SUBSTRING_DEDUP = r"""
with docs as (select doc_id, row_number() over () as r, coalesce(doc_id, 9223372036854775807) as place, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, place, s, array_to_string(w[s:s + 12], ' ') as g from (select r, place, w, unnest(range(1, len(w) - 11)) as s from docs where len(w) >= 13)),
firsts as (select g, min(place) as least from windows group by g),
gone as (select distinct r, unnest(range(s, s + 13)) as pos from windows join firsts using (g) where least < place),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from docs),
kept as (select r, string_agg(word, ' ' order by pos) as text, count(*) as n from words anti join gone using (r, pos) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from docs left join kept using (r)
"""

CONVERSATION_TRIE = r"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest from conversations where conv_id is not null),
own as (select c, list({'role': role, 'text': text} order by turn nulls first, digest) as turns from t group by c),
ids as (select *, c - c % 5 as b, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(cast(c as varchar)) + 1), lambda i: cast(ascii(substr(cast(c as varchar), i, 1)) as bigint))),
          lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 as h from own),
made as (select i.c, list_concat(coalesce(o.turns, [])[1:i.h], i.turns[i.h + 1:]) as p from ids i left join own o on o.c = i.b),
members as (select c, d, p[1:d] as path, len(p) = d as ended from (select c, p, unnest(range(0, len(p) + 1)) as d from made)),
nodes as (select path, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ended), '')) as ends_sha256, case when d = 0 then 0 else strlen(path[d].text) end as size from members group by path, d),
named as (select n.*, u.conv_id as parent_conv_id, (select count(*) from nodes k where k.d = n.d + 1 and k.path[1:n.d] = n.path) as n_children from nodes n left join nodes u on n.d > 0 and u.d = n.d - 1 and u.path = n.path[1:n.d - 1])
select a.conv_id, cast(a.d as bigint) as depth, a.parent_conv_id, cast(a.n_convs as bigint) as n_convs, cast(any_value(a.n_children) as bigint) as n_children, cast(count(*) filter (where b.n_children = 0) as bigint) as n_leaves,
       cast(sum((b.n_convs - 1) * b.size) as bigint) as saved_tokens, a.ends_sha256
from named a join named b on b.d >= a.d and b.path[1:a.d] = a.path group by a.path, a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.ends_sha256
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_classifier, op3_best_fit_packing, op4_token_matrices, op5_ngram_jaccard, op6_benchmark_decontamination, op7_language_id, op8_weak_supervision_pii, op9_embedding_near_dedup, op10_toxicity_classifier,
    op11_ranked_search, op12_substring_dedup, op13_conversation_trie)}
ORACLE: dict[str, str] = {"op11_ranked_search": RANKED_SEARCH, "op12_substring_dedup": SUBSTRING_DEDUP, "op13_conversation_trie": CONVERSATION_TRIE}
