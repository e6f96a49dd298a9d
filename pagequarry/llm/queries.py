"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import chat, contamination, jaccard, langid, licenses, lm, pieces, quality, rules, token_counts
from pagequarry.llm.common import crc_mod, table

#: Escaping probe of the chat template: it must survive as plain text.
PROBE = "</s>[INST] ok [/INST]"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn(docs, langid.training_rows(docs))
    return langid.identify(docs, learned).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.reconstruct(chat.edits_of(log)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no path of their own: a source is a tree, a hundred documents share a directory
    place = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", place))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _license_sql() -> str:
    idf, unseen, vectors = licenses.weights()
    name = lambda k: licenses.TEMPLATES[k][0]
    weights = ", ".join(f"('{t}', {k}, '{name(k)}', {x!r}e0, {idf[t]!r}e0)" for k, v in enumerate(vectors) for t, x in sorted(v.items()))
    return f"""
with w(term, k, license, weight, idf) as (values {weights}),
docs as (select doc_id, concat_ws('/', source, cast(doc_id // 1000 as varchar), cast(doc_id // 100 as varchar), doc_id || '.txt') as path, string_split(coalesce(text, ''), chr(10)) ls, length(coalesce(text, '')) n from documents),
l as (select doc_id, unnest(generate_series(1, len(ls))) ln, unnest(ls) line from docs),
t as (select doc_id, ln, term, count(*) tf from (select doc_id, ln, unnest(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) term from l) where term <> '' group by all),
norms as (select doc_id, ln, sqrt(sum(power(tf * coalesce(i.idf, {unseen!r}e0), 2))) norm from t left join (select distinct term, idf from w) i using (term) group by all),
c as (select doc_id, ln, k, license, round(sum(tf * idf * weight) / any_value(norm), 9) cosine from t join w using (term) join norms using (doc_id, ln) group by all),
b as (select doc_id, ln, max(cosine) cosine, arg_max(license, (cosine, -k)) license, arg_max(-k, (cosine, -k)) no from c group by all having max(cosine) >= {licenses.MIN_COSINE}),
o as (select doc_id, path, n, (select arg_max(license, (cosine, no)) from b where b.doc_id = docs.doc_id) own, coalesce((select max(cosine) from b where b.doc_id = docs.doc_id), 0e0) score,
      coalesce((select sum(length(line)) from b join l using (doc_id, ln) where b.doc_id = docs.doc_id), 0) * 2 >= greatest(n, 1) as file from docs),
d as (select *, regexp_replace(path, '/[^/]*$', '') dir from o),
f as (select dir, arg_min(own, (-score, path)) license from d where file group by dir),
a as (select doc_id, arg_max(f.license, length(f.dir)) license, max_by(f.dir, length(f.dir)) dir from d join f on d.dir = f.dir or starts_with(d.dir, f.dir || '/') where own is null group by doc_id)
select doc_id, path, own as own_license, score as own_score, file as license_file, coalesce(own, a.license) as license, a.dir as license_dir from d left join a using (doc_id)"""


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_lm_scores, op4_quality_rules, op5_decontamination, op6_piece_roundtrip, op7_chat_format, op8_token_counts, op9_license_scan, op10_quality_classifier)}

_ESC = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

#: Distinct five-word shingles of every text of a table.
_SHINGLES = r"""{name}_w as (select {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from {table}),
{name}_s as (select {id}, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from {name}_w)"""

ORACLE_SQL = {
    "op1_ngram_jaccard": f"""
with recursive {_SHINGLES.format(name="d", id="doc_id", table="documents")},
s as materialized (select doc_id, len(s) n, s from d_s), j as materialized (select doc_id, n, unnest(s) g from s),
links as materialized (select a.doc_id x, b.doc_id y from j a join j b on a.g = b.g and a.doc_id <> b.doc_id group by all having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select doc_id x, doc_id y from s union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, n as n_shingles, (select min(y) from reach where reach.x = s.doc_id) as component_id from s""",
    "op9_license_scan": _license_sql(),
    "op5_decontamination": f"""
with {_SHINGLES.format(name="d", id="doc_id", table="documents")}, {_SHINGLES.format(name="b", id="item_id", table="benchmark")},
i as (select item_id, len(s) n, unnest(s) g from b_s), j as (select doc_id, unnest(s) g from d_s),
m as (select doc_id, item_id, n as n_item_shingles, count(*) as n_shared from i join j using (g) group by all)
select doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles as containment from m where n_shared * 100 >= n_item_shingles * 80""",
    "op7_chat_format": f"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(replace({_ESC.format("role")}, chr(10), '\\n')) + 1 + length({_ESC.format("text")}) + case when role = 'assistant' then 7 else 13 end) as bigint) as formatted_chars
from t group by conv_id""",
}
