"""The operators bound to the tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, ensure_checkpoint_dir, shared_path
from .byte_bpe import decode_ids, encode_texts
from .decontaminate import UNITS, find_leaks
from .exact_dedup import exact_dedup
from .infill import fill_in_middle, restore
from .langid import predict_language, train_language
from .line_dedup import line_dedup
from .mixing import mix
from .quality import quality_score, train_quality
from .rendezvous import shard
from .simhash import simhash_components
from .spelling import spelling_variants
from .text import hash_bits, whole
from .token_files import read_token_files, write_token_files
from .word_model import word_pair_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
""")
def op1(spark, sf_dir):
    """Copies of whole texts, the largest doc_id staying."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


@register("op3_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op3(spark, sf_dir):
    """Lines that ten documents or more share, taken out of every text."""
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_rendezvous_sharding")
def op4(spark, sf_dir):
    """Eight shards of equal weight by rendezvous hashing of doc_id."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).alias("text_crc32"))
    out = shard(docs, weights=(1.0,) * 8, carry=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    """Components of whole texts whose fingerprints of 3-word shingles differ in 3 bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents"), words=3, max_bits=3).select("doc_id", "fingerprint", "component_id")


@register("op8_quality_classifier")
def op8(spark, sf_dir):
    """Quality of every text by trees fitted on labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(hash_bits(F.col("doc_id"), 4) != 2)
    model = train_quality(docs, labels, max_rows=20_000)
    out = docs.select("doc_id", (hash_bits(F.col("doc_id"), 4) == 2).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return out.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op10_language_id")
def op10(spark, sf_dir):
    """Language of every whole text by a byte network trained outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs.where(hash_bits(F.col("doc_id"), 4) != 2), max_rows=4000)
    out = docs.select("doc_id", (hash_bits(F.col("doc_id"), 4) == 2).alias("held_out"), predict_language(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@register("op6_token_files")
def op6(spark, sf_dir):
    """Every text's ids written to files of shuffled planes, and summed up from the files."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, vocabulary="byte_bpe_50k.json", end_id=2)
    return read_token_files(spark.read.parquet(f"{path}/ids"))


@register("op7_mixing")
def op7(spark, sf_dir):
    """Sources weighing 3, 1, 2 in turn, 150 % of all words, documents twice at most."""
    out = mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _template_sql(table: str, key: str) -> str:
    """Tokens of a table's texts: key, pos, plain, template (the rules of decontaminate.py, token by token)."""
    units = "|".join(UNITS)
    return rf"""
{table}_raw AS (SELECT * FROM (SELECT {key}, unnest(ts) AS raw, generate_subscripts(ts, 1) AS p FROM (
  SELECT {key}, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS ts FROM {table})) WHERE raw <> ''),
{table}_core AS (SELECT *, lag(raw) OVER (PARTITION BY {key} ORDER BY p) AS before,
  translate(regexp_replace(regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain FROM {table}_raw),
{table}_typed AS (SELECT {key}, p, plain, CASE WHEN regexp_matches(raw, '^\p{{Lu}}\p{{Ll}}+[^\p{{L}}\p{{N}}]*$') AND regexp_matches(before, '[^.!?:]$') THEN '<name>'
  WHEN regexp_full_match(plain, '[0-9][0-9.,:/-]*({units})?') THEN '<number>' ELSE plain END AS kind FROM {table}_core WHERE plain <> ''),
{table}_t AS (SELECT {key}, row_number() OVER w - 1 AS pos, plain,
  CASE WHEN kind = plain AND lag(kind) OVER w = '<number>' AND regexp_full_match(plain, '{units}') THEN '<unit>' ELSE kind END AS template FROM {table}_typed WINDOW w AS (PARTITION BY {key} ORDER BY p)),
{table}_w AS (SELECT {key}, pos, {" || ' ' || ".join(f"lead(template, {k}) OVER w" for k in range(8))} AS win FROM {table}_t WINDOW w AS (PARTITION BY {key} ORDER BY pos))"""


@register("op9_decontamination", f"""
WITH {_template_sql("documents", "doc_id")},{_template_sql("benchmark", "item_id")},
met AS (SELECT doc_id, item_id, b.pos AS ipos, d.pos - b.pos AS off FROM documents_w d JOIN benchmark_w b ON d.win = b.win),
cells AS (SELECT DISTINCT doc_id, item_id, off, ipos + k AS ipos FROM met, range(8) r(k)),
sides AS (SELECT c.*, b.template AS it, b.plain AS ip, d.plain AS dp FROM cells c JOIN benchmark_t b ON b.item_id = c.item_id AND b.pos = c.ipos
  JOIN documents_t d ON d.doc_id = c.doc_id AND d.pos = c.ipos + c.off),
slots AS (SELECT doc_id, item_id, off, it, ip, count(*) AS n, count(DISTINCT dp) AS v, count(*) FILTER (WHERE ip <> dp) AS ch,
  it IN ('<name>', '<number>', '<unit>') AS s FROM sides GROUP BY ALL),
judged AS (SELECT doc_id, item_id, off, sum(CASE WHEN s THEN 0 ELSE n END) AS literals, sum(CASE WHEN s THEN n ELSE 0 END) AS n_slots,
  sum(CASE WHEN s THEN ch ELSE 0 END) AS n_changed FROM slots GROUP BY ALL HAVING sum(CASE WHEN s AND v > 1 THEN 1 ELSE 0 END) = 0),
sized AS (SELECT doc_id, item_id, off, count(DISTINCT ipos) AS n_windows FROM met GROUP BY ALL),
items AS (SELECT item_id, count(*) - 7 AS item_windows FROM benchmark_t GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_changed, n_slots DESC) AS r
  FROM judged JOIN sized USING (doc_id, item_id, off) WHERE literals >= 4 OR n_changed = 0)
SELECT doc_id, item_id, n_windows, item_windows, n_slots::BIGINT AS n_slots, n_changed::BIGINT AS n_changed FROM ranked JOIN items USING (item_id) WHERE r = 1
""")
def op9(spark, sf_dir):
    """Benchmark items found in documents: a row per document and item."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8)
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "item_windows", "n_slots", "n_changed")


@register("op2_pitman_yor")
def op2(spark, sf_dir):
    """Every text's log10 probability by a model learned from nine tenths of the texts."""
    docs = table(spark, sf_dir, "documents")
    return word_pair_scores(docs, hash_bits(F.col("doc_id"), 10) == 0)


@register("op11_fill_in_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""")
def op11(spark, sf_dir):
    """Every whole text as a fill-in-the-middle example, and the text again from the example."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), plain_percent=10, spm_percent=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_spelling_variants")
def op12(spark, sf_dir):
    """Words of all texts with their near words, forms and roots."""
    out = spelling_variants(table(spark, sf_dir, "documents"), ratio=2, min_length=5, min_count=3, one_in=97)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


@register("op13_byte_bpe")
def op13(spark, sf_dir):
    """Every whole text's ids by a rank file, and the bytes that they stand for."""
    out = encode_texts(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_multi_50k.tiktoken")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode_ids(F.col("ids")), 256).alias("decoded_sha256"))
