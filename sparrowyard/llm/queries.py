"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express one.

Each applies its operator to the whole of its table and derives digest columns from the operator's output.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowyard.llm import context_mixing, merkle, mixing, neighbours, periodic, pii, quality, sentencepieces, sharding, simhash, substrings, token_files, transcripts
from sparrowyard.llm.common import SPACE, scratch_path, words_of

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = sentencepieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations, each half read by a model that was fitted on the other half.

    One row in four keeps a marker of its speaker, under one of the names that transcripts use; the others show none.
    """
    turns = _table(spark, sf_dir, "conversations").withColumn("half", F.pmod(F.xxhash64("conv_id"), F.lit(2)))
    draw = F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(8))
    names = F.create_map(*[x for r, n in transcripts.NAMES.items() for x in (F.lit(r), F.array(F.lit(n[0].capitalize()), F.lit(n[1].upper())))])
    marker = F.when(draw < 2, F.concat(F.element_at(names, F.col("role"))[draw.cast("int")], F.lit(": ")))
    found = None
    for half in (0, 1):
        model = transcripts.fit(turns.where(F.col("half") != half))
        shown = turns.where(F.col("half") == half).withColumn("text", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))))
        read = transcripts.rendered(transcripts.roles_of(transcripts.lines_of(shown), model))
        found = read if found is None else found.unionByName(read)
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "part", "role", "n_lines", "continues", "rendered")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *map(count, pii.BASE),
        F.sha2(pii.written_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written_spans(F.col("spans")).alias("spans"),
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch_path(spark, "token-ids")
    manifest = token_files.write(_table(spark, sf_dir, "documents"), to, tokenizer_path("word_bpe_49k.json"), end=2)
    return token_files.read(spark, to, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op8_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return quality.figures(_table(spark, sf_dir, "documents")).select("row.doc_id", *q)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verified(_table(spark, sf_dir, "documents"), tampered, ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": F.col("n_chars") + 1})


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_mixing.scores(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; the words of one in ten repeat from some word on."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("w", F.when((h % 10 == 0) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), words_of(F.col("text"))))
    n, g = F.size("w"), F.floor(h / 10)
    at = (g % n).cast("int")
    docs = docs.withColumn("at", at).withColumn("period", (1 + F.floor((n - F.col("at")) / (3 + g % 8))).cast("int"))
    docs = docs.withColumn("text", F.when(F.col("w").isNotNull(), periodic.looped(F.col("w"), F.col("at"), F.col("period"))).otherwise(F.col("text")))
    found = periodic.periodic_runs(docs.select("doc_id", "text"), keep=["doc_id"])
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", best.alias("best")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_duplicates, op2_sentencepiece, op3_weighted_hash_tree, op4_transcript_roles, op5_personal_data,
    op6_repeated_passages, op7_token_files, op8_line_first_quality, op9_nearest_neighbours, op10_entropy_balanced_mix,
    op11_merkle_proofs, op12_context_mixing, op13_periodic_runs,
)}


def _quality_sql() -> str:
    words = lambda t: f"list_filter(string_split_regex({t}, '{SPACE}'), lambda x: x <> '')"
    q = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    part = r"[^|»>\s]+(?:\s[^|»>\s]+){0,2}"
    run = " OR ".join("(" + " AND ".join(f"coalesce(lead(label, {a + k}) OVER (PARTITION BY doc_id ORDER BY i), false)" for k in range(quality.MENU_LINES)) + ")" for a in range(1 - quality.MENU_LINES, 1))
    run = re.sub(r"lead\(label, (-?)(\d+)\)", lambda m: f"{'lag' if m[1] else 'lead'}(label, {m[2]})", run)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, {words("t")} AS w FROM d),
    pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
    tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
    f AS (SELECT doc_id, i, line, len({words("line")}) AS n, lower(trim(line)) AS low, length(line) - length(translate(line, '{quality.SYMBOLS}!', '')) AS marks FROM l),
    g AS (SELECT *, n BETWEEN 1 AND 3 AND length(translate(line, '{quality._LABEL_MARKS}', '')) = length(line) AS label FROM f),
    m AS (SELECT *, label AND ({run}) AS in_menu FROM g),
    judged AS (SELECT doc_id, line, n, n > 0 AND (in_menu
        OR (n >= 10 AND marks * 2 >= n)
        OR (length(trim(line)) >= 3 AND NOT regexp_matches(line, '[\p{{L}}\p{{N}}]'))
        OR (n >= 40 AND NOT regexp_matches(line, '[\p{{P}}]'))
        OR (n <= 3 AND low IN ({q(quality.NAVIGATION)}))
        OR (n <= 40 AND regexp_matches(low, '^{part}(?:\s?[|»>]\s?{part}){{2,}}$'))
        OR (n <= 25 AND regexp_matches(low, '{quality.FURNITURE.replace("'", "''")}'))) AS bad FROM m),
    lost AS (SELECT doc_id, coalesce(sum(length(line)) FILTER (WHERE bad), 0) AS lost, sum(length(line)) AS chars,
        count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM judged GROUP BY 1),
    r AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost, chars
        FROM w JOIN lost USING (doc_id) LEFT JOIN rep USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost > chars * 0.5) AS kept
    FROM r"""


ORACLE_SQL = {"op8_line_first_quality": _quality_sql()}
