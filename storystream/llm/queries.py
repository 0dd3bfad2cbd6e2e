"""The operators applied to their whole tables, with production parameters, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storystream.llm import (
    collocations,
    decontam,
    minhash,
    mixing,
    pii,
    quality,
    secrets,
    sharding,
    tokens,
    toxicity,
    urls,
    vectors,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def oracle(sql: str) -> Callable[[Callable], Callable]:
    """The SQL that a query is checked against."""

    def add(fn: Callable) -> Callable:
        ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _count(kind: Column) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    counts = [_count(F.lit(kind)).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # Only what the result shows goes through the exchange; the key is that of the whole text
    placed = sharding.shard(docs.select("doc_id", "text"))
    return placed.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [_count(F.lit(number)).alias(f"n_{kind}") for number, kind in enumerate(pii.KINDS[:4])]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


@oracle("""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs),
at_fx AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
five AS (
  SELECT row, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' '
    || lead(w, 4) OVER o AS w
  FROM at_fx WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, w FROM five WHERE w IS NOT NULL GROUP BY row, w HAVING count(*) > 1),
repeated AS (
  SELECT row, count(DISTINCT i + k) AS n
  FROM (SELECT five.row, i, unnest(range(5)) AS k FROM five JOIN twice USING (row, w)) GROUP BY row),
counted AS (
  SELECT doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\\pL'))) AS n_letter_words,
    length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM split LEFT JOIN repeated USING (row)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words
    OR word_chars > 10 * n_words OR 10 * n_letter_words < 6 * n_words OR n_upper > n_lower OR n_marks > n_words) AS kept
FROM based
""")
@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which rule came first hangs on measured times
    return quality.judge(read(spark, sf_dir, "documents")).drop("rejected_by", "rules_run")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@oracle("""
WITH pieces AS (
  SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
phrases AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (
    SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size)),
known AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM phrases GROUP BY lang, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT * FROM known WHERE size > 1),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND d.f >= c.f
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (
  SELECT lang, phrase, f, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, l.f AS l, r.f AS r, n, k,
    (1000::HUGEINT * cut.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN totals USING (lang)
  JOIN known l ON l.lang = cut.lang AND l.phrase = array_to_string(words[1:k], ' ')
  JOIN known r ON r.lang = cut.lang AND r.phrase = array_to_string(words[k + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""")
@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))
