"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.llm import alignment, binpack, bitslices, encoding, fuzzy_lines, hard_negatives, lattice_hash, minhash, pii, quality, raking, ratio_rules, subword_lm
from counterpoise.plans.fixtures import u_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_pii_semi_markov")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every whole text: base spans by pattern, more by the semi-Markov field."""
    return pii.find_personal_data(table(spark, sf, "documents"))


@query("op2_best_fit_shards")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    return binpack.assign_shards(table(spark, sf, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


# Temperatures: even out sources and forms, and languages a little.
MIX_TARGETS: dict[str, float | dict[str, float]] = {"source": 0.7, "lang": 0.8, "topic": 0.8}
MIX_RATE, MIX_SWEEPS = 0.7, 8


def mix_dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic_of("text")}


_TOPIC_SQL = """CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN position(' | ' IN text) > 0 THEN 'table'
  WHEN regexp_matches(lower(text), 'licen[cs]e|copyright|rights reserved') THEN 'notice'
  WHEN position('@' IN text) > 0 THEN 'contact' WHEN position('?' IN text) > 0 THEN 'question' ELSE 'prose' END"""


def mix_sql(docs: str = "documents", targets: dict[str, float] = MIX_TARGETS, rate: float = MIX_RATE, sweeps: int = MIX_SWEEPS) -> str:
    """The raking as a chain of common table expressions, up to ``mixed``."""
    names = list(targets)
    cols = ", ".join(names)
    sql = f"""WITH units AS (SELECT *, {_TOPIC_SQL} AS topic, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM {docs}),
cells AS (SELECT coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, topic, sum(tokens)::DOUBLE AS tokens FROM units GROUP BY 1, 2, 3),
shares AS (SELECT *, sum(tokens) OVER () AS total, """ + ", ".join(
        f"CASE WHEN sum(tokens) OVER (PARTITION BY {n}) > 0 THEN pow(sum(tokens) OVER (PARTITION BY {n}) / greatest(sum(tokens) OVER (), 1), {t}) ELSE 0 END AS s_{n}, count(*) OVER (PARTITION BY {n}) AS c_{n}"
        for n, t in targets.items()
    ) + " FROM cells),\nw0 AS (SELECT " + cols + ", tokens, total, " + ", ".join(f"s_{n} / nullif(sum(s_{n} / c_{n}) OVER (), 0) * total AS t_{n}" for n in names)
    sql += f", tokens * {rate} AS weight FROM shares)"
    step = 0
    keep = f"{cols}, tokens, total, " + ", ".join(f"t_{n}" for n in names)
    for _ in range(sweeps):
        for i, n in enumerate(names):
            margin = f"sum(weight) OVER (PARTITION BY {n})"
            value = f"weight * CASE WHEN {margin} > 0 THEN t_{n} * {rate} / {margin} ELSE 1 END"
            sql += f",\nw{step + 1} AS (SELECT {keep}, {value} AS weight FROM w{step})"
            step += 1
        sql += f",\nw{step + 1} AS (SELECT {keep}, least(weight, tokens) AS weight FROM w{step})"
        step += 1
    on = " AND ".join(f"coalesce(u.{n}, chr(0)) = w.{n}" for n in names)
    draw = u_sql("u.doc_id", "mix")
    return sql + f""",
mixed AS (SELECT u.*, least(CASE WHEN w.tokens > 0 THEN w.weight / w.tokens ELSE 1 END, 1) AS chance, {draw} AS draw FROM units u JOIN w{step} w ON {on})"""


@query("op3_raked_mix", mix_sql() + "\nSELECT doc_id, source, lang, topic, tokens, round(chance, 6) AS chance, draw < chance AS kept FROM mixed")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its calibrated chance for a mix of sources, languages and forms, and whether it is drawn."""
    mixed = raking.mix(table(spark, sf, "documents"), MIX_TARGETS, mix_dimensions(), rate=MIX_RATE, sweeps=MIX_SWEEPS)
    return mixed.select(
        "doc_id", "source", "lang", raking.topic_of("text").alias("topic"), F.col("mix_tokens").alias("tokens"),
        F.round("mix_chance", 6).alias("chance"), F.col("mix_kept").alias("kept"),
    )


_TOP_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT r, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0)) a JOIN v b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query("op9_bit_sliced_top_k", _TOP_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others, on quantised components."""
    vectors = table(spark, sf, "embeddings")
    return bitslices.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query("op10_quality_discriminant")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, labels learned outside the held-out third."""
    scored = quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op4_streaming_viterbi")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf, "documents").select("doc_id", encoding.encode_checked("text").alias("e"))
    return docs.select("doc_id", F.size("e.ids").cast("long").alias("n_ids"), F.col("e.ids").alias("ids"), F.col("e.exact").alias("round_trip"))


@query("op5_subword_lattice_likelihood")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of every whole text, summed over all segmentations, beside a word model's."""
    return subword_lm.score_documents(table(spark, sf, "documents"))


@query("op6_similarity_sketching")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of near-duplicate documents on five-word shingles, Jaccard similarity 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_lattice_near_vectors")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of vectors linked by a cosine of 0.9 or more, found by E8 lattice hashing."""
    return lattice_hash.near_vectors(table(spark, sf, "embeddings"))


@query("op7_fuzzy_line_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with letters or digits: the first occurrence of its group, and whether it is the one that stays."""
    groups = fuzzy_lines.line_groups(table(spark, sf, "documents"))
    return groups.select(
        F.col("k").alias("doc_id"), F.col("pos").alias("line"), F.col("first.k").alias("first_doc_id"), F.col("first.pos").alias("first_line"),
        (F.col("first") == F.col("exact")).alias("equal_to_first"), ((F.col("first.k") == F.col("k")) & (F.col("first.pos") == F.col("pos"))).alias("kept"),
    )


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers on every whole text, and how common the links are in the corpus."""
    return alignment.alignment_digest(table(spark, sf, "documents"))


_NEGATIVES_SQL = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pairs AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5"""


@query("op11_slot_hard_negatives", _NEGATIVES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five best positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


_RULES_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
words AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos
  FROM (SELECT r, doc_id, regexp_extract_all(text, '[^ 	-
]+') AS w FROM docs)),
hashed AS (SELECT *, ('0x' || substr(md5(word), 1, 7))::BIGINT AS h, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
pairs AS (SELECT *, lead(h) OVER (PARTITION BY r ORDER BY pos) AS h2 FROM hashed),
grams AS (SELECT r, doc_id, h % {ratio_rules.BUCKETS} AS bucket FROM pairs
  UNION ALL SELECT r, doc_id, (h * 1000003 + h2) % 2147483647 % {ratio_rules.BUCKETS} FROM pairs WHERE h2 IS NOT NULL),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (doc_id IN (FROM trusted)) AS trusted FROM grams GROUP BY bucket),
ratios AS (SELECT bucket, ln((trusted + {ratio_rules.ALPHA}) / (sum(trusted) OVER () + {ratio_rules.ALPHA * ratio_rules.BUCKETS}))
  - ln((raw + {ratio_rules.ALPHA}) / (sum(raw) OVER () + {ratio_rules.ALPHA * ratio_rules.BUCKETS})) AS logs FROM counts),
scores AS (SELECT r, avg(logs) AS score FROM grams JOIN ratios USING (bucket) GROUP BY r),
windows AS (SELECT r, pos, count(*) OVER (PARTITION BY r, word, word2, word3) AS c FROM hashed WHERE word3 IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE c > 1 GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, row_number() OVER (PARTITION BY r, line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^ 	-
]')),
dups AS (SELECT r, count(*) FILTER (n > 1) AS n_dup_lines FROM lines GROUP BY r),
base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score, 0.0) AS score
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN scores USING (r)),
failed AS (SELECT *, n_words < {ratio_rules.MIN_WORDS} OR 100 * n_repeat_words > {ratio_rules.MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {ratio_rules.THRESHOLD} AS kept,
  round(score, 6) AS score FROM failed"""


@query("op12_ratio_quality_rules", _RULES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics of every text and its log-likelihood ratio between the documents labelled good and all documents."""
    docs = table(spark, sf, "documents")
    judged = ratio_rules.judged(docs, ratio_rules.fit(docs, table(spark, sf, "labels")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"rules.{name}").alias(name) for name in names], F.round("rules.score", 6).alias("score"))
