"""The registered query of each operator over its whole table, and its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.session import shared_dir

from . import collocations, decontaminate, exact_dedup, lm, near_dedup, pii, quality, quotes, resampling, segment, sharding, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register()
def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a model of the documents outside the held-out tenth."""
    return lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SHARDS = 8


@register()
def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by document id, with the shard each row would have among nine."""
    body = F.coalesce("text", F.lit(""))
    keep = [F.col("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")]
    placed = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS, keep)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


PIECES = "piece_bpe_32k.model"


def segmentation_digest(encoded: DataFrame) -> DataFrame:
    """Numbers and digests of encoded rows: ids of the best segmentation, scores of the first and last of the N best."""
    alternatives = F.array_join(F.flatten(F.transform("changes", lambda c: F.transform(c, lambda e: F.concat_ws(":", e["at"].cast("string"), e["drop"].cast("string"), F.array_join(e["ids"], ","))))), ";")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.size("scores").alias("n_best"), F.col("scores")[0].alias("best_score"),
        F.element_at("scores", -1).alias("last_score"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(alternatives, 256).alias("changes_sha256"), "round_trip",
    )


@register()
def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of all documents under the 32k piece vocabulary."""
    pieces = segment.read_model(public_tokenizers.path(PIECES))
    return segmentation_digest(segment.encode(table(spark, sf_dir, "documents"), pieces, ["doc_id"]))


@register()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register(
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest doc_id of a group stays."""
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


@register()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with a digest of the four base kinds."""
    found = pii.spans(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@register(
    r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (
  SELECT conv_id, turn, length(p) - length(replace(p, '>', '')) AS lev, trim(lower(regexp_replace(regexp_replace(line, '^(\s?>)+', ''), '\s+', ' ', 'g'))) AS said
  FROM (SELECT conv_id, turn, line, regexp_extract(line, '^(\s?>)+') AS p FROM (SELECT conv_id, turn, unnest(ls) AS line FROM m))),
o AS (SELECT conv_id, said, min(turn) AS origin FROM l WHERE lev = 0 AND said <> '' GROUP BY ALL),
v AS (SELECT l.conv_id, l.turn, lev, origin, count(*) AS n FROM l JOIN o USING (conv_id, said) WHERE lev > 0 AND said <> '' AND origin < l.turn GROUP BY ALL),
k AS (SELECT conv_id, turn, sum(n)::BIGINT AS n_linked, arg_max(origin, {'a': -lev, 'b': n, 'c': origin}) AS parent FROM v GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM k UNION ALL SELECT up.conv_id, up.turn, k.parent, depth + 1 FROM up JOIN k ON k.conv_id = up.conv_id AND k.turn = up.root),
top AS (SELECT conv_id, turn, max_by(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
p AS (
  SELECT m.conv_id, m.turn, role, text,
    regexp_replace(array_to_string(list_filter(ls, lambda x, i: NOT regexp_matches(x, '^(\s?>)+')
      AND NOT (regexp_matches(x, '^(?i:on|am|le|el|il) .*(?i:wrote|schrieb|a écrit|escribió|ha scritto)\s*:?\s*$') AND coalesce(regexp_matches(ls[i + 1], '^(\s?>)+'), false))), chr(10)), '^\n+|\n+$', '', 'g') AS body,
    len(list_filter(ls, lambda x: regexp_matches(x, '^(\s?>)+') AND trim(regexp_replace(x, '^(\s?>)+', '')) <> '')) AS n_quoted,
    coalesce(n_linked, 0) AS n_linked, coalesce(parent, CASE WHEN m.turn > 0 THEN m.turn - 1 END) AS reply_to, coalesce(root, m.turn) AS thread, coalesce(depth, 0) AS depth
  FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn)
SELECT conv_id, turn, role, body, n_quoted, n_linked, reply_to, thread, depth, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position
FROM p"""
)
def op7_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotes, each message linked to what it answers."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@register()
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of 13 words in all documents."""
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


TOKEN_LIMIT = 512


@register()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the 50k byte-level vocabulary."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@register()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the smallest doc_id each can reach within four bits a link."""
    found = near_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register()
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the words of the benchmark."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id").select("doc_id", "n_features", "weight", "score", "rank")


@register(
    r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM p, range(1, 4) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = cut AND x.phrase = array_to_string(w[1 : cut], ' ')
    JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - cut AND y.phrase = array_to_string(w[cut + 1 : ], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * longer.a < 50 * b.a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of each language, over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register(
    """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))"""
)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    pages, folder = table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(warc.chunked(pages), folder)
    back, kind = warc.records(warc.read_chunks(files, folder, content=False)), dict(pages.dtypes)["page_id"]
    return back.select(
        F.col("id").cast(kind).alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
