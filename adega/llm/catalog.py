"""The operators applied to the driver's tables: one thin query per operator.

A query calls its operator with production parameters on the whole table and
derives the digest columns.  ``ORACLE_SQL`` has the DuckDB twin where SQL can
express the result; the others are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adega.llm.common import table
from adega.llm.extract import extract
from adega.llm.licenses import scan
from adega.llm.lines import drop_frequent_lines
from adega.llm.mixing import by_position, plan_mix
from adega.llm.ngram_join import similar_components
from adega.llm.packing import pack
from adega.llm.pieces import encode_decode
from adega.llm.quality import is_held_out, train, with_scores
from adega.llm.token_ids import tokenizer_path
from adega.llm.token_store import read_token_file, write_token_file
from adega.llm.topk import top_inner_products
from adega.llm.vector_codes import codebooks_sha256, compress, label_errors
from adega.llm.vectors import similar_vectors
from adega.llm.whitening import fit_whitening, whiten
from adega.session import scratch_path


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = with_scores(rows, model, statistics="statistics")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), words=4, threshold=(85, 100))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return by_position(plan.select("doc_id", "size", "source_size", "target", "taken", "positions"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)
    return label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                      F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors, components=16, scale=64.0)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    rows = whiten(vectors, model, scale=64.0).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                       F.col("deviation").try_cast("long").alias("deviation"), F.col("value").alias("whitened"),
                       F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    names = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "n_tokens", F.sha2(names, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_ids": op4_token_ids,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_sentencepiece": op13_sentencepiece,
}

#: characters stripped from a line's ends, as DuckDB text
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
#: A-Z only: DuckDB's lower() would change other letters too
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM places),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""

OP8_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM usable q JOIN usable c ON c.row <> q.row AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _code_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds one after the other, every distance taken."""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cells AS (SELECT row, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS place, len(x) // {parts} AS width FROM kept),
parts AS MATERIALIZED (SELECT row, place // width AS part, place % width AS pos, v FROM cells),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, pos, v AS c FROM parts WHERE row <= {entries})"""]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
  SELECT row, part, min(ROW(d, entry)) AS m FROM (
    SELECT row, part, entry, sum((v - c) * (v - c))::BIGINT AS d FROM parts JOIN book{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < rounds:
            ctes.append(f"""moved{r} AS (
  SELECT part, m[2] AS entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM parts JOIN near{r} USING (row, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c
  FROM book{r} LEFT JOIN moved{r} USING (part, entry, pos))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM (SELECT row, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM near{rounds} GROUP BY row)
JOIN kept USING (row)"""


OP11_SQL = _code_sql(parts=8, entries=16, rounds=6, scale=4096)

ORACLE_SQL: dict[str, str] = {"op7_line_dedup": OP7_SQL, "op8_topk": OP8_SQL, "op11_vector_codes": OP11_SQL}
