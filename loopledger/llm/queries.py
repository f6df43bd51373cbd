"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopledger.llm import (
    best_fit,
    bit_planes,
    block_naming,
    burst_tries,
    char_bayes,
    covering_simhash,
    fm_decontaminate,
    hilbert,
    html_blocks,
    huffman_ids,
    line_frequency,
    randomness,
    toxicity,
)
from loopledger.llm.shared import table, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_sequences(table(spark, sf_dir, "documents"))


def quarter(doc_id):
    """Rows that toxicity does not learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


@query("op8_toxicity_grammar")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity_scores(spark, docs.select("doc_id", "text"), labels, quarter)
    return scored.select("doc_id", F.coalesce(quarter(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         "score", "predicted")


@query("op6_site_line_frequency", line_frequency.SQL.format(
    docs="documents", least=line_frequency.LEAST_PAGES, ratio=line_frequency.RATIO, copied=line_frequency.COPIED)
    + "SELECT doc_id, text, n_lines, n_dropped FROM cleaned")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_frequency.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query("op9_covering_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = covering_simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", covering_simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_fm_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_decontaminate.contaminated_spans(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op3_block_naming_dedup", r"""
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                     regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS t FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS place FROM bare)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY place) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM ranked""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return block_naming.duplicate_groups(docs).drop("n_chars")


@query("op1_huffman_ids")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "huffman")
    huffman_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return huffman_ids.read_ids(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_hilbert_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.place_on_curve(table(spark, sf_dir, "documents"), ["doc_id"])


def third(doc_id):
    """Rows that language identification does not learn from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


@query("op7_char_bayes_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = char_bayes.fit(docs.where(~third(F.col("doc_id"))))
    held_out = F.coalesce(third(F.col("doc_id")), F.lit(False)).alias("held_out")
    return char_bayes.identified(docs.select("doc_id", held_out, "text"), model, F.col("text")).drop("text")


@query("op10_html_block_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def _of_kind(spans, kind: int):
    # one parameter alone: a second one of the function would be the place in the array
    return F.filter(spans, lambda s: s["kind"] == kind)


@query("op11_randomness_battery")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = randomness.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = {k: _of_kind(spans, n) for n, k in enumerate(randomness.KINDS)}
    base = F.filter(spans, lambda s: s["kind"] < randomness.KINDS.index("random"))
    return found.select(
        "doc_id", *[F.size(of[k]).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(randomness.as_text(base), 256).alias("base_sha256"), randomness.as_text(spans).alias("spans"))


@query("op12_bit_plane_clusters", bit_planes.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.with_inertia(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_burst_tries", burst_tries.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_tries.prefix_trie(table(spark, sf_dir, "conversations"), by_text=True)
