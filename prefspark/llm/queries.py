"""The queries of this subpackage: ``QUERIES`` (name -> builder) and ``ORACLES`` (name -> DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of ``rows`` rows unless the session has a value of its own: documents are long, and a
    batch is held whole by the JVM and by the Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify
    return identify(read(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return (pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components
    return jaccard_components(read(spark, sf_dir, "documents"))


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import report
    return report(read(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents
    return score_documents(read(spark, sf_dir, "documents"))


@query("op7_wavelet_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract
    return extract(read(spark, sf_dir, "pages"))


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents
    return fingerprint_documents(read(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _op11_sql() -> str:
    from .warc import SQL
    return SQL


@query("op11_warc_segments", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip
    return round_trip(read(spark, sf_dir, "pages"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import repair
    return repair(read(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    from .lexical_search import SQL
    return SQL


@query("op13_lexical_search", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
