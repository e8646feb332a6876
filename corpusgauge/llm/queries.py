"""Named queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import bpe, embeddings, infill, jaccard, licenses, packing, periods, quality, shards, substrings, token_counts, toxicity, warc
from corpusgauge.llm.oracles import ORACLES  # noqa: F401
from corpusgauge.llm.shared import new_folder


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_crc32(df: DataFrame, ids: str, out: str = "ids_crc32") -> DataFrame:
    """The unsigned crc32 of binary ids, in place of them."""
    return df.withColumn(out, F.crc32(ids).cast("long")).drop(ids)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_crc32(packing.pack_documents(docs, "doc_id", "text", vocabulary(BYTE_BPE), size=1024, end_id=2), "ids")


def op2_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "shards")
    shards.write_shards(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(WORD_BPE), folder, end_id=2)
    rows = shards.read_shards(spark, folder)
    return with_crc32(rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids"), "ids")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary(BYTE_BPE)
    decoded = bpe.decode(bpe.encode(docs, "text", path).select("doc_id", "ids"), "ids", path)
    return decoded.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents by the byte vocabulary; every third moved to the word vocabulary (a delete and an insert), sent twice; every third revised by one token."""
    docs = table(spark, sf_dir, "documents")
    old, new = token_counts.retokenized(docs, "doc_id", "text", path=vocabulary(WORD_BPE), version="word_bpe_49k", old_path=vocabulary(BYTE_BPE), old_version="byte_bpe_50k")
    none = F.lit(None).cast("long")
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    moved = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    rollup.commit("first", old.select("source", "lang", "tokenizer", none.alias("old_tokens"), F.col("n_tokens").alias("new_tokens")))
    gone = old.where(moved).select("source", "lang", "tokenizer", F.col("n_tokens").alias("old_tokens"), none.alias("new_tokens"))
    come = new.where(moved).select("source", "lang", "tokenizer", none.alias("old_tokens"), F.col("n_tokens").alias("new_tokens"))
    change = gone.unionByName(come)
    rollup.commit("second", change)
    rollup.commit("second", change)
    ended = F.pmod(F.col("doc_id"), F.lit(3)) == 1
    revised = old.where(ended).select("source", "lang", "tokenizer", F.col("n_tokens").alias("old_tokens"), (F.col("n_tokens") + 1).alias("new_tokens"))
    rollup.commit("third", revised)
    return rollup.totals()


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, num=90, den=100)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder)
    return warc.page_digests(warc.read_archives(spark, folder), gaps=False)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth is made periodic: from word a on, original words a .. a+p-1 are repeated to the same number of words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    w, a, p = F.col("planted.w"), F.col("planted.a"), F.col("planted.p")
    # computed for the tenth only: the condition stands around the array
    planted = F.when(h % 10 == 0, F.struct(words.alias("w"), F.floor(h / 10).alias("g")))
    docs = docs.select("doc_id", "text", planted.alias("planted")).withColumn("planted", F.when(F.size("planted.w") > 0, F.struct("planted.w", "planted.g", (F.col("planted.g") % F.size("planted.w")).alias("a"))))
    docs = docs.withColumn("planted", F.when(F.col("planted").isNotNull(), F.struct("planted.w", "planted.a", (1 + F.floor((F.size("planted.w") - F.col("planted.a")) / (3 + F.col("planted.g") % 8))).alias("p"))))
    at = F.transform(w, lambda x, i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    return docs.select("doc_id", F.when(F.col("planted").isNotNull(), F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(with_periods(table(spark, sf_dir, "documents")), "doc_id", "text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = infill.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", seed=7, rate=100, spm=50)
    return infill.digests(pieces).select(F.col("key").alias("doc_id"), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_id_shards, op3_bpe_round_trip, op4_quality_rules, op5_token_rollup, op6_toxicity,
        op7_substring_dedup, op8_ngram_jaccard, op9_embedding_near_dedup, op10_warc, op11_license_scan, op12_periodic_runs, op13_fill_in_middle,
    )
}
