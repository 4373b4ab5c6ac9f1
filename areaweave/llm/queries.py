"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import bpe, decontam, jaccard, langid, layouts, mainpart, merkle, phrases, quality, secrets, suffixes, urlrules, variants, winnow
from areaweave.llm._common import documents, text_or_empty
from areaweave.llm.oracles import ORACLES


def tokenizer_path(name: str) -> str:
    """Where the public vocabularies lie on this machine; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document with a model learnt from three quarters of the ids."""
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    held_out = F.coalesce(fold == 2, F.lit(False))
    pieces = langid.read_pieces(tokenizer_path("piece_bpe_32k.model"))
    langs, table = langid.fit(docs.where(~held_out), pieces)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), pieces, langs, table, keep=["doc_id", "held_out"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_top", "keep")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents; digests of ids and decoded text."""
    made = bpe.encode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])
    return made.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur again."""
    rows = phrases.dedup(documents(spark, sf_dir))
    lost = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", lost.cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start in two places."""
    rows = suffixes.dedup(documents(spark, sf_dir))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item."""
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page URL by the fixed rules, else by rules mined from pages that carry a label.

    A page is labelled by the row of labels of the same id: blocked if that is of low quality or toxic.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "blocked")
    return urlrules.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text; likeness to the edited text and to the next document."""
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    rows = winnow.with_next(winnow.fingerprint(docs, "text", "fp"), "doc_id", ["text", "fp"], ["text"])
    rows = rows.withColumn("edited", winnow.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = winnow.fingerprint(rows, "edited", "efp")
    rows = rows.withColumn("own", winnow.hashes(F.col("fp")))
    nothing = F.array().cast("array<bigint>")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.printed(F.col("fp")).alias("fingerprint"),
        winnow.printed(F.col("efp")).alias("edited_fingerprint"),
        winnow.likeness(F.col("own"), winnow.hashes(F.col("efp"))).alias("near_edited"),
        winnow.likeness(F.col("own"), winnow.hashes(F.coalesce("next_fp", nothing))).alias("near_next"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: counts and digest of the strong ones, and all spans."""
    rows = secrets.find(documents(spark, sf_dir), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    strong = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.printed(strong).cast("binary"), 256).alias("base_sha256"),
        secrets.printed(F.col("spans")).alias("spans"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.join(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its tampered text still leads to the root."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    struck = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    low = F.when(struck, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    leaf = lambda text: merkle.digest(*[F.col(c) for c in columns[:-1]], text)
    rows = documents(spark, sf_dir).select("doc_id", "source", F.col("doc_id").alias("order"), leaf(F.col("text")).alias("leaf"), leaf(low).alias("claim"))
    rows = merkle.prove(rows).withColumn("folded_root", merkle.folded(F.col("claim"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent near word, root of the chain, and counts of every frequent word; some runs lose a code point."""
    runs = documents(spark, sf_dir).select("doc_id", F.explode(variants.runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return variants.group(variants.count(runs.select(F.when(F.pmod(h, F.lit(97)) == 0, spoilt).otherwise(F.col("run")).alias("word"))))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a chain model that is trained on labelled layouts with words of these pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = mainpart.fit(layouts.labelled_pages(layouts.words_of(pages)))
    return mainpart.extract(pages, model, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict:
    return {"op1_langid": op1_langid, "op2_bpe": op2_bpe, "op3_phrases": op3_phrases, "op4_suffixes": op4_suffixes, "op5_decontaminate": op5_decontaminate, "op6_winnow": op6_winnow, "op7_urls": op7_urls, "op8_jaccard": op8_jaccard, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "op11_merkle": op11_merkle, "op12_variants": op12_variants, "op13_html": op13_html}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
