"""The registered queries of the subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from twinlake.llm.common import table

RULES = {"allow": ["org/", "com/fr/"], "block": ["example.org/es/", "example.org/en/1", "com/de/"]}


def op1_language(spark, sf_dir):
    from pyspark.sql import functions as F

    from twinlake.llm.crf import fit, identify

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixed")


def op2_url_filter(spark, sf_dir):
    from twinlake.llm.urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), **RULES)


def op3_near_duplicates(spark, sf_dir):
    from twinlake.llm.minmax import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=80)


def op4_decontamination(spark, sf_dir):
    from twinlake.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_media(spark, sf_dir):
    from twinlake.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_licenses(spark, sf_dir):
    from twinlake.llm.license import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.selectExpr("* except (expressions)", "concat_ws('\n', expressions) as expressions")


def op7_pii(spark, sf_dir):
    from twinlake.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


def license_base(spark, sf_dir):
    """The columns of op6 that SQL can express."""
    return op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_payload(spark, sf_dir):
    """The columns of op5 that SQL can express."""
    return op5_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def pii_base(spark, sf_dir):
    """The columns of op7 that SQL can express."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op8_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from twinlake.llm.toxicity import fit, held_out, score_toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words", "passages")


def op9_mixing(spark, sf_dir):
    from twinlake.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op10_repeats(spark, sf_dir):
    from twinlake.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_ranked_search(spark, sf_dir):
    from twinlake.llm.ranking import rank

    return rank(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_periodic_runs(spark, sf_dir):
    from twinlake.llm.runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_pieces(spark, sf_dir):
    from public_tokenizers import path

    from twinlake.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), path("piece_bpe_32k.model"))


def queries():
    return {k: f for k, f in globals().items() if callable(f) and (k.startswith("op") or k in ("license_base", "media_payload", "pii_base"))}


def oracle_sql():
    from twinlake.llm import oracles

    return oracles.SQL
