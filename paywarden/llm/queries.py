"""The registered queries of this package: (spark, sf_dir) to the full result over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm import (
    direct_codes,
    exact_dedup,
    language_ranks,
    length_buckets,
    licenses,
    merkle,
    order_filters,
    page_template,
    piece_merge,
    quality_trees,
    quant_neighbours,
    quotes,
    rotated_means,
)
from paywarden.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = exact_dedup.ORACLE


@query
def op6_token_codes(spark, sf_dir):
    return direct_codes.encoded_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )


@query
def op8_license_scan(spark, sf_dir):
    return licenses.scan_licenses(
        table(spark, sf_dir, "documents"), known=[*licenses.KNOWN, *licenses.HEADS, *licenses.whole_texts()], paragraphs=True
    )


ORACLES["op8_license_scan"] = licenses.oracle()


@query
def op5_piece_merge(spark, sf_dir):
    return piece_merge.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_quality_trees(spark, sf_dir):
    return quality_trees.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_order_filters(spark, sf_dir):
    return order_filters.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op9_quant_neighbours(spark, sf_dir):
    return quant_neighbours.neighbour_components(table(spark, sf_dir, "embeddings"))


@query
def op7_page_template(spark, sf_dir):
    return page_template.extract_pages(table(spark, sf_dir, "pages"))


@query
def op1_quotation_links(spark, sf_dir):
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


@query
def op3_length_buckets(spark, sf_dir):
    counted = piece_merge.count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return length_buckets.pack_by_length(counted, length=F.col("n"))


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"), shared_folder(spark))


ORACLES["op13_merkle_manifest"] = merkle.ORACLE


@query
def op11_rotated_means(spark, sf_dir):
    return rotated_means.rotated_means(table(spark, sf_dir, "embeddings"))


ORACLES["op11_rotated_means"] = rotated_means.oracle()


@query
def op12_language_ranks(spark, sf_dir):
    return language_ranks.predicted_languages(table(spark, sf_dir, "documents"))
