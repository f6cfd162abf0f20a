"""Queries of this subpackage by name, and their SQL where SQL can give the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    collocations,
    html_extract,
    kneser_ney,
    language_id,
    mpeg_audio,
    packing,
    piece_bpe,
    secret_scan,
    simhash,
    surrogates,
    tree_bpe,
    turn_repair,
    weak_supervision,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney_quality": kneser_ney.query,
    "op2_html_tree_extract": html_extract.query,
    "op3_recursive_secret_scan": secret_scan.query,
    "op4_surrogate_pii": surrogates.query,
    "op5_tree_concat_bpe": tree_bpe.query,
    "op6_cutting_stock_packing": packing.query,
    "op7_bayes_language_id": language_id.query,
    "op8_mpeg_audio": mpeg_audio.query,
    "op9_bitsliced_simhash": simhash.query,
    "op10_weak_supervision": weak_supervision.query,
    "op11_repair_grammar": turn_repair.query,
    "op12_piece_offsets": piece_bpe.query,
    "op13_phrase_subtrees": collocations.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op13_phrase_subtrees": collocations.ORACLE_SQL}
