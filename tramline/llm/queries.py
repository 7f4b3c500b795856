"""Queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from . import bm25_packing, byte_bpe, chat_windows, collocations, exact_dedup, merkle, ngram_join, pivot_topk, secret_scan, token_files, toxicity, warc, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_token_files": token_files.op2_token_files,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_warc_normaliser": warc.op4_warc_normaliser,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_merkle_fingerprints": merkle.op7_merkle_fingerprints,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat_windows": chat_windows.op9_chat_windows,
        "op10_bm25_packing": bm25_packing.op10_bm25_packing,
        "op11_whitening": whitening.op11_whitening,
        "op12_pivot_topk": pivot_topk.op12_pivot_topk,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_normaliser": warc.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op9_chat_windows": chat_windows.OP9_SQL,
        "op12_pivot_topk": pivot_topk.OP12_SQL, "op13_collocations": collocations.OP13_SQL,
    }
