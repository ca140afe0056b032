"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import wraps

from . import bytebpe, covertree, knn, langid, lines, negatives, packing, pii, simhash, substrings, variants, warc, wordbpe
from .common import ship


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    found = [
        covertree.op1_embedding_near_dedup,
        lines.op2_line_dedup,
        pii.op3_pii,
        simhash.op4_simhash,
        knn.op5_top_k,
        bytebpe.op6_byte_bpe,
        substrings.op7_substring_dedup,
        wordbpe.op8_token_counts,
        langid.op9_language_id,
        packing.op10_packing,
        warc.op11_warc,
        variants.op12_spelling_variants,
        negatives.op13_hard_negatives,
    ]
    return {f.__name__: _shipped(f) for f in found}


def oracle_sql():
    return {
        "op1_embedding_near_dedup": covertree.OP1_SQL,
        "op2_line_dedup": lines.OP2_SQL,
        "op5_top_k": knn.OP5_SQL,
        "op7_substring_dedup": substrings.OP7_SQL,
        "op11_warc": warc.OP11_SQL,
        "op12_spelling_variants": variants.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
