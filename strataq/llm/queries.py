"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, ctw, embedding_dedup, exact_dedup, language_id, license_scan, minhash, mixing, sharding, token_files

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_ctw": ctw.op4_ctw,
    "op5_language_id": language_id.op5_language_id,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_minhash": minhash.op10_minhash,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL}
