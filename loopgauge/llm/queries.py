"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, digest, fim, flac, langid, licenses, linedup, mixing, quality, simhash, suffixdedup, variants, warc

QUERIES = {
    "op1_compression_quality": quality.op1,
    "op2_hyperdimensional_langid": langid.op2,
    "op3_license_rules": licenses.op3,
    "op4_latent_decontamination": decontaminate.op4,
    "op5_warc_normaliser": warc.op5,
    "op6_suffix_dedup": suffixdedup.op6,
    "op7_pfair_mixing": mixing.op7,
    "op8_line_chunk_dedup": linedup.op8,
    "op9_flac_media": flac.op9,
    "op10_simhash_near_dedup": simhash.op10,
    "op11_improbable_features": digest.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_spelling_variants": variants.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_normaliser": warc.ORACLE,
    "op7_pfair_mixing": mixing.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
