"""The registered queries of the text operators."""

from __future__ import annotations

from lumera.llm.collocations import OP13_SQL, op13_collocations
from lumera.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from lumera.llm.fingerprints import op5_fingerprints
from lumera.llm.language_id import op7_language_id
from lumera.llm.ngram_join import op9_ngram_jaccard
from lumera.llm.packing import op2_best_fit_packing
from lumera.llm.secret_scan import op10_secret_scan
from lumera.llm.source_mix import op8_source_mix
from lumera.llm.suffix_dedup import op1_suffix_array_dedup
from lumera.llm.token_files import op6_token_files
from lumera.llm.toxicity import op3_toxicity
from lumera.llm.warc import OP11_SQL, op11_warc
from lumera.llm.whitening import op12_whitening

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_source_mix": op8_source_mix,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_secret_scan": op10_secret_scan,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op11_warc": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
