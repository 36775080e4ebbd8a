"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import oracle
from .bpe import op5_byte_bpe
from .byte_dedup import op6_suffix_array_dedup
from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .merkle import op13_merkle_manifest
from .near_dedup import op8_minhash_near_dedup
from .pii import op3_feistel_pseudonyms
from .quality import op1_quality_rules
from .sharding import op4_minimax_sharding
from .substring_dedup import op2_substring_dedup
from .toxicity import op11_toxicity
from .url_filters import OP10_SQL, op10_url_filters
from .warc import OP7_SQL, op7_warc_archives
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_feistel_pseudonyms,
        op4_minimax_sharding,
        op5_byte_bpe,
        op6_suffix_array_dedup,
        op7_warc_archives,
        op8_minhash_near_dedup,
        op9_benchmark_decontamination,
        op10_url_filters,
        op11_toxicity,
        op12_embedding_whitening,
        op13_merkle_manifest,
    )
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracle.OP1,
    "op2_substring_dedup": oracle.OP2,
    "op4_minimax_sharding": oracle.OP4,
    "op6_suffix_array_dedup": oracle.OP6,
    "op7_warc_archives": OP7_SQL,
    "op8_minhash_near_dedup": oracle.OP8,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_url_filters": OP10_SQL,
    "op13_merkle_manifest": oracle.OP13,
}
