"""Queries of this subpackage and, where SQL can express them, their oracles."""

from .byte_bpe import op8_byte_bpe
from .decontaminate import op3_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op7_html_extract
from .jaccard_join import op5_jaccard_join
from .line_dedup import OP9_SQL, op9_line_dedup
from .quality import op4_quality
from .sharding import OP2_SQL, op2_shard_lookup
from .simhash import op11_simhash
from .spelling import op13_spelling
from .substring_dedup import op6_substring_dedup
from .suffix_tree import op1_suffix_tree
from .whitening import op12_whitening

QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_shard_lookup": op2_shard_lookup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extract": op7_html_extract,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op2_shard_lookup": OP2_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL}
