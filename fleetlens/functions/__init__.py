"""Column-level building blocks (built-in Spark expressions only, no UDFs)."""

from .paths import (basename, boundary_of, content_hash, depth_after_src,
                    module_of, symbol_of, SRC_DIRS)
from .impact import impact_level, impact_level_n, level_from_rank, level_rank, summary_text

__all__ = [
    "basename", "boundary_of", "content_hash", "depth_after_src", "module_of",
    "symbol_of", "SRC_DIRS", "impact_level", "impact_level_n", "level_from_rank", "level_rank",
    "summary_text",
]
