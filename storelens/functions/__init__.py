"""Column-expression helpers (scalar functions X1-X20).  All JVM-side."""

from storelens.functions.text import (clean_html, extract_links, format_price,
                                      fact_sheet, transcript_line)
from storelens.functions.catalog import (clean_variant_ids, embedding_json, options_map,
                                         parse_ts, safe_numbers, split_tags)
from storelens.functions.vector import cosine_similarity, dot, norm
from storelens.functions.misc import (duration_minutes, is_uuid, merge_settings,
                                      total_tokens, usage_cost)

__all__ = [
    "clean_html", "extract_links", "format_price", "fact_sheet", "transcript_line",
    "clean_variant_ids", "embedding_json", "options_map", "parse_ts", "safe_numbers",
    "split_tags", "cosine_similarity", "dot", "norm", "duration_minutes", "is_uuid",
    "merge_settings", "total_tokens", "usage_cost",
]
