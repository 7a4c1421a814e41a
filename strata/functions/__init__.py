from strata.functions.columns import (all_not_null, concat_parts, day_number, first_match,
                                     keep_unless_excluded, later_of, safe_ratio,
                                     seeded_order_key)

__all__ = ["all_not_null", "concat_parts", "day_number", "first_match", "keep_unless_excluded",
           "later_of", "safe_ratio", "seeded_order_key"]
