from pairlens.functions.columns import (
    clamp,
    coord_fields,
    decode_key,
    encode_key,
    floor_below,
    init_value,
    split_label,
    sum_of,
    contrast_columns,
)

__all__ = [
    "clamp",
    "coord_fields",
    "contrast_columns",
    "decode_key",
    "encode_key",
    "floor_below",
    "init_value",
    "split_label",
    "sum_of",
]
