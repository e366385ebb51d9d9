from .arrays import (
    center,
    densify,
    format_coo,
    format_dense,
    format_lil,
    format_vector,
    literal_array,
    parse_bracketed,
    parse_numbers,
    parse_vector_text,
)
