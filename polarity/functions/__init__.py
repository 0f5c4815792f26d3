from polarity.functions.text import (clean, fill_empty, ngrams, parse_message, prefix_number,
                                     split_list, stamp, strict_number, strip_markup, text_state,
                                     words)
from polarity.functions.vecmath import euclidean, manhattan

__all__ = ["clean", "words", "text_state", "ngrams", "split_list", "prefix_number",
           "strict_number", "stamp", "fill_empty", "parse_message", "strip_markup",
           "manhattan", "euclidean"]
