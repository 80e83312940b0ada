"""Predictors that plug into ``model_probability``: callables that load once per worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of a text that the classifier reads: its input is limited.
MAX_TOKENS = 500


def bag_of_words_logit(weights: dict[str, float], bias: float = 0.0, max_tokens: int = MAX_TOKENS) -> Callable[[], Callable]:
    """A logistic model over lower-cased words between blanks: the smallest predictor that fits the contract."""

    def load():
        terms, values = pa.array(list(weights), pa.string()), np.array([*weights.values(), 0.0])

        def predict(texts: np.ndarray) -> np.ndarray:
            plain = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")))
            words = pc.list_slice(pc.utf8_split_whitespace(plain), 0, max_tokens)
            known = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), len(terms)).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(words).to_numpy()
            return 1.0 / (1.0 + np.exp(-bias - np.bincount(row, values[known], len(texts))))

        return predict

    return load
