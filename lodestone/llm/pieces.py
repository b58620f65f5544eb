"""The pieces of a public vocabulary file, in the order of their ids."""

from __future__ import annotations

from functools import lru_cache

import sentencepiece


@lru_cache(maxsize=4)
def normal_pieces(path: str) -> tuple[tuple[str, int], ...]:
    """``(piece, id)`` without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
