"""Vectorised text primitives, shared with the core."""

from __future__ import annotations

from tessera.functions.vectext import CHUNK, RangeHash, chunks, codes_of, mix, ngrams, sliding, winnow, word_table, words_of

__all__ = ["CHUNK", "RangeHash", "chunks", "codes_of", "mix", "ngrams", "sliding", "winnow", "word_table", "words_of"]
