"""Sliding windows over the tokens of a text, by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, STEP = 800, 680  # fixed values: tokens of a chunk, and from one chunk's first to the next one's
TOKENIZER = os.environ.get("LODESTRAND_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_LOADED: dict[str, object] = {}


def windows(n: int, size: int = SIZE, step: int = STEP) -> list[tuple[int, int]]:
    """(first, past the last) of the windows over n tokens; the one that reaches the end is the last."""
    if n <= 0:
        return [(0, 0)]
    return [(at, min(n, at + size)) for at in range(0, max(1, n - size + step), step)]


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def token_chunks(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(id, seq, pos, text, token_count): each text's chunks of ``size`` tokens, ``step`` apart; an empty text is one empty chunk, a null one none."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(tokenizer)
        for b in batches:
            rows = []
            for key, e in zip(b.id, t.encode_batch(list(b.text), add_special_tokens=False)):
                for seq, (lo, hi) in enumerate(windows(len(e.ids), size, step)):
                    rows.append((key, seq, lo, t.decode(e.ids[lo:hi], skip_special_tokens=False), hi - lo))
            yield pd.DataFrame(rows, columns=["id", "seq", "pos", "text", "token_count"]).astype({"seq": "int32", "pos": "int32", "token_count": "int32"})

    some = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return some.mapInPandas(run, f"id {kind}, seq int, pos int, text string, token_count int")
