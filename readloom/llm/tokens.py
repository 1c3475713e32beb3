"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a public byte-level BPE vocabulary; a path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest stretch given to the tokenizer at once; longer texts are cut between two pieces of the pattern.
CHUNK = 1 << 16

# Places between two pieces whatever stands around them, the surest kind first. A piece holds white space as its first character or is nothing else, so one
# ends where white space begins, and before the last character of a run of it; a run of letters (digits) ends where something else begins, and a run of
# signs where letters or digits do, unless the sign is an apostrophe, which may open 's and the like. No stretch cut there ends in white space that
# the pattern would split otherwise, so the counts of the stretches add up.
_KINDS = (
    r"(?<=\P{White_Space})(?=\p{White_Space})",
    r"(?<=[a-zA-Z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[0-9a-zA-Z])",
    r"(?<=\p{L})(?=[\p{P}\p{N}])|(?<=\p{N})(?=[\p{P}\p{L}])|(?<=[\p{P}--'])(?=[\p{L}\p{N}])",
)
_LAST = [regex.compile(f"(?V1r){k}") for k in _KINDS]
_NEXT = regex.compile("(?V1)" + "|".join(_KINDS))
_BLANK = regex.compile(r"\p{White_Space}+(?=\p{White_Space}\P{White_Space}|\Z)")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _border(text: str, at: int) -> int:
    """Where the stretch from `at` on ends: the last border within CHUNK characters, else the first after them, else the end of the text."""
    end = at + CHUNK
    if end >= len(text):
        return len(text)
    window = text[at : end + 1]
    for p in _LAST:
        if (m := p.search(window)) and m.start():
            return at + m.start()
    m = _NEXT.search(text, end)
    return m.start() if m else len(text)


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of the whole text. A text over CHUNK is counted in stretches that end between two pieces; a longer unbroken run is counted as a whole."""
    e = encoder(path)
    if len(text) <= CHUNK:
        return len(e.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        if (m := _BLANK.match(text, at)) and m.end() - at > 1 << 10:  # one piece, which the pattern would only find by going back over all of it
            total += len(e._encode_single_piece(m.group()))
            at = m.end()
            continue
        end = _border(text, at)
        total += len(e.encode_ordinary(text[at:end]))
        at = end
    return total


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of the whole text; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(x, tokenizer) if x else 0 for x in s], dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))
