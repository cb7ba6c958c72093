"""Token counts with a whole-token shortcut.

A sentence-piece BPE model marks word starts by U+2581. Where no vocabulary
string has that mark after another character (checked when the counter is
built), merges never cross from a word into the white space after it, so a text
falls into pre-tokens, each a run of spaces and the run of other characters
behind it, and the counts of these add up. The vocabulary strings that encode
alone as one token are found once, offline, by encoding the vocabulary itself;
pre-tokens among them count one each without any merging, and only the others
go through the library (each once per worker while it is remembered).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

MARK = "▁"
#: Pre-tokens remembered by a worker, each of up to ``LONGEST`` characters.
REMEMBERED, LONGEST = 500_000, 64


class TokenCounter(dict):
    """Maps a pre-token, without its first space, to its number of tokens."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and len(self.sp.encode("a  b ")) == len(self.sp.encode("a")) + len(self.sp.encode(" b")) + 1
        self.single = self.whole_tokens(pieces)
        super().__init__(self.single)

    def whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.sp.encode(words, num_threads=1), strict=True) if len(ids) == 1}

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word)) if word else 1
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.single)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.sp.encode(text))
        words = text.replace(MARK, " ").split(" ")  # in a text the mark stands for a space
        if "" in words:
            words = [w[1:] for w in re.findall(" +[^ ]*", " " + " ".join(words))]
        return sum(map(self.__getitem__, words))


@lru_cache(1)
def counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have none of either. Every row gives a row, repeated ones
    and null ids too; other columns are ignored.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
