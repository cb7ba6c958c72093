"""Text columns as padded ids with masks and as vectors, and vectors scored by a feed-forward network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semid.functions.text import hash_vector


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def text_to_ids(rows: DataFrame, text_col: str, tokenizer_file: str, length: int, padding: int = 0, special: bool = False) -> DataFrame:
    """Adds ``<text>_ids`` and ``<text>_mask`` (array<int> of ``length``): a text's ids, cut or padded at the end, and 1 for each that is the text's. Null texts are empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            ids = [e.ids[:length] for e in _tokenizer(tokenizer_file).encode_batch(texts, add_special_tokens=special)]
            padded, masks = [x + [padding] * (length - len(x)) for x in ids], [[1] * len(x) + [0] * (length - len(x)) for x in ids]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(padded, kind), pa.array(masks, kind)], [*batch.schema.names, f"{text_col}_ids", f"{text_col}_mask"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("*").mapInArrow(run, f"{kinds}, `{text_col}_ids` array<int>, `{text_col}_mask` array<int>")


Encoder = Callable[[list[str]], "object"]


def encoded(rows: DataFrame, text_col: str, encoder: Callable[[], Encoder] | None = None, width: int = 256, normalize: bool = True, out: str = "vec", at_once: int = 256) -> DataFrame:
    """Adds ``out`` (array<double>): each text's vector by a plugged-in encoder, or by hashed words where none is given.

    ``encoder`` makes, once for each task, a function from a list of texts to as many
    vectors, which then gets up to ``at_once`` texts a call. Null texts are empty; an
    encoder that gives another number of vectors is an error. Unit length unless asked otherwise.
    """
    import pyarrow as pa

    if encoder is None:
        return rows.withColumn(out, hash_vector(F.coalesce(F.col(text_col), F.lit("")), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                x = np.asarray(encode([t or "" for t in part.column(text_col).to_pylist()]), dtype=float)
                if x.ndim != 2 or len(x) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts, but vectors of shape {x.shape}")
                if normalize:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(x.tolist(), pa.list_(pa.float64()))], [*part.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` array<double>")


def feed_forward(rows: DataFrame, vec_col: str, layers: list[tuple[list[list[float]], list[float]]], out: str = "scores") -> DataFrame:
    """Adds ``out`` (array<double>): the vector through linear layers (weights as width x outputs, biases), each but the last cut off below 0. Null vectors give null.

    The weights are the model's, fixed by configuration; they travel with the tasks.
    """
    import numpy as np
    import pyarrow as pa

    net = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(vec_col).to_pylist()
            x = np.asarray([v for v in vecs if v is not None], dtype=float).reshape(-1, len(net[0][0]))
            for i, (w, b) in enumerate(net):
                x = (x if i == 0 else np.maximum(x, 0.0)) @ w + b
            found = iter(x.tolist())
            scores = [None if v is None else next(found) for v in vecs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.list_(pa.float64()))], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("*").mapInArrow(run, f"{kinds}, `{out}` array<double>")
