"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding.

Texts are exploded into pre-tokens with their positions. To shuffle each word
once and not each occurrence, positions are kept by block (some megabytes of
consecutive texts): a block lists its distinct pre-tokens, and each text is the
sequence of its pre-tokens' places in that list. The words of all blocks are
shuffled by hash, those of one block and hash bucket packed into one row; where
equal words meet, the word is encoded once, and its ids go back to all blocks and
places that asked. A block's ids and texts then meet
and each text is put together by position. Decoding joins the table of the
tokens' bytes, which is as large as the vocabulary: the distinct ids of a block
are joined with it, and a text's bytes are those of its ids by position.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, batched, chain, compress, pairwise
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import LONGEST, REMEMBERED, ends_in_space, ranks
from .common import whole, written

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

BLOCK_CHARS = 24_000_000
#: Hash buckets of words for each shuffle partition, and the most that a block is divided into. Beyond, a bucket is
#: dealt in parts by block, so that rows of words grow with the input and not with its square.
BUCKETS, MOST_BUCKETS = 4, 4096
#: Distinct chunks that one call splits, and pre-tokens that become an Arrow array together.
TOGETHER = 50_000


@lru_cache(1)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


@lru_cache(1)
def word_encoder(rank_file: str, pattern: str) -> Callable[[bytes], list[int]]:
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(rank_file), special_tokens={})._encode_single_piece


def token_table(spark: SparkSession, rank_file: str) -> DataFrame:
    """The token-byte table (token, bytes): one row for each entry of the vocabulary."""
    return spark.createDataFrame([(rank, token) for token, rank in ranks(rank_file).items()], "token int, bytes binary")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The named runs of ``flat``, one after another; indices are made for some of them at a time."""
    import numpy as np

    parts = []
    for at in range(0, len(runs), 1 << 18):
        some = runs[at : at + (1 << 18)]
        n = lengths[some]
        parts.append(flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return parts[0] if len(parts) == 1 else np.concatenate([flat[:0], *parts])


class Block:
    """Distinct pre-tokens (``words``) of a block of texts, and the texts as their places in that list.

    Only distinct chunks are split into pre-tokens, many by one call. A run is the pre-tokens of a distinct chunk, or of
    what has no space before it: a text's first chunk, or all of a text that can't be cut. Texts are sequences of runs.
    """

    def __init__(self, texts: pa.LargeStringArray, split: Callable[[str], list[str]]):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.digest = hashlib.blake2b(pc.binary_length(texts).to_numpy().tobytes(), digest_size=8)
        for text in texts.cast(pa.large_binary()):
            self.digest.update(text.as_buffer())
        pieces = pc.split_pattern(texts, " ")
        counts, found = pieces.value_lengths().to_numpy(), pieces.flatten().dictionary_encode()
        numbers, chunks = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        del pieces, found
        firsts = np.cumsum(counts, dtype=np.int64) - counts
        spaces = np.array([ends_in_space(c) for c in chunks], bool)[numbers]
        spaces[firsts] &= np.array([c != "" for c in chunks], bool)[numbers[firsts]]
        uncut = np.logical_or.reduceat(spaces, firsts)
        kept = ~np.repeat(uncut, counts)
        kept[firsts] = False
        used = np.zeros(len(chunks), bool)
        used[numbers[kept]] = True

        words, lengths, got = [], [], []
        for i, k in enumerate(numbers[firsts].tolist()):
            got += (head := split(texts[i].as_py() if uncut[i] else chunks[k]))
            lengths.append(len(head))
            if len(got) >= TOGETHER:
                words.append(pa.array(got, pa.large_string()))
                got = []
        words.append(pa.array(got, pa.large_string()))
        for part in batched(compress(chunks, used), TOGETHER):
            got = split(" " + " ".join(part))
            # Chunks hold no spaces, so each begins where a pre-token begins with one.
            begins = [i for i, word in enumerate(got) if word[:1] == " "]
            if len(begins) != len(part) or begins[0]:  # the pattern leaves out spaces
                apart = [split(" " + c) for c in part]
                got, begins = list(chain.from_iterable(apart)), [0, *accumulate(map(len, apart[:-1]))]
            words.append(pa.array(got, pa.large_string()))
            lengths += [b - a for a, b in pairwise([*begins, len(got)])]
        listed = pa.concat_arrays(words).dictionary_encode()
        self.words, self.flat = listed.dictionary, listed.indices.to_numpy().astype(np.uint32)
        self.lengths = np.array(lengths, np.int64)

        runs = (len(texts) - 1 + np.cumsum(used))[numbers]
        runs[firsts] = np.arange(len(texts))
        kept[firsts] = True
        self.runs, self.ends = runs[kept], np.cumsum(np.add.reduceat(kept, firsts, dtype=np.int64))

    def places(self) -> Iterator[bytes]:
        """For each text, the places of its pre-tokens."""
        import numpy as np

        flat = gathered(self.flat, np.cumsum(self.lengths) - self.lengths, self.lengths, self.runs)
        ends = np.cumsum(self.lengths[self.runs])[self.ends - 1]
        return (flat[a:b].tobytes() for a, b in pairwise([0, *ends.tolist()]))

    def name(self, number: int) -> int:
        """Names the block by its number and content, so that only equal readings of it meet."""
        return int.from_bytes(self.digest.digest(), "little", signed=True) ^ number


def _planes(places: bytes) -> bytes:
    """Numbers as their first, second, third and fourth bytes, compressed."""
    import numpy as np
    import zstandard

    if not places:
        return b""
    return zstandard.compress(np.frombuffer(places, np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unplanes(packed: bytes) -> np.ndarray:
    import numpy as np
    import zstandard

    if not packed:
        return np.empty(0, "<u4")
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed(parts: list[bytes]) -> tuple[bytes, bytes]:
    """The lengths of byte strings, and all of them as one, compressed."""
    import zstandard

    return _planes(array("I", map(len, parts)).tobytes()), zstandard.compress(b"".join(parts), 3)


def _unpacked(lengths: bytes, body: bytes) -> list[bytes]:
    import zstandard

    whole, out, at = zstandard.decompress(body), [], 0
    for n in _unplanes(lengths).tolist():
        out.append(whole[at : at + n])
        at += n
    return out


def _blocks(batches: Iterator, pattern: str) -> Iterator[tuple[int, Block, pa.Array]]:
    """The texts of a task, in order, as blocks named by the task's number, the block's and its content; with the texts' ids."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, k, held, chars = TaskContext.get().partitionId(), 0, [], 0

    def closed() -> tuple[int, Block, pa.Array]:
        ids = pa.concat_arrays([rows.column("id") for rows in held])
        texts = pa.concat_arrays([rows.column("text").cast(pa.large_string()) for rows in held])
        held.clear()
        block = Block(texts, splitter(pattern))
        return block.name(part << 24 | k), block, ids

    for batch in batches:
        ends, at = [0, *accumulate(pc.utf8_length(batch.column("text")).to_pylist())], 0
        while at < len(batch):
            # Up to and with the text that fills the block.
            stop = min(len(batch), int(np.searchsorted(ends, ends[at] + BLOCK_CHARS - chars)))
            held.append(batch.slice(at, stop - at))
            chars, at = chars + ends[stop] - ends[at], stop
            if chars >= BLOCK_CHARS:
                yield closed()
                k, chars = k + 1, 0
    if held:
        yield closed()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, stored: bool = False) -> DataFrame:
    """Per row its id, n_tokens, ids_sha256 and decoded_sha256; with ``with_ids`` also ``ids`` (array<int>) and ``decoded`` (binary).

    Null and empty texts have no tokens. Repeated rows and null ids each give a row; an
    empty table gives none; columns not named are ignored. The texts are read twice and
    both readings must give the same rows in the same order, also after an executor is
    lost. A stored table does (``stored``); anything else is written to the shared folder first.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not stored:
        rows = written(rows, "bpe-texts")
    # As many partitions as the scan has splits, so that a task's share does not grow with the input.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    buckets = min(BUCKETS * parts, MOST_BUCKETS)
    shares = -(-BUCKETS * parts // buckets)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, _ in _blocks(batches, pattern):
            places, words = [array("I") for _ in range(buckets)], [[] for _ in range(buckets)]
            for place, raw in enumerate(block.words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)):
                bucket = zlib.crc32(raw) % buckets
                places[bucket].append(place)
                words[bucket].append(raw)
            used = [k for k in range(buckets) if words[k]]
            packed = [_packed(words[k]) for k in used]
            columns = [pa.array([name] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([_planes(places[k].tobytes()) for k in used], pa.binary()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "places", "lengths", "words"])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, ids in _blocks(batches, pattern):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), ids.cast(id_type), pa.array(map(_planes, block.places()), pa.binary())], ["block", "id", "places"])

    def encoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        """With each batch, the ids of the words of each of its rows."""
        encode_word, known = word_encoder(rank_file, pattern), {}
        for batch in batches:
            rows = []
            for lengths, words in zip(batch.column("lengths").to_pylist(), batch.column("words").to_pylist(), strict=True):
                out = []
                for word in _unpacked(lengths, words):
                    if (ids := known.get(word)) is None:
                        ids = array("I", encode_word(word)).tobytes()
                        if len(word) <= LONGEST:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = ids
                    out.append(ids)
                rows.append(out)
            yield batch, rows

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in encoded_rows(batches):
            packed = [(_planes(array("I", [len(ids) // 4 for ids in out]).tobytes()), _planes(b"".join(out))) for out in rows]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["block", "places", "lengths", "ids"])

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct ids of each block's words in a batch, as one row: no more than the ids of these words."""
        import numpy as np

        for batch, rows in encoded_rows(batches):
            raw: dict[int, list[bytes]] = {}
            for name, out in zip(batch.column("block").to_pylist(), rows, strict=True):
                raw.setdefault(name, []).extend(out)
            used = [_planes(np.unique(np.frombuffer(b"".join(out), "<u4")).tobytes()) for out in raw.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(raw), pa.int64()), pa.array(used, pa.binary())], ["block", "used"])

    def tokens_once(key: tuple, rows: pa.Table) -> pa.Table:
        """The distinct ids of a block: no more than the vocabulary's size."""
        import numpy as np

        used = np.unique(np.concatenate([*map(_unplanes, rows.column("used").to_pylist())])).astype(np.int32)
        return pa.table([pa.array([key[0].as_py()] * len(used), pa.int64()), pa.array(used, pa.int32())], names=["block", "token"])

    def assemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        if len(texts) == 0:
            raise ValueError("the texts were not the same on their second reading; write them as a table first")
        of_words = words.filter(words.column("token").is_null())
        of_tokens = words.filter(words.column("token").is_valid())

        def table(keys, lengths) -> tuple:
            """Starts and lengths by key; keys that are not there have a negative length, which can't be gathered."""
            starts, own = np.zeros(keys.max(initial=-1) + 1, np.int64), np.full(keys.max(initial=-1) + 1, -1, np.int64)
            starts[keys], own[keys] = np.cumsum(lengths) - lengths, lengths
            return starts, own

        none = [np.empty(0, "<u4")]
        places, lengths, ids_of_words = (np.concatenate(none + [_unplanes(x) for x in of_words.column(c).to_pylist()]).astype(kind) for c, kind in (("places", np.int64), ("lengths", np.int64), ("ids", "<u4")))
        by_place = table(places, lengths)
        bytes_of_tokens = of_tokens.column("bytes").to_pylist()
        by_token = table(of_tokens.column("token").to_numpy().astype(np.int64), np.array([*map(len, bytes_of_tokens)], np.int64))
        bytes_of_tokens, rows = np.frombuffer(b"".join(bytes_of_tokens), np.uint8), []
        for packed in texts.column("places").to_pylist():
            ids = gathered(ids_of_words, *by_place, _unplanes(packed))
            decoded = gathered(bytes_of_tokens, *by_token, ids)
            rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids.astype(np.int32), decoded.tobytes()) if with_ids else ())))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        return pa.table([texts.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=["id", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    rows = rows.select("id", whole("text").alias("text"))
    kind = dict(rows.dtypes)["id"]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    words = rows.mapInArrow(words_of, "block long, bucket int, places binary, lengths binary, words binary").repartition(parts, "bucket", F.pmod("block", F.lit(shares)))
    encoded = words.mapInArrow(ids_of, "block long, places binary, lengths binary, ids binary")
    # The table has the vocabulary's size, whatever the input.
    tokens = words.mapInArrow(tokens_of, "block long, used binary").groupBy("block").applyInArrow(tokens_once, "block long, token int").join(F.broadcast(token_table(docs.sparkSession, rank_file)), "token")
    encoded = encoded.unionByName(tokens, allowMissingColumns=True)
    texts = rows.mapInArrow(texts_of, f"block long, id {kind}, places binary")
    out = texts.repartition(parts, "block").groupBy("block").cogroup(encoded.repartition(parts, "block").groupBy("block")).applyInArrow(assemble, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)
    return out.withColumnRenamed("id", id_col)
