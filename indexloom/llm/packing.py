"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

LENGTH = 1024
#: Documents to a group, about.
GROUP_DOCS = 8_192
SEED = 11
#: The id after each document.
END = 0

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the ``tokenizers`` file gives them without its special tokens added; then the end id.

    The merges of a byte-level BPE that splits texts as ``PATTERN`` does run in
    tiktoken, several times as fast and with the same ids. To ``tokenizers``
    go texts that hold one of the file's added tokens, texts that tiktoken's
    pattern engine gives up on (very long runs of white space), and all texts
    of a file of any other kind.
    """

    #: Fixed value: how a byte-level pre-tokeniser splits texts.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.slow.get_added_tokens_decoder().values())
        self.fast = self._merges() if self._plain() else None

    def _plain(self) -> bool:
        """Whether the file is a byte-level BPE as tiktoken has it: no normaliser, the usual split, no added space."""
        kind = json.loads(self.slow.to_str())
        split, model = kind["pre_tokenizer"] or {}, kind["model"]
        bytes_only = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return bool(bytes_only) and model.get("type") == "BPE" and not odd and kind["normalizer"] is None and kind["truncation"] is None and kind["padding"] is None

    def _merges(self):
        import tiktoken

        # printable bytes stand for themselves, the others for letters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.slow.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in token)}
        ranks = {b: i for b, i in ranks.items() if i not in self.slow.get_added_tokens_decoder()}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the engine is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit | MemoryError):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        return np.array([*self._ids(text), END], dtype="<u4")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, ids)`` of full pieces, then what remains."""
    for at in range(0, len(ids), length):
        yield at, ids[at : at + length]


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset for each of ``sizes``, largest first (ties as they come), into the first bin with room.

    The tree holds at each node the largest room below it: bins are its
    leaves, all of full room to begin with. One walk down finds the leftmost
    bin with enough, one walk up mends the maxima.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its ids if asked for; a document is tokenised as it is scanned."""
    path = vocabulary or default_vocabulary()
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    kinds = pa.schema([pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in kinds.names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                for start, part in cut(ids, length):
                    row = (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int32),) if with_ids else ())
                    for column, value in zip(rows, row):
                        column.append(value)
            yield pa.record_batch([pa.array(r, f.type) for r, f in zip(rows, kinds)], schema=kinds)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(of), schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Rows of ``pieces`` with the sequence_id and offset each got.

    A document is its text's ids (null text: none) and an end id, cut into
    full pieces and one rest. Documents fall into groups of about
    ``group_docs`` by a seeded hash of id and place (the row's number as
    scanned, so that repeated rows fall into different groups), and each group
    packs its pieces alone, so a group is what one task holds, at any size of
    input. sequence_id is the group's number times 2^32 plus the bin. Null and
    repeated ids are packed like any; an empty table gives none.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = pieces(docs, id_col, text_col, vocabulary, length, with_ids)
    # a document's pieces follow each other, so its number is that of its first piece
    first = F.monotonically_increasing_id() - F.floor(F.col("start") / length)
    rows = rows.withColumn("sequence_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id", first), F.lit(groups)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        number = group.column("sequence_id")[0].as_py() << 32 if len(group) else 0
        ids = pa.array([number + b for b in bins], pa.int64())
        return group.select(names).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    return rows.groupBy("sequence_id").applyInArrow(fill, _PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
