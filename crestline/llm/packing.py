"""Best-fit packing of token sequences with several capacities.

Documents become token ids plus an end id; longer ones are cut into pieces of the capacity. A bin (a
training sequence) has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed in order of falling length into the open bin that fits under all three and
is best by the rule: ``norm`` takes the smallest weighted norm of what would be left, ``dot`` the largest
weighted dot product of demand and residual.

Pieces are dealt by hash into groups of a bounded number, each packed by one task; a group leaves a few
partly filled bins, a fixed small share. Pieces with a position (the order of a mix) are dealt by consecutive
ranges of it instead; groups are numbered in that order, and so are a group's bins, by the mean position of
their pieces. Only lengths are shuffled: token ids stay in the task that made
them, as a checksum, and the narrow piece table is written once, so a lost executor costs no second
tokenization of finished tasks' rows.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed one by
one; a document count or attention capacity that a single piece breaks raises an error.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crestline.llm.common import query, small_batches, table, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs; words that a worker keeps before it starts anew, and their bytes at most.
GROUP_PIECES = 16384
#: Cells of positions that are counted for each group, about.
CELLS = 64
CACHE = 800_000
LONGEST = 64
#: Characters for which Python's lower() and the tokenizer's normalizer agree: printable Latin-1. The word pattern of
#: the tokenizer file (fixed value), its classes written out for these in lower case. Other words go through the
#: tokenizer whole.
PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable bytes stand for
    themselves, the others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


class WordTokens(dict):
    """Word (UTF-8) -> token ids, as little-endian unsigned 32-bit bytes; made when a word is first asked for.

    The tokenizer never joins characters over ASCII white space, so a text's ids are those of its words
    in a row. A word that was seen before is one look-up, also as a part of another word; the number and the
    length of kept words are bounded, and keeping them only saves time.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters, self.size = byte_letters(), cache
        self.packed = [struct.pack("<I", n) for n in range(1 + max(self.tokenizer.get_vocab().values()))]

    @staticmethod
    def _parts(word: bytes) -> list[bytes] | None:
        """What the tokenizer cuts a word into, in lower case; None if only the tokenizer can tell."""
        low = word.lower()  # ASCII letters only, as are those of isalpha
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and 32 < low[-1] < 127:  # letters and one other character: no need of the pattern
            return [low[:-1], low[-1:]]
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            return [text.encode()] if text.isalpha() else [p.encode() for p in WORDS.findall(text)]
        return None

    def __missing__(self, word: bytes) -> bytes:
        parts = self._parts(word)
        if parts is None:
            got = b"".join([self.packed[n] for n in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
        elif parts == [word]:
            letters = word.decode() if word.isascii() else "".join(self.letters[b] for b in word)
            got = b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])
        else:
            got = b"".join(map(self.__getitem__, parts))
        if len(word) <= LONGEST:
            if len(self) >= self.size:
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


@functools.lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """Those of this process: later tasks of a worker find the tokenizer loaded and words known."""
    return WordTokens(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           with_source: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' token ids cut at the capacity. Every row
    has a piece 0. With ``with_source`` also ``row``, a number of the row, and its ``source``."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    small_batches(docs.sparkSession)
    extra = [F.monotonically_increasing_id().alias("row"), F.col("source").cast("string")] if with_source else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, step = word_tokens(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out, owner = [], []
            for row, (doc_id, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
                ids = tokens.ids(text or "") + end
                for n, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    out.append((doc_id, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    owner.append(row)
            if out:
                carried = [c.take(pa.array(owner)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)), *carried],
                                                 names=[*_PIECES.names, *batch.schema.names[2:]])

    return docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", row long, source string" * with_source)


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ``lengths`` fall."""
    demands = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1).astype(np.int64)
    if len(lengths) and (demands > np.array(capacities)).any():
        raise ValueError("a piece exceeds a capacity of an empty bin")
    full, w = np.array(capacities, dtype=np.float64), np.array(weights)
    left = np.zeros((len(lengths), 3), dtype=np.int64)  # residuals of the open bins
    names = np.zeros(len(lengths), dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = opened = 0
    for n, need in enumerate(demands):
        if n % 256 == 0 and used:  # bins that not even the smallest piece fits are closed
            stay = (left[:used] >= demands[-1]).all(axis=1)
            kept = int(stay.sum())
            left[:kept], names[:kept], used = left[:used][stay], names[:used][stay], kept
        fits = np.flatnonzero((left[:used] >= need).all(axis=1))
        if len(fits):
            if rule == "dot":
                at = fits[np.argmax((left[fits] / full) @ (w * need / full))]
            else:
                at = fits[np.argmin(((left[fits] - need) / full) ** 2 @ w)]
        else:
            at, used = used, used + 1
            left[at], names[at], opened = capacities, opened, opened + 1
        bins[n], offsets[n] = names[at], capacities[0] - left[at, 0]
        left[at] -= need
    return bins, offsets


def _ranges(parts: DataFrame, groups: int) -> DataFrame:
    """``parts`` with ``dealt``: consecutive ranges of position with about equal numbers of pieces. Pieces
    are counted in CELLS cells a group, which are all that is collected."""
    step = max(1, ((parts.agg(F.max("position")).first()[0] or 0) + 1) // (groups * CELLS))
    cell = F.expr(f"position div {step}").alias("cell")
    counts = sorted(parts.groupBy(cell).agg(F.count("*").alias("n")).collect())
    total, before, dealt = sum(n for _, n in counts), 0, []
    for at, n in counts:
        dealt.append((at, before * groups // total))
        before += n
    found = parts.sparkSession.createDataFrame(dealt, "cell long, dealt long")
    return parts.withColumn("cell", cell).join(F.broadcast(found), "cell").drop("cell")


def pack(parts: DataFrame, tokens: int = CAPACITY, documents: int | None = None, attention: int | None = None,
         rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (the columns of ``pieces``) with sequence_id and offset. Unset capacities never bind:
    a bin of n tokens holds at most n documents and an attention cost of n squared. If ``parts`` has a
    column ``position``, sequence ids follow it: all pieces of a group lie before those of the next one."""
    capacities = (tokens, documents or tokens, attention or tokens * tokens)
    placed = "position" in parts.columns
    parts = written(parts.select(*_PIECES.names, *["position"] * placed), "pieces")
    groups = max(1, math.ceil(parts.count() / group_pieces))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(group["length"].to_numpy(), capacities, rule)
        if placed:
            means = np.bincount(bins, group["position"].to_numpy()) / np.bincount(bins)
            bins = np.argsort(np.argsort(means, kind="stable"), kind="stable")[bins]
        return group.select(_PIECES.names).append_column(
            "sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    row = F.monotonically_increasing_id()  # of a written table; spreads repeated rows
    dealt = _ranges(parts, groups) if placed else parts.withColumn("dealt", F.pmod(F.xxhash64(row), F.lit(groups)).cast("long"))
    return dealt.groupBy("dealt").applyInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
