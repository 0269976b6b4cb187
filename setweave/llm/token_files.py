"""Token ids in binary files under a canonical, length-limited Huffman code.

Ids are counted over all documents; package-merge gives code lengths of at most ``max_length`` bits, and the canonical
code needs only those lengths. A file holds independent blocks of whole documents in ascending id order. A
block has the documents' ids and token counts, its global position, and the bit offset of every
``STRIDE``-th token of each document: these checkpoints let a reader start there, and let the decoder run all
stretches side by side, one table look-up per token.

Files are written and read by Spark, so they may be in any store: ``<path>/codes`` has (token, length),
``<path>/blocks`` one row per block. Ranges of ids come from approximate quantiles and
each range is sorted by itself; per range, one sum reaches the driver, per token of the vocabulary one count.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows with the same id are
ordered by length and content; a very long document has a block to itself; an empty table gives empty files.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from setweave.llm.common import pieces, remove, save, texts
from setweave.llm.remembered import Remembered
from setweave.llm.repeats import mix, prefix_hashes, run_hashes

BLOCK, STRIDE = 1 << 16, 128
CACHE = 2_000_000

_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

#: Kinds of bytes: other, white space, line break, ASCII letter, punctuation, digit or apostrophe, end of a two-byte letter.
_OTHER, _SPACE, _BREAK, _LETTER, _MARK, _DIGIT, _WIDE = range(7)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = _SPACE, _BREAK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[39, *range(48, 58)]] = _DIGIT
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xE0] = True
#: Pairs of kinds between which a text may be cut.
_CUT = np.zeros(64, bool)
for _before, _after in [(k, s) for k in (_LETTER, _MARK, _DIGIT, _WIDE) for s in (_SPACE, _BREAK)] + [(_LETTER, _MARK), (_MARK, _LETTER)] + [(_BREAK, k) for k in (_LETTER, _MARK, _DIGIT)]:
    _CUT[8 * _before + _after] = True


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, each different piece of text once.

    Such a tokenizer parts text where white space begins, between letters and punctuation, and after a line break that is the only white space there, and never joins
    across; so what is between two such places is encoded alike alone and in its text. A place counts only if both characters are surely of these
    kinds (no apostrophe, which may begin a contraction). A run of white space stays with what follows, on which its parting depends; and no place in or
    beside an added token counts. The ids of at most ``CACHE`` pieces are remembered. A piece is found by a 64-bit hash, but its own bytes decide: one whose
    bytes are not those remembered for its hash is encoded anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.seen = Remembered()

    def _remember(self, h: np.ndarray, pieces_: pa.Array, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode new pieces; where each one's ids are, in the array returned."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces_.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))))
        at = len(self.flat) + np.cumsum(size) - size
        if len(self.seen.hashes) < CACHE:
            order = self.seen.add(h, raw, start, length)
            self.at, self.size = np.concatenate((self.at, at[order])), np.concatenate((self.size, size[order]))
            self.flat = flat
        return at, size, flat

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one after another, and how many each text has."""
        n = len(text)
        _, offsets, data = text.buffers()
        ends = np.frombuffer(offsets, np.int32, n + 1)
        raw = np.frombuffer(data, np.uint8, ends[-1]) if data is not None and ends[-1] else np.zeros(0, np.uint8)
        begins = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            kind = _KIND[raw]
            kind[1:][_LEADS[raw[:-1]]] = _WIDE
            begins[1:-1] = _CUT[kind[:-1] * 8 + kind[1:]]
            # After a break only if what comes before it is surely no white space.
            begins[2:-1] &= (kind[1:-1] != _BREAK) | ((kind[:-2] != _OTHER) & (kind[:-2] != _SPACE) & (kind[:-2] != _BREAK))
            whole = raw.tobytes()
            for token in self.added:
                at = -1
                while (at := whole.find(token, at + 1)) >= 0:
                    begins[at : at + len(token) + 1] = False
        begins[ends] = True
        cuts = np.flatnonzero(begins).astype(np.int32)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        values = pa.concat_arrays([parts.dictionary])
        _, offsets, own = values.buffers()
        start = np.frombuffer(offsets, np.int32, len(values) + 1).astype(np.int64)
        spelled, length = np.frombuffer(own, np.uint8, start[-1]), np.diff(start)
        start = start[:-1]
        h = run_hashes(prefix_hashes(_SYMBOL[spelled]), start, length)
        place = self.seen.find(h, spelled, start, length)
        known = place >= 0
        at, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        flat, new = self.flat, np.flatnonzero(~known)
        if len(new):
            at[new], size[new], flat = self._remember(h[new], values.take(pa.array(new)), spelled, start[new], length[new])
        code = parts.indices.to_numpy(zero_copy_only=False)
        each = size[code]
        upto = np.cumsum(each)
        out = flat[np.repeat(at[code] - (upto - each), each) + np.arange(upto[-1])]
        return out, np.diff(np.concatenate(([0], upto))[np.searchsorted(cuts, ends)])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a tokenizer file; what it remembers outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, max_length: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_length`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_length:
        raise ValueError("too many symbols for this code length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, marks = np.zeros(0), []
    for _ in range(max_length):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        marks.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(marks):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of tokens with given lengths: codes in order of length, then token."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((tokens, lengths))
        self.tokens, self.lengths = tokens[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(order) else 1
        span = 1 << (self.bits - self.lengths)
        codes = (np.cumsum(span) - span) >> (self.bits - self.lengths)
        size = int(tokens.max()) + 1 if len(tokens) else 0
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.tokens], self.length_of[self.tokens] = codes, self.lengths
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Token and length by the next ``bits`` bits."""
        if self._table is None:
            span = 1 << (self.bits - self.lengths)
            tokens, lengths = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
            tokens[: span.sum()], lengths[: span.sum()] = np.repeat(self.tokens, span), np.repeat(self.lengths, span)
            self._table = tokens, lengths
        return self._table

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Of each document: its bits, filled to whole bytes, and its checkpoints as 64-bit integers."""
        length = self.length_of[ids]
        upto = np.concatenate(([0], np.cumsum(length)))
        last = np.cumsum(sizes)
        first = last - sizes
        n_bytes = (upto[last] - upto[first] + 7) >> 3
        byte_at = np.concatenate(([0], np.cumsum(n_bytes)))
        place = upto[:-1] + np.repeat(8 * byte_at[:-1] - upto[first], sizes)
        words = np.zeros((int(byte_at[-1]) >> 2) + 2, np.uint64)
        if len(ids):
            bits = self.code_of[ids] << (64 - length - (place & 31)).astype(np.uint64)
            word = place >> 5
            new = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
            words[word[new]] += np.add.reduceat(bits >> np.uint64(32), new)
            words[word[new] + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), new)
        raw = words.astype(">u4").tobytes()
        marks = []
        for a, b, at in zip(first.tolist(), last.tolist(), byte_at.tolist(), strict=False):
            marks.append((place[a:b:STRIDE] - 8 * at).astype("<i8").tobytes())
        return [raw[a:b] for a, b in zip(byte_at.tolist(), byte_at[1:].tolist(), strict=False)], marks

    def decode(self, raw: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The tokens of stretches that begin at bit offsets ``starts``, one stretch after another."""
        tokens, lengths = self.table()
        data = np.frombuffer(raw + bytes(8), np.uint8)
        out = np.zeros(int(counts.sum()), np.uint32)
        order = np.argsort(-counts, kind="stable")
        bit, put, left = starts[order].astype(np.int64), (np.cumsum(counts) - counts)[order], counts[order]
        shift, mask = 32 - self.bits, (1 << 32) - 1
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, side="left"))
            if n < len(bit):
                bit, put, left = bit[:n], put[:n], left[:n]
            at = bit >> 3
            window = (data[at].astype(np.int64) << 24) | (data[at + 1].astype(np.int64) << 16) | (data[at + 2].astype(np.int64) << 8) | data[at + 3]
            entry = ((window << (bit & 7)) & mask) >> shift
            out[put + step] = tokens[entry]
            bit = bit + lengths[entry]
        return out


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(id, n, ids): each document's ids as little-endian unsigned integers of 16 or, for large vocabularies, 32 bits."""
    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind = "<u4" if wide else "<u2"
        for b in pieces(batches, "text", 4 << 20):
            ids, sizes = encode(texts(b.column("text")))
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            raw, at = ids.astype(kind).tobytes(), np.concatenate(([0], np.cumsum(sizes) * int(kind[-1])))
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes.astype(np.int64)), packed], names=["id", "n", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, schema)


def _unpacked(b: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of ``tokenized`` rows, with their ids in one array and the number of each row."""
    sizes = b.column("n").to_numpy()
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + limit, side="right")))
        part = b.slice(begin, end - begin)
        own = sizes[begin:end]
        raw = b"".join(part.column("ids").to_pylist())
        yield part, np.frombuffer(raw, "<u4" if len(raw) == 4 * own.sum() else "<u2"), own
        begin = end


def _counts(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur and how often: at most one row per entry of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for _, ids, _ in _unpacked(b):
                new = np.bincount(ids)
                if len(new) < len(total):
                    new, total = total, new
                new[: len(total)] += total
                total = new
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    found = tokens.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").toArrow()
    return found.column("token").to_numpy(), found.column("n").to_numpy()


def write_tokens(tokens: DataFrame, path: str, max_length: int = 18) -> None:
    """Write ``tokenized`` rows to ``path`` in ascending id order."""
    spark = tokens.sparkSession
    vocabulary, counts = _counts(tokens)
    code = Code(vocabulary, code_lengths(counts, max(max_length, math.ceil(math.log2(max(2, len(counts)))) + 1)))
    spark.createDataFrame(pa.table({"token": pa.array(code.tokens, pa.int64()), "length": pa.array(code.lengths, pa.int32())})).coalesce(1).write.parquet(f"{path}/codes")

    total = int(counts.sum())
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = max(1, min(math.ceil(total / (4 * BLOCK)), max(shuffle, math.ceil(total / (1 << 23)))))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = tokens.agg(F.percentile_approx("id", shares, 20 * n_ranges).alias("c")).first()["c"] if shares else None
    bounds = np.unique(np.array([c for c in cuts or [] if c is not None], np.int64))

    def ranges_of(ids: pa.Array) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, 0, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            np.add.at(found, ranges_of(b.column("id")), b.column("n").to_numpy())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["range", "n"])

    in_range = dict(map(tuple, tokens.select("id", "n").mapInArrow(sums, "range long, n long").groupBy("range").agg(F.sum("n")).collect()))
    starts, at = {}, 0
    for r in sorted(in_range):
        starts[r] = at
        at += in_range[r]
    shared = spark.sparkContext.broadcast((code, starts))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = shared.value
        for b in batches:
            for part, ids, sizes in _unpacked(b):
                bits, marks = own.encode(ids, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ranges_of(part.column("id")).astype(np.int32)), part.column("id"), part.column("n"), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())], names=["range", "id", "n", "marks", "bits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held, size, number = None, [], 0, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("range", "id", "n", "marks", "bits")), strict=True):
                if start is None:
                    start = shared.value[1][row[0]]
                held.append(row)
                size += row[2]
                if size >= BLOCK:
                    yield block(held, start, number)
                    start, held, size, number = start + size, [], 0, number + 1
        if held:
            yield block(held, start, number)

    id_type = tokens.schema["id"].dataType

    def block(rows: list[tuple], start: int, number: int) -> pa.RecordBatch:
        at, marks = 0, []
        for _, _, _, own, bits in rows:
            marks.append(np.frombuffer(own, "<i8") + 8 * at)
            at += len(bits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[0][0]], pa.int32()),
                pa.array([number], pa.int64()),
                pa.array([start], pa.int64()),
                pa.array([[r[1] for r in rows]]),
                pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
                pa.array([np.concatenate(marks).astype("<i8").tobytes()], pa.binary()),
                pa.array([b"".join(r[4] for r in rows)], pa.binary()),
            ],
            names=["range", "block", "start", "ids", "sizes", "checkpoints", "bits"],
        )

    row = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("marks", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    out = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    dealt = tokens.mapInArrow(coded, row).repartitionById(len(bounds) + 1, F.col("range"))
    dealt.sortWithinPartitions("range", F.col("id").asc_nulls_first(), "n", "bits").mapInArrow(blocks, out).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, ids) of each document in the files; ids as little-endian unsigned 32-bit integers."""
    book = spark.read.parquet(f"{path}/codes").toArrow()
    shared = spark.sparkContext.broadcast(Code(book.column("token").to_numpy(), book.column("length").to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for b in batches:
            for k in range(b.num_rows):
                sizes = np.array(b.column("sizes")[k].as_py(), np.int64)
                marks = np.frombuffer(b.column("checkpoints")[k].as_py(), "<i8")
                lanes = (sizes + STRIDE - 1) // STRIDE
                counts = np.full(len(marks), STRIDE)
                last = np.cumsum(lanes)[lanes > 0] - 1
                counts[last] = (sizes - (lanes - 1) * STRIDE)[lanes > 0]
                raw = code.decode(b.column("bits")[k].as_py(), marks, counts).astype("<u4").tobytes()
                upto = np.cumsum(sizes)
                at = np.concatenate(([0], 4 * upto)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, pa.array(b.column("start")[k].as_py() + upto - sizes), pa.array(sizes), ids], names=["id", "start", "n", "ids"])

    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return blocks.select("start", "ids", "sizes", "checkpoints", "bits").mapInArrow(run, schema)


def encode_to_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, max_length: int = 18) -> None:
    """Tokenize all texts and write the files."""
    tokens = save(tokenized(docs, tokenizer, id_col, text_col, end_id), "tokens")
    write_tokens(tokens, path, max_length)
    remove(docs.sparkSession, tokens)
