"""Reading sequences, token lists, count tables, sketches and count databases.

All readers go through Spark's own sources, so files may be in any store and compressed ones are opened by their suffix.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "file string, rec_no bigint, name string, comment string, seq string, qual string"
#: Suffixes of sequence files, each also with .gz.
FASTA, FASTQ = (".fa", ".fasta", ".fna"), (".fq", ".fastq", ".fnq")


def format_of(path: str) -> tuple[str, bool]:
    """fasta, fastq or unknown, and whether compressed, by suffix."""
    lower = path.lower()
    zipped = lower.endswith(".gz")
    stem = lower.removesuffix(".gz")
    return ("fasta" if stem.endswith(FASTA) else "fastq" if stem.endswith(FASTQ) else "unknown"), zipped


def is_gzipped(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b"


def parse_fastx(text: str, strict: bool = False) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of each record, of either format, over any number of lines.

    A record whose qualities are too short is given without them or, if ``strict``, is an error.
    """
    lines = iter(text.splitlines())
    head = next((x for x in lines if x[:1] in (">", "@")), None)
    while head is not None:
        name, _, comment = head[1:].partition(" ")
        seq, head, quality = [], None, False
        for x in lines:
            if x[:1] in (">", "@"):
                head = x
                break
            if x[:1] == "+":
                quality = True
                break
            seq.append(x.strip())
        whole = "".join(seq)
        qual = None
        if quality:
            got: list[str] = []
            size = 0
            while size < len(whole) and (x := next(lines, None)) is not None:
                got.append(x)
                size += len(x)
            qual = "".join(got)
            if len(qual) != len(whole):
                if strict:
                    raise ValueError(f"qualities of {name} are not as long as its sequence")
                qual = None
            head = next((x for x in lines if x[:1] in (">", "@")), None)
        yield name, comment or None, whole, qual


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTA files, which are read in parallel from the middle too; ``rec_no`` ascends in file order."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("rec_no"), F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "")
    comment = F.regexp_extract(head, r"^\S+\s+(.*)$", 1)
    rows = raw.filter(F.length(F.trim("v")) > 0)
    return rows.select("file", "rec_no", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), body.alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_fastx(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Records of files of either format. A file is parsed by one task, because qualities may look like headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                held = []
                for i, record in enumerate(parse_fastx(text or "", strict)):
                    held.append((file, i, *record))
                    if len(held) == 4096:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), *(pa.string(),) * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "rec_no", "name", "comment", "seq", "qual"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, RECORDS)


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix.lower())


def read_folder(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Records of all sequence files of a folder, told by their suffixes in any case, also with .gz; order by ``lower(file)``, ``rec_no`` for name order."""
    names = [_any_case(x.lstrip(".")) for x in dict.fromkeys(x.lower().removesuffix(".gz") for x in FASTA + FASTQ)]
    return read_fastx(spark, [f"{folder}/*.{{{','.join([*names, *(f'{n}.[gG][zZ]' for n in names)])}}}"], strict)


def read_tokens(spark: SparkSession, path: str | list[str], sep: str = "\n") -> DataFrame:
    """(token): parts between separators, empty ones left out; the last counts without a separator too."""
    return spark.read.option("lineSep", sep).text(path).select(F.col("value").alias("token")).filter(F.length("token") > 0)


def read_counts(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema="token string, cnt bigint")


def read_results(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Result tables with a header, one below the other."""
    return spark.read.csv(paths, header=True, schema=schema) if schema else spark.read.csv(paths, header=True, inferSchema=True)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content"))


def _cell_type(wsize: int, len_bytes: int = 0, pos_bytes: int = 0) -> np.dtype:
    return np.dtype([("counter", ">i8"), ("key", "u1", (wsize,)), *([("len", f">u{len_bytes}")] if len_bytes else []), *([("pos", f">u{pos_bytes}")] if pos_bytes else [])])


def unpack_sketch(raw: bytes, wsize: int, len_bytes: int = 0, pos_bytes: int = 0) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and columns of the non-empty cells of a big-endian sketch file: row, col, counter, and the key's words (n, words).

    Keys have one length, which the header gives, or with ``len_bytes`` each cell has the XOR of its keys' lengths in so many bytes (``len``), and with ``pos_bytes``
    that of their positions (``pos``).
    """
    fixed = len_bytes == 0
    r, epsilon, chunk, *length = struct.unpack_from(">BfQB" if fixed else ">BfQ", raw)
    kind, at = _cell_type(wsize, len_bytes, pos_bytes), struct.calcsize(">BfQB" if fixed else ">BfQ")
    cells = np.frombuffer(raw, kind, r * chunk, at)
    some = np.flatnonzero((cells["counter"] != 0) | cells["key"].any(axis=1))
    words = (wsize + 7) // 8
    padded = np.zeros((len(some), 8 * words), np.uint8)
    padded[:, 8 * words - wsize :] = cells["key"][some]
    columns = {"row": some // chunk, "col": some % chunk, "counter": cells["counter"][some], "words": padded.view(">i8").reshape(-1, words)}
    columns |= {c: cells[c][some] for c in ("len", "pos") if c in kind.names}
    seeds = struct.unpack_from(f">{r}I", raw, at + r * chunk * kind.itemsize)
    return {"repetitions": r, "epsilon": epsilon, "chunk_size": chunk, "key_len": length[0] if fixed else None, "seeds": list(seeds)}, {c: v.astype(np.int64) for c, v in columns.items()}


def pack_sketch(r: int, epsilon: float, chunk: int, length: int, seeds: list[int], row: np.ndarray, col: np.ndarray, counter: np.ndarray, words: np.ndarray) -> bytes:
    """The file of a table of keys of one length, from its non-empty cells; ``words`` has a row of the key's words for each."""
    wsize = (2 * length + 7) // 8
    cells = np.zeros(r * chunk, _cell_type(wsize))
    at = row.astype(np.int64) * chunk + col
    cells["counter"][at] = counter
    cells["key"][at] = np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(at), 8 * ((wsize + 7) // 8))[:, -wsize:]
    return struct.pack(">BfQB", r, epsilon, chunk, length) + cells.tobytes() + struct.pack(f">{r}I", *seeds)


def read_sketches(spark: SparkSession, path: str, wsize: int, len_bytes: int = 0, pos_bytes: int = 0) -> DataFrame:
    """(file, repetitions, epsilon, chunk_size, key_len, seeds, row, col, counter, key, ...) of the cells of sketch files, with the key's words as ``IbltSpec.words`` names them."""
    words = ["key", *(f"key{i}" for i in range(1, (wsize + 7) // 8))]
    extra = [*(["len"] if len_bytes else []), *(["pos"] if pos_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                head, cells = unpack_sketch(raw, wsize, len_bytes, pos_bytes)
                n = len(cells["row"])
                fixed = [pa.array([v] * n, t) for v, t in ((file, pa.string()), (head["repetitions"], pa.int32()), (head["epsilon"], pa.float32()), (head["chunk_size"], pa.int64()), (head["key_len"], pa.int64()), (head["seeds"], pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(cells["row"].astype(np.int32)), *(pa.array(x) for x in (cells["col"], cells["counter"], *cells["words"].T.copy(), *(cells[c] for c in extra)))], names=names)

    names = ["file", "repetitions", "epsilon", "chunk_size", "key_len", "seeds", "row", "col", "counter", *words, *extra]
    kinds = ["string", "int", "float", "bigint", "bigint", "array<bigint>", "int", *["bigint"] * (2 + len(words) + len(extra))]
    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))


def unpack_minhash(raw: bytes) -> tuple[int, list[bytes]]:
    seed, size, width = struct.unpack_from(">IQB", raw)
    return seed, [raw[13 + i * width : 13 + (i + 1) * width] for i in range(size)]


def pack_minhash(seed: int, hashes: list[bytes]) -> bytes:
    width = len(hashes[0]) if hashes else 8
    return struct.pack(">IQB", seed, len(hashes), width) + b"".join(hashes)


def unpack_weighted(raw: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """Seed, k and the pairs of a sketch of 128-bit hashes, little-endian."""
    seed, dim, k, size = struct.unpack_from("<QBBQ", raw)
    if dim != 16:
        raise ValueError("hashes of 16 bytes expected")
    return seed, k, [struct.unpack_from("<QQ", raw, 18 + 16 * i) for i in range(size)]


def pack_weighted(seed: int, k: int, hashes: list[tuple[int, int]]) -> bytes:
    return struct.pack("<QBBQ", seed, 16, k, len(hashes)) + b"".join(struct.pack("<QQ", *h) for h in hashes)


def _sketch_rows(spark: SparkSession, path: str, unpack, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield unpack(file, raw)

    return _files(spark, path).mapInArrow(run, schema)


def read_minhash(spark: SparkSession, path: str) -> DataFrame:
    """(file, seed, rank, h) of minHash sketch files."""

    def rows(file: str, raw: bytes) -> pa.RecordBatch:
        seed, hashes = unpack_minhash(raw)
        n = len(hashes)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([seed] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array(hashes, pa.binary())], names=["file", "seed", "rank", "h"])

    return _sketch_rows(spark, path, rows, "file string, seed bigint, rank int, h binary")


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """(file, seed, k, rank, lo, hi) of weighted sketch files."""

    def rows(file: str, raw: bytes) -> pa.RecordBatch:
        seed, k, hashes = unpack_weighted(raw)
        n = len(hashes)
        pairs = np.array(hashes, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([seed] * n, pa.int64()), pa.array([k] * n, pa.int32()), pa.array(range(1, n + 1), pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["file", "seed", "k", "rank", "lo", "hi"])

    return _sketch_rows(spark, path, rows, "file string, seed bigint, k int, rank int, lo bigint, hi bigint")


_PREFIX, _SUFFIX, _VERSION = b"KMCP", b"KMCS", 0x200
INFO = ("kmer_length", "mode", "counter_size", "lut_prefix_length", "signature_len", "min_count", "max_count")


def pack_database(kmers: dict[str, int], k: int, prefix: int = 4, counter_size: int = 4, both_strands: bool = True, version: int = _VERSION) -> tuple[bytes, bytes]:
    """The two files, table of prefixes and sorted records, of a count database with a single bin."""
    if (k - prefix) % 4:
        raise ValueError("what follows the prefix must fill whole bytes")
    digit = str.maketrans("ACGT", "0123")
    rows = sorted((int(t.translate(digit), 4), c) for t, c in kmers.items())
    shift = 2 * (k - prefix)
    starts = np.searchsorted(np.array([v >> shift for v, _ in rows], np.int64), np.arange(4**prefix))
    size = (k - prefix) // 4
    records = b"".join((v & ((1 << shift) - 1)).to_bytes(size, "big") + min(c, (1 << 8 * counter_size) - 1).to_bytes(counter_size, "little") for v, c in rows)
    if not version:
        head = struct.pack("<6I", k, 0, counter_size, prefix, 1, 0xFFFFFFFF) + struct.pack("<QB", len(rows), not both_strands) + bytes(31)
        return _PREFIX + starts.astype("<u8").tobytes() + head + struct.pack("<I", 0) + struct.pack("<I", len(head) + 4) + _PREFIX, _SUFFIX + records + _SUFFIX
    signature = 1
    table = starts.astype("<u8").tobytes() + struct.pack("<Q", len(rows)) + bytes(4 * ((1 << 2 * signature) + 1))
    head = struct.pack("<7I", k, 0, counter_size, prefix, signature, 1, 0xFFFFFFFF) + struct.pack("<QB", len(rows), not both_strands) + bytes(27)
    return _PREFIX + table + head + struct.pack("<I", _VERSION) + struct.pack("<I", len(head) + 4) + _PREFIX, _SUFFIX + records + _SUFFIX


def database_info(raw: bytes) -> dict:
    """Metadata of a database, from its table of prefixes; checks markers, version (0 or 0x200) and mode."""
    if raw[:4] != _PREFIX or raw[-4:] != _PREFIX:
        raise ValueError("not a table of prefixes")
    (version,) = struct.unpack_from("<I", raw, len(raw) - 12)
    if version not in (0, _VERSION):
        raise ValueError(f"version {version:#x} is not known")
    at = len(raw) - 8 - raw[-8]
    names = [x for x in INFO if version or x != "signature_len"]
    info = {"signature_len": 0} | dict(zip(names, struct.unpack_from(f"<{len(names)}I", raw, at), strict=True))
    if info["mode"]:
        raise ValueError("only whole counts are known")
    total, one_strand = struct.unpack_from("<QB", raw, at + 4 * len(names))
    if not version:
        info["max_count"] |= struct.unpack_from("<I", raw, at + 4 * len(names) + 9)[0] << 32
    return info | {"version": version, "total_kmers": total, "both_strands": not one_strand, "header_at": at}


def _starts(raw: bytes, info: dict) -> np.ndarray:
    """For each bin and prefix, the number of its first record; then the number of all."""
    n = 4 ** info["lut_prefix_length"]
    if info["version"]:
        signatures = 4 * ((1 << 2 * info["signature_len"]) + 1)
        n = (info["header_at"] - 4 - signatures) // 8 - 1
    return np.append(np.frombuffer(raw, "<u8", n, 4).astype(np.int64), info["total_kmers"])


def _records(suffixes: bytes, info: dict) -> np.ndarray:
    if suffixes[:4] != _SUFFIX or suffixes[-4:] != _SUFFIX:
        raise ValueError("not a file of records")
    size = (info["kmer_length"] - info["lut_prefix_length"]) // 4 + info["counter_size"]
    return np.frombuffer(suffixes, np.uint8, info["total_kmers"] * size, 4).reshape(-1, size)


def unpack_database(prefixes: bytes, suffixes: bytes, least: int = 1, most: int = 0xFFFFFFFF, at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(token, cnt) of all records with a count in range, in order within each bin, some at a time."""
    info = database_info(prefixes)
    k, p, counter = info["kmer_length"], info["lut_prefix_length"], info["counter_size"]
    starts, records = _starts(prefixes, info), _records(suffixes, info)
    letters = np.frombuffer(b"ACGT", np.uint8)
    for begin in range(0, len(records), at_once):
        part = records[begin : begin + at_once]
        cnt = part[:, part.shape[1] - counter :].astype(np.int64) @ (1 << 8 * np.arange(counter)) if counter else np.ones(len(part), np.int64)
        kept = np.flatnonzero((cnt >= least) & (cnt <= most)) if counter else np.arange(len(part))
        prefix = (np.searchsorted(starts[:-1], begin + kept, side="right") - 1) % 4**p
        head = prefix[:, None] >> 2 * np.arange(p - 1, -1, -1) & 3
        tail = part[kept, : part.shape[1] - counter, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
        spelled = letters[np.concatenate((head, tail.reshape(len(kept), -1)), axis=1)]
        tokens = pa.array(np.ascontiguousarray(spelled).view(f"S{k}").ravel().tolist(), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([tokens, pa.array(cnt[kept])], names=["token", "cnt"])


def find_in_database(prefixes: bytes, suffixes: bytes, token: str, least: int = 1, most: int = 0xFFFFFFFF) -> int:
    """The count of one k-mer, 0 if it is absent or its count is out of range: by the table of prefixes of each bin, then by halving."""
    info = database_info(prefixes)
    k, p, counter = info["kmer_length"], info["lut_prefix_length"], info["counter_size"]
    if len(token) != k or set(token) - set("ACGT"):
        return 0
    code = int(token.translate(str.maketrans("ACGT", "0123")), 4)
    shift = 2 * (k - p)
    want = (code & ((1 << shift) - 1)).to_bytes(shift // 8, "big")
    starts, records = _starts(prefixes, info), _records(suffixes, info)
    for at in range(code >> shift, len(starts) - 1, 4**p):
        low, high = int(starts[at]), int(starts[at + 1])
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if records[mid, : len(want)].tobytes() < want else (low, mid)
        if low < starts[at + 1] and records[low, : len(want)].tobytes() == want:
            cnt = int.from_bytes(records[low, len(want) :].tobytes(), "little") if counter else 1
            return cnt if not counter or least <= cnt <= most else 0
    return 0


def read_databases(spark: SparkSession, path: str, least: int = 1, most: int = 0xFFFFFFFF) -> DataFrame:
    """(file, token, cnt) of count databases: ``path`` matches the tables of prefixes (.kmc_pre), beside which are the records (.kmc_suf)."""
    pre = _files(spark, path).select(F.regexp_replace("file", r"\.kmc_pre$", "").alias("file"), F.col("content").alias("pre"))
    suf = _files(spark, path.replace(".kmc_pre", ".kmc_suf")).select(F.regexp_replace("file", r"\.kmc_suf$", "").alias("file"), F.col("content").alias("suf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, a, z in zip(*(b.column(c).to_pylist() for c in ("file", "pre", "suf")), strict=True):
                for found in unpack_database(a, z, least, most):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * found.num_rows, pa.string()), *found.columns], names=["file", "token", "cnt"])

    return pre.join(suf, "file").mapInArrow(run, "file string, token string, cnt bigint")


def read_database_info(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata for each count database: (file, kmer_length, ..., total_kmers, both_strands, version)."""
    names = ["version", *INFO, "total_kmers"]

    def rows(file: str, raw: bytes) -> pa.RecordBatch:
        info = database_info(raw)
        return pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([info[c]], pa.int64()) for c in names), pa.array([info["both_strands"]])], names=["file", *names, "both_strands"])

    return _sketch_rows(spark, path, rows, ", ".join(["file string", *(f"{c} bigint" for c in names), "both_strands boolean"]))


def read_distances(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(reference, query, mhj) of distance tables: tab-separated reference, query, distance, p-value and shared hashes as n/d, whose quotient is the similarity."""
    raw = spark.read.csv(path, sep="\t", schema="reference string, query string, distance double, p double, shared string")
    n, d = (F.split("shared", "/")[i].cast("double") for i in (0, 1))
    return raw.filter(F.col("shared").isNotNull()).select("reference", "query", F.try_divide(n, d).alias("mhj"))


def token_length(rows: DataFrame, token: str = "token") -> int | None:
    """The length of the first token of a list or table; None if there is none."""
    first = rows.select(F.length(token).alias("n")).filter("n is not null").first()
    return first["n"] if first else None
