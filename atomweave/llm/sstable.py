"""Token ids in sorted-string-table shards.

File format (all integers little-endian but keys; varints are LEB128):

    block*      entries in key order, then crc32 of the entries (4 bytes)
        entry   varint shared key prefix, varint rest of key, rest of key, varint start, varint n, n ids of `width` bytes
                (the first entry of a block shares nothing; start: ids of this file before the entry)
    index       varint blocks; per block: varint offset, varint bytes, varint key length, last key
    bloom       varint hash functions, bits
    footer      uint64 x 6: index offset, bloom offset, entries, ids, width, version; 8 bytes magic

Keys are the identifiers in an order-keeping form: a signed 64-bit integer as 8 big-endian bytes with the sign flipped
behind a byte 1; a null as no byte. A lookup reads footer, Bloom filter and index, finds the one block by binary search
and scans it.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, fresh_path, importable, slices, written

MAGIC = b"AWSSTBL1"
BLOCK_BYTES = 64 * 1024
BITS_PER_KEY, HASHES = 10, 7
SHARD_TEXT_BYTES = 24_000_000
FOOTER = struct.Struct("<6Q8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(key: bytes, n_bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(hashes)]


class Writer:
    """Writes entries, in ascending key order, to an open binary stream; holds one block, the index and the keys' hashes."""

    def __init__(self, stream, width: int = 2) -> None:
        self.out, self.width, self.at = stream, width, 0
        self.block, self.last, self.index, self.keys = [], b"", [], []
        self.size = self.entries = self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(self.ids) + _varint(len(ids))
        body = ids.astype(f"<u{self.width}").tobytes()
        self.block += [head, body]
        self.size += len(head) + len(body)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            b = b"".join(self.block)
            self.out.write(b)
            self.out.write(struct.pack("<I", zlib.crc32(b)))
            self.index.append((self.at, len(b), self.last))
            self.at += len(b) + 4
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = _varint(len(self.index)) + b"".join(_varint(o) + _varint(n) + _varint(len(k)) + k for o, n, k in self.index)
        n_bits = max(64, (len(self.keys) * BITS_PER_KEY + 7) // 8 * 8)
        bits = bytearray(n_bits // 8)
        for k in self.keys:
            for i in _bits(k, n_bits, HASHES):
                bits[i >> 3] |= 1 << (i & 7)
        bloom = _varint(HASHES) + bytes(bits)
        self.out.write(index + bloom + FOOTER.pack(self.at, self.at + len(index), self.entries, self.ids, self.width, 1, MAGIC))


class Reader:
    """Reads one shard from an open random-access file of pyarrow."""

    def __init__(self, f) -> None:
        self.f, size = f, f.size()
        index, bloom, self.entries, self.ids, self.width, version, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of this format")
        tail = f.read_at(size - FOOTER.size - index, index)
        n, at = _read_varint(tail, 0)
        self.index = []
        for _ in range(n):
            o, at = _read_varint(tail, at)
            b, at = _read_varint(tail, at)
            k, at = _read_varint(tail, at)
            self.index.append((o, b, tail[at : at + k]))
            at += k
        self.hashes, at = _read_varint(tail, bloom - index)
        self.bloom = tail[at:]

    def block(self, i: int):
        """(key, start, ids) of each entry of block i."""
        offset, size, _ = self.index[i]
        b = self.f.read_at(size + 4, offset)
        if zlib.crc32(b[:size]) != struct.unpack("<I", b[size:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < size:
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            start, at = _read_varint(b, at + rest)
            n, at = _read_varint(b, at)
            yield key, start, np.frombuffer(b, f"<u{self.width}", n, at)
            at += n * self.width

    def scan(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bits(key, len(self.bloom) * 8, self.hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of every entry with this key, in file order."""
        out: list[np.ndarray] = []
        if not self.may_hold(key):
            return out
        i = bisect_left(self.index, key, key=lambda x: x[2])
        while i < len(self.index):
            out += [ids for k, _, ids in self.block(i) if k == key]
            if self.index[i][2] > key:
                break
            i += 1
        return out


class WordEncoder:
    """Whole-text encoding with word_bpe_49k.json of the `tokenizers` library, word by word with a bounded memo.

    The file's normaliser and pre-tokeniser never join what ASCII white space parts, so words encode by themselves.
    Words of plain Latin letters, digits and signs are parted by the file's own pattern and go to the library's model
    directly; all others take the library's whole way.
    """

    CAP = 400_000
    # without the capitals whose small letter lies above U+024F, which level doesn't cover
    PLAIN = re.compile(f"[{''.join(re.escape(c) for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x132, 0x250))) if ord(c.lower()) < 0x250)}]+")

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model, self.memo, self.old, self.parts = self.t.model, {}, {}, {}
        rule = json.loads(self.t.to_str())
        splits = [x for x in rule["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        # bytes as the byte-level step writes them: printable ones stand for themselves, the others follow from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        self.level = {c: "".join(names[x] for x in chr(c).encode()) for c in range(128, 0x250)}

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            if len(self.parts) >= self.CAP:
                self.parts.clear()
            got = self.parts[p] = array("I", [x.id for x in self.model.tokenize(p if p.isascii() else p.translate(self.level))]).tobytes()
        return got

    def word(self, w: str) -> bytes:
        if w.isalpha() and w.isascii():  # the file's pattern leaves it whole
            return self.part(w.lower())
        if self.PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(map(self.part, self.split(w.lower())))
        return array("I", self.t.encode(w, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words, which are distinct. The memo has two parts of CAP

        words: when the new one is full, it becomes the old one, whose words come back as they are met."""
        if len(self.memo) + len(words) > self.CAP:
            self.old, self.memo = self.memo, {}
        memo, out = self.memo, list(map(self.memo.get, words))
        for i, got in enumerate(out):
            if got is None:
                w = words[i]
                got = self.old.get(w)
                out[i] = memo[w] = self.word(w) if got is None else got
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, where those of each text end); Arrow parts the words and tells which are distinct."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        row, every = pc.list_parent_indices(lists), lists.flatten()
        keep = pc.not_equal(every, "")
        every = every.filter(keep).dictionary_encode()
        got = self.words(every.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, n = np.frombuffer(b"".join(got), "<u4"), np.array([len(x) // 4 for x in got], np.int64)
        which = every.indices.to_numpy()
        begin, n = (np.cumsum(n) - n)[which], n[which]
        stop = np.cumsum(n)
        ids = flat[np.arange(n.sum()) + np.repeat(begin - (stop - n), n)]
        count = np.bincount(row.filter(keep).to_numpy(), minlength=len(texts))
        return ids, np.concatenate([[0], stop])[np.cumsum(count)]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian uint32."""
        return self.batch(pa.array([text.encode("utf-8", "replace").decode()]))[0].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer: str, target: str, end_id: int = 1, shard_bytes: int = SHARD_TEXT_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards in ascending doc_id order below the URI ``target``.

    Returns one row a shard: shard, path, docs, ids. Null ids come first; rows that share an id keep an order by text.
    A null text gives the end id alone. A shard is written under a name of its own and then renamed, so a task that is
    run again, or twice at once, leaves the same file.
    """
    spark = docs.sparkSession
    importable(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def write(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        shard = w = None
        for b in slices(batches):
            ids, stops = enc.batch(b.column(1))
            start = 0
            for doc_id, stop, at in zip(b.column(0).to_pylist(), stops.tolist(), b.column(2).to_pylist(), strict=True):
                if w is None:
                    shard, tmp = at, f"{base}/.part-{at:06d}-{xxhash.xxh3_64_hexdigest(str(id(b)) + str(np.random.default_rng().integers(2**62)))}"
                    stream = fs.open_output_stream(tmp)
                    w = Writer(stream)
                w.add(key_of(doc_id), np.concatenate([ids[start:stop], end]))
                start = stop
        if w is not None:
            w.close()
            stream.close()
            path = f"{base}/shard-{shard:06d}.sst"
            fs.move(tmp, path)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{target}/shard-{shard:06d}.sst"]), pa.array([w.entries], pa.int64()), pa.array([w.ids], pa.int64())], ["shard", "path", "docs", "ids"])

    return written(dealt.mapInArrow(write, "shard int, path string, docs long, ids long"), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, read from the files; one task a shard, one block in memory."""
    shards = manifest.withColumn("before", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))
    n = max(1, manifest.count())

    def read(batches):
        for b in slices(batches):
            for uri, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for key, start, ids in Reader(f).scan():
                        rows.append((id_of(key), before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return shards.select("path", "before", "shard").repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the named documents; each shard's Bloom filter and block index are asked, for the few ids of a caller."""
    out: dict[int, list[np.ndarray]] = {d: [] for d in doc_ids}
    for row in manifest.orderBy("shard").toLocalIterator():
        fs, path = pafs.FileSystem.from_uri(row["path"])
        with fs.open_input_file(path) as f:
            r = Reader(f)
            for d in doc_ids:
                out[d] += r.get(key_of(d))
    return out


def op6_token_shards(spark, sf_dir):
    """word_bpe_49k.json, end id 1; the rows come from the files."""
    import public_tokenizers

    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "sst")))
