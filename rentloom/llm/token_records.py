"""Token sequences in length-delimited binary files with a separate offset index.

A record is ``length`` (8 bytes), its masked checksum (4), the payload, the
payload's masked checksum (4), all little-endian. The payload is the document
id (8 bytes) and the token ids, 2 bytes each while the vocabulary fits, else 4.
Checksums are CRC-32, rotated right by 15 bits plus a constant, so that a
checksum stored next to its data does not look like data.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from rentloom.llm.batches import Memo, raw_texts
from rentloom.session import new_shared_path

MASK_DELTA = 0xA282EAD8
READ_BYTES = 8 << 20      # index rows are read back in groups of about this size
# The split of the byte-level vocabulary, for texts of visible ASCII, Latin letters, spaces and line ends.
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER = re.compile(r"[^ \n!-~À-ÖØ-öø-ɏ]")
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of a whole record; an error if a checksum or length is wrong."""
    length, check = struct.unpack_from("<QI", record)
    payload = record[12:12 + length]
    if check != masked(record[:8]) or len(record) != length + 16 or struct.unpack_from("<I", record, 12 + length)[0] != masked(payload):
        raise ValueError("broken record")
    return payload


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class TokenBytes:
    """Packed ids of a text as the library gives them without added special tokens.

    A text of common characters without special strings is split here; its
    words, which repeat across a corpus, go to the library's byte-pair model
    once each. Any other text goes to the library whole.
    """

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        parts = json.loads(spec)
        split = parts.get("pre_tokenizer") or {}
        self.plain = (parts.get("normalizer") is None and parts["model"]["type"] == "BPE"
                      and _SPLIT.items() <= split.items() and not parts["model"].get("ignore_merges"))
        self.special = [t["content"] for t in parts.get("added_tokens", ())]
        self.alphabet = byte_alphabet()
        self.words = Memo(self._word, 300_000)

    def _word(self, word: str) -> bytes:
        """One word of the byte-pair model, written in its byte alphabet."""
        if word.isascii():
            spelled = word.replace(" ", self.alphabet[32]).replace("\n", self.alphabet[10])
        else:
            spelled = "".join(map(self.alphabet.__getitem__, word.encode()))
        ids = [t.id for t in self.library.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __call__(self, text: str) -> bytes:
        if not self.plain or _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))


def write_records(docs: DataFrame, path: str, spec: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write its record below ``path`` in ascending order of ``id``; returns the offset index.

    ``path`` must be a folder all executors reach. Rows are range-partitioned
    by id and sorted, each task writes one file under a name of its own and
    reports its records, so files of lost or repeated attempts are never listed
    and never read. The index (``file_no``, ``file``, ``doc_id``, ``offset``,
    ``length``, ``n_tokens``) is a table in ``path``. Null texts count as empty
    (the end id alone); a null id comes first and stands as null in the index;
    tied and repeated rows each keep a record, ordered by text.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = picked.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_text")
    ordered = ordered.withColumn("file_no", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, offset, name = TokenBytes(spec), None, 0, f"records-{uuid.uuid4().hex}.bin"
        store, folder = fs.FileSystem.from_uri(path)
        end = np.array([end_id], encode.kind).tobytes()
        try:
            for batch in batches:
                if out is None:
                    store.create_dir(folder)
                    out = store.open_output_stream(f"{folder}/{name}")
                rows = []
                for key, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "_text"), strict=True):
                    packed = encode(raw.decode("utf-8", "replace")) + end
                    record = frame(struct.pack("<q", key or 0) + packed)
                    out.write(record)
                    rows.append((offset, len(record), len(packed) // len(end)))
                    offset += len(record)
                if rows:
                    offsets, lengths, counts = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("file_no"), pa.array([name] * len(rows), pa.string()), batch.column("doc_id"), offsets, lengths, counts],
                        ["file_no", "file", "doc_id", "offset", "length", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    schema = "file_no int, file string, doc_id long, offset long, length long, n_tokens long"
    ordered.mapInArrow(write, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str, wide: bool) -> DataFrame:
    """Read the listed records back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The index is dealt out by stretches of each file, so any task reads any
    stretch, in any order (a shuffled read). Lengths and checksums are verified
    on the way. ``start`` is the number of ids in all records before it: the
    running sum inside a file plus the total of the files before.
    """
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_t"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    bases = totals.select("file_no", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    stretches = index.withColumn("_stretch", F.floor(F.col("offset") / READ_BYTES))
    per_stretch = stretches.groupBy("file_no", "_stretch").agg(F.sum("n_tokens").alias("_t"))
    running = Window.partitionBy("file_no").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    places = (per_stretch.withColumn("_in_file", F.coalesce(F.sum("_t").over(running), F.lit(0)))
              .join(bases, "file_no").select("file_no", "_stretch", (F.col("_in_file") + F.col("_base")).alias("_start")))
    kind = "<u4" if wide else "<u2"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        opened = (None, None)
        for batch in batches:
            starts, counts, checks = [], [], []
            column = {n: batch.column(n).to_pylist() for n in ("file", "_stretch", "doc_id", "offset", "length", "_start")}
            for file, stretch, key, offset, length, base in zip(*column.values(), strict=True):
                if opened[0] != file:
                    opened = file, store.open_input_file(f"{folder}/{file}")
                    at = None
                if at != (stretch, offset):
                    if at is None or at[0] != stretch:
                        start = base
                    opened[1].seek(offset)
                payload = unframe(opened[1].read(length))
                ids = np.frombuffer(payload, kind, offset=8).astype("<u4")
                if struct.unpack_from("<q", payload)[0] != (key or 0):
                    raise ValueError("the index points to another document")
                starts.append(start)
                counts.append(len(ids))
                checks.append(zlib.crc32(ids.tobytes()))
                start, at = start + len(ids), (stretch, offset + length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (starts, counts, checks))],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = stretches.join(places, ["file_no", "_stretch"]).repartition("file_no", "_stretch").sortWithinPartitions("file_no", "offset")
    return (dealt.select("file", "_stretch", "doc_id", "offset", "length", "_start")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_records(docs: DataFrame, spec: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as records and read them back; see :func:`write_records` and :func:`read_records`."""
    folder = new_shared_path(docs.sparkSession, "records")
    path = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    path = re.sub(r"^file:/+", "file:///", path)
    index = write_records(docs, path, spec, end_id, id, text)
    return read_records(index, path, Tokenizer.from_str(spec).get_vocab_size() > 1 << 16)
