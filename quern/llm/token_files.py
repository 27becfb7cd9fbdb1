"""Token ids in files of fixed-width, bit-packed blocks.

File format (little-endian; one shard of the corpus per file)
    blocks    each of `block` ids (the last may be shorter), each id in `bits`
              bits, lowest bit first, without gaps, padded with 0 to a whole byte
    offsets   (number of blocks + 1) x u64: where each block begins; the last
              entry is where the blocks end
    documents an Arrow IPC stream: doc_id, start (ids before it in this shard), n
    trailer   40 bytes: magic "QTOKENS1", u64 length of `documents`, u64 number of
              ids, u64 number of blocks, u32 bits, u32 block

`bits` is the least number that holds every id of the vocabulary. A reader
seeks to the trailer, then to the blocks that hold the ids it wants, and
unpacks them with numpy; nothing else of the file is read.

Texts are dealt to shards by ranges of (id, hash of text, turn), so a third of all
rows under one id, or equal throughout, still spread. A shard is written by one task under a name of
its own; only shards that the manifest lists count, so a task that is lost or
run twice leaves at most an unused file. The manifest has one row per shard.

Defined results: a null text is empty and gets the end id alone; null ids come
first; rows with equal ids follow each other in the order of their texts'
hashes; an empty table gives no shards; other columns are not used.
"""

from __future__ import annotations

import math
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._store import fresh_path, shuffle_partitions, written
from quern.llm._text import as_text, byte_view, release, slices

MAGIC = b"QTOKENS1"
TRAILER = struct.Struct("<8sQQQII")
BLOCK_IDS = 1 << 16
SHARD_BYTES = 24 << 20
CACHE_WORDS = 300_000
MARKED_WORDS = 100_000
MARKS = 10_000
SEEN_BITS = 22
TOGETHER = 100
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
PUNCTUATION = string.punctuation


def min_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    values = lanes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7))
    return (values & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Writes ids block by block; holds one block and the documents' places in memory."""

    def __init__(self, stream, bits: int, block: int = BLOCK_IDS):
        self.stream, self.bits, self.block = stream, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = self.at = 0
        self.offsets, self.doc_ids, self.counts = [0], [], []

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.stream.write(raw)
        self.at += len(raw)
        self.offsets.append(self.at)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            held = np.concatenate(self.waiting)
            whole = len(held) // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(held[k : k + self.block])
            self.waiting, self.held = [held[whole:]], len(held) - whole

    def close(self) -> tuple[int, int]:
        if self.held:
            self._put(np.concatenate(self.waiting))
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        doc_ids = pa.chunked_array(self.doc_ids) if self.doc_ids else pa.chunked_array([], pa.int64())
        table = pa.table({"doc_id": doc_ids, "start": pa.array(np.cumsum(counts) - counts), "n": pa.array(counts)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        documents = sink.getvalue()
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(documents)
        self.stream.write(TRAILER.pack(MAGIC, len(documents), self.n_ids, len(self.offsets) - 1, self.bits, self.block))
        self.stream.close()
        return len(counts), self.n_ids


class ShardReader:
    """Random access to one file."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        stream.seek(size - TRAILER.size)
        magic, length, self.n_ids, blocks, self.bits, self.block = TRAILER.unpack(stream.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        begin = size - TRAILER.size - length - 8 * (blocks + 1)
        stream.seek(begin)
        self.offsets = np.frombuffer(stream.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        if self.offsets[-1] != begin:
            raise ValueError("a token file's blocks do not end where its offsets begin")
        self.documents = pa.ipc.open_stream(stream.read(length)).read_all()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start:stop of this shard; reads only the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.stream.seek(int(self.offsets[first]))
        raw = self.stream.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(raw[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def filesystem(uri: str):
    """(pyarrow file system, path) of a file in the shared folder, local or remote."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


def _begins_piece(word: str) -> bool:
    word = word.removeprefix("\n")
    return bool(word) and not word[0].isspace() and word[0] != "\u180e"  # once counted as white space


def _segment(word: str) -> str:
    return word if word[:1] == "\n" else " " + word


class _Known(dict):
    """Ids of words that follow a space, or a line break, which is then their first character.

    A word not among them gets an empty buffer, and waits in `fresh` until all that wait are
    encoded at once; with marks at its end it is made of the word without them, and
    of the marks. A word is kept when it is new for the second time, so that those
    seen once, which are most, take no room; when full, all stays as it is.
    """

    def __init__(self, marks):
        super().__init__()
        self.marks = marks
        self.fresh: dict[str, bytearray] = {}
        self.marked: dict[str, tuple[bytearray, str]] = {}
        self.n_marked, self.seen = 0, bytearray(1 << SEEN_BITS)

    def __missing__(self, word: str) -> bytes | bytearray:
        if word in self.fresh:
            return self.fresh[word]
        if word in self.marked:
            return self.marked[word][0]
        if not _begins_piece(word):
            raise KeyError(word)
        bare = word.rstrip(PUNCTUATION)
        if len(bare) == len(word) or not bare or bare[-1] not in LETTERS:
            self.fresh[word] = found = bytearray()
            return found
        ids = self.get(bare)
        if ids is None:
            self.marked[word] = found, bare = bytearray(), bare
            if bare not in self.fresh:
                self.fresh[bare] = bytearray()
            return found
        ids += self.marks[word[len(bare) :]]
        if self.n_marked < MARKED_WORDS and self.again(word):
            self[word] = ids
            self.n_marked += 1
        return ids

    def again(self, word: str) -> bool:
        at = hash(word) & ((1 << SEEN_BITS) - 1)
        if self.seen[at]:
            return True
        self.seen[at] = 1
        return False

    def settle(self, encode) -> None:
        """Fills the buffers of the words that wait."""
        for (word, found), ids in zip(self.fresh.items(), encode(list(self.fresh)), strict=True):
            found += ids
            if len(self) - self.n_marked < CACHE_WORDS and self.again(word):
                self[word] = ids
        for word, (found, bare) in self.marked.items():
            found += self.fresh[bare] + self.marks[word[len(bare) :]]
        self.fresh, self.marked = {}, {}


class _Marks(dict):
    """Ids of marks at the end of words."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, marks: str) -> bytes:
        ids = self.encode([marks])[0]
        if len(self) < MARKS and len(marks) < 64:
            self[marks] = ids
        return ids


class Encoder:
    """Whole texts to ids, by the tokenizers library; words that recur are encoded once.

    A byte-level pre-tokenizer begins a new piece at every space or line break that a character
    other than white space follows, whatever stands around it, and cuts marks off a
    letter before them. Texts are cut there, and the pieces' ids kept. Where white space or
    nothing follows, no cut is made. A text is cut as if a line break stood before
    it, whose id is dropped. Texts with a special token's string go to the
    library whole, as do all texts under another pre-tokenizer.

    Words that are not known go to the library together; an id that begins with a space or a
    break tells where the next word begins. Those of letters, digits and ASCII punctuation
    go to its model without the pre-tokenizer, which would cut them where
    letters, digits and punctuation meet; if no token of the vocabulary
    reaches over such a place or over a space, which is looked up once, no merge does, and the
    model gives the same ids without the cuts.
    """

    _SIMPLE = re.compile(rf"(?:[ \n][{LETTERS}0-9!-&(-/:-@\[-`{{-~]+)*")

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        spec, vocab = json.loads(self.library.to_str()), self.library.get_vocab(False)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.cuts = plain and "\u010a" in vocab and not any(" " in t or "\n" in t for t in self.special)
        self.visible = dict(zip([*range(33), *range(127, 161), 173], range(256, 324), strict=True))  # the bytes that byte-level tokens write as other characters
        self.shown = np.array([self.visible.get(c, c) for c in range(256)], "<u4")
        self.direct = self.cuts and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not any(self._reaches_over(t) for t in vocab)
        self.merges = Tokenizer(self.library.model) if self.direct else None
        self.begins = np.zeros(max([self.vocabulary, *(i + 1 for i in vocab.values())]), bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.after = _Known(_Marks(self._encode))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _reaches_over(self, token: str) -> bool:
        back = {chr(v): chr(k) for k, v in self.visible.items()}
        text = "".join(back.get(c, c) for c in token).removeprefix(" ")
        raw = bytes(map(ord, text)) if all(ord(c) < 256 for c in text) else b"'"
        if b"'" in raw or not re.fullmatch(rb"[\x80-\xbf]?(?:[\x00-\x7f]|\xc3[\x80-\xbf])*\xc3?", raw):  # in no simple piece
            return False
        return " " in text.lstrip(" ") or len({"break" if c == "\n" else "digit" if c in "0123456789" else "letter" if c.isascii() and c.isalpha() or ord(c) > 127 else "other" for c in text}) > 1

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        return [ids for k in range(0, len(words), TOGETHER) for ids in self._together([_segment(w) for w in words[k : k + TOGETHER]])]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with a space or a break, and hold no other."""
        joined = "".join(pieces)
        if self.direct and self._SIMPLE.fullmatch(joined):
            shown = self.shown[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
            found = self.merges.encode(shown, add_special_tokens=False).ids
        elif self.direct and len(pieces) > 1 and any(fits := [bool(self._SIMPLE.fullmatch(p)) for p in pieces]):
            parts = {fit: iter(self._together([p for p, x in zip(pieces, fits, strict=True) if x == fit])) for fit in (True, False)}
            return [next(parts[fit]) for fit in fits]
        else:
            found = self.library.encode(joined, add_special_tokens=False).ids
        ids = np.array(found, self.dtype)
        raw, at = ids.tobytes(), (np.flatnonzero(self.begins[ids]) * self.width).tolist()
        return [raw[a:b] for a, b in pairwise([*at, len(raw)])] if len(at) == len(pieces) else self._encode(pieces)

    def _odd(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The words, each with what follows and begins no piece; and the places of those that are not to be looked up."""
        pieces: list[list[str]] = []
        for w in words:
            if not pieces or _begins_piece(w):
                pieces.append([w])
            else:
                pieces[-1].append(_segment(w))
        return ["".join(p) for p in pieces], [k for k, p in enumerate(pieces) if len(p) > 1 or not _begins_piece(p[0])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, whole, cut, odd = [b""] * len(texts), [], [], []
        find = self.after.__getitem__
        for i, text in enumerate(texts):
            if not self.cuts or any(t in text for t in self.special):
                whole.append(i)
            elif text:
                words = ("\n" + text).replace("\n", " \n").split(" ")
                del words[0]
                try:
                    ids = list(map(find, words))
                except KeyError:  # somewhere white space or nothing follows a space or a break
                    words, places = self._odd(words)
                    apart = set(places)
                    ids = [b"" if k in apart else find(w) for k, w in enumerate(words)]
                    odd += [(ids, k, words[k]) for k in places]
                cut.append((i, ids))
        found = self._encode([_segment(w) if k else w[1:] for _, k, w in odd])
        for (ids, k, _), x in zip(odd, found, strict=True):
            ids[k] = x if k else bytes(self.width) + x  # in place of the break before the text
        self.after.settle(self._new)
        for i, ids in cut:
            ids[0] = ids[0][self.width :]
            out[i] = b"".join(ids)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def _shard_task(folder: str, tokenizer: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path = Encoder.of(tokenizer), None, ""
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            texts = as_text(batch["text"])
            _, offsets = byte_view(texts)
            for lo, hi in slices(offsets):
                if writer is None:
                    fs, root = filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.qtok"
                    writer = ShardWriter(fs.open_output_stream(f"{root}/{path}"), min_bits(max(encoder.vocabulary, end_id + 1)), block)
                ids = encoder(texts[lo:hi].to_pylist())
                size = np.dtype(encoder.dtype).itemsize
                counts = np.array([len(x) // size + 1 for x in ids], np.int64)
                flat = np.frombuffer(end.join([*ids, b""]), encoder.dtype)
                writer.add(batch["id"][lo:hi], counts, flat)
        if writer is not None:
            n_docs, n_ids = writer.close()
            release()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [f"{folder}/{path}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK_IDS) -> DataFrame:
    """Writes all texts in the order of their ids. The manifest: shard, path, n_docs, n_ids and base (ids before)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(math.ceil(total / shard_bytes), shuffle_partitions(spark))
    keyed = base.withColumns({"tie": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})  # equal rows spread by their turn
    ordered = keyed.repartitionByRange(shards, F.col("id").asc_nulls_first(), F.col("tie"), F.col("turn")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    manifest = written(ordered.select("id", "text").mapInArrow(_shard_task(folder, tokenizer, end_id, block), "shard long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _reader(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as stream:
                    shard = ShardReader(stream)
                    starts, counts = shard.documents["start"].to_numpy(), shard.documents["n"].to_numpy()
                    for lo, hi in slices(np.append(starts, shard.n_ids), span):
                        ids = shard.ids(int(starts[lo]), int(starts[hi - 1] + counts[hi - 1])).astype("<u4")
                        parts = np.split(ids, starts[lo + 1 : hi] - starts[lo])
                        yield pa.RecordBatch.from_arrays(
                            [shard.documents["doc_id"].slice(lo, hi - lo).combine_chunks(), pa.array(starts[lo:hi] + base), pa.array(counts[lo:hi]), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())],
                            ["id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def read_token_files(manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id", span: int = 1 << 20) -> DataFrame:
    """Per document, from the files: id, start (in the whole corpus), n_tokens and ids_crc32."""
    files = manifest.select("shard", "path", "base")
    n = max(1, manifest.count())
    return files.repartition(n, "shard").mapInArrow(_reader(span), f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, tokenizer or tokenizer_path()), docs.schema["doc_id"].dataType.simpleString())
