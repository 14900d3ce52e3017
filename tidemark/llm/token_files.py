"""Token ids as binary files of independent zstandard frames with a trailing seek table.

Each file holds documents in ascending id order as little-endian unsigned integers of 2 bytes where the vocabulary allows, else 4,
cut into frames that decompress alone. Behind them stands a skippable frame in the layout of the public zstd seekable format: an entry
for each frame (compressed size, decompressed size, checksum: the low 32 bits of the content's xxh64) and a footer with the number of
frames, so that a reader finds and decompresses only the frames of the documents it wants. A table beside the files says which file,
frame and place in it each document has.
"""

from __future__ import annotations

import os
import re
import struct
from codecs import charmap_decode
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, partitions, schema_and, small_batches, text_bytes

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def open_folder(uri: str):
    """A file system that Spark's workers can open, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FrameWriter:
    """Writes one file: add() documents, then close()."""

    def __init__(self, out, width: int, frame_bytes: int, level: int):
        import zstandard

        self.out, self.kind, self.frame_bytes = out, {2: "<u2", 4: "<u4"}[width], frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.size, self.entries = 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and place in it, in ids, at which the document starts; a document lies in one frame. data: its packed ids."""
        if self.size >= self.frame_bytes:
            self.flush()
        at = len(self.entries), self.size // np.dtype(self.kind).itemsize
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        import xxhash

        data = b"".join(self.held)
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads frames of a file opened for random access."""

    def __init__(self, source, width: int):
        self.source, self.kind = source, {2: "<u2", 4: "<u4"}[width]
        size = source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.entries = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries])]).astype(np.int64)

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        packed, plain, check = self.entries[k]
        self.source.seek(int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(data, dtype=self.kind)


#: White space but for blanks and line breaks.
ODD_SPACE = [chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n"]
#: Letters that a byte-level tokenizer never cuts apart; a word of these alone is one piece.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"

#: Characters of a word that is kept; where nothing parts words, whole sentences are one.
LONGEST = 32


class Encoder:
    """Packed ids of whole texts, with what the tokenizer gave for a word kept for the next time.

    A byte-level BPE never joins a piece of text with what follows behind a space, nor with a single line break between two words, so
    that a text whose words have one space or line break between them is the sum of its words, each with what stands before it. Texts
    with any other white space, and those that hold an added token such as ``<|endoftext|>``, are encoded as they are. Arrow cuts the
    texts of a call into words and tells these apart, so that Python sees each distinct one once. ``most`` bounds the words kept, of
    which none has more than ``LONGEST`` characters.
    """

    def __init__(self, tokenizer: str, end_id: int, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.bpe = Tokenizer.from_file(tokenizer)
        size = max(self.bpe.get_vocab_size(), end_id + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind, self.most = {2: "<u2", 4: "<u4"}[self.width], most
        self.spaced = np.array([(self.bpe.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.marks = {m: self.whole("a" + m)[len(self.whole("a")) :] for m in ".,;:!?"}
        added = [t.content for t in self.bpe.get_added_tokens_decoder().values()]
        cut = self.bpe.pre_tokenizer
        by_bytes = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        # Words put side by side must not make an added token.
        self.by_words = by_bytes and not self.bpe.normalizer and not any(len(t.split()) != 1 or t != t.strip() for t in added)
        space = "".join(f"\\x{{{ord(c):x}}}" for c in ODD_SPACE)
        self.unlike_words = "|".join([r"\A[ \n]", r"[ \n]\z", r"[ \n][ \n]", f"[{space}]", *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)])
        # The same model behind a cut at blanks, for words of letters that are spelled in the bytes' characters already.
        self.letters = Tokenizer(self.bpe.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.of_letters = re.compile(f"[{LETTERS}]+").fullmatch
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        pairs = {b: c for x in [*map(chr, range(0x80)), *map(chr, range(0xC0, 0x180))] for b, c in zip(x.encode(), spell(x)[0][0])}
        self.spelled = "".join(" " if b == 10 else pairs.get(b, "\ufffe") for b in range(256))  # \ufffe: not in these letters

    def whole(self, text: str) -> bytes:
        return self.wholes([text])[0]

    def wholes(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        rows = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        out = [b""] * len(rows)
        filled = pc.binary_length(rows).to_numpy(zero_copy_only=False) > 0
        odd = pc.match_substring_regex(rows, self.unlike_words).to_numpy(zero_copy_only=False) if self.by_words else filled
        at = np.flatnonzero(filled & odd)
        for i, data in zip(at.tolist(), self.wholes(rows.take(pa.array(at)).to_pylist())):
            out[i] = data
        at = np.flatnonzero(filled & ~odd)
        if len(at):
            for i, data in zip(at.tolist(), self.from_words(rows.take(pa.array(at)))):
                out[i] = data
        return out

    def from_words(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of texts that their words tell; a word has the line break before it, if there is one."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        data = list(map(self.known.get, words))
        if None in data:
            found = self.learn([w for w, ids in zip(words, data) if ids is None])
            data = [ids or found[w] for w, ids in zip(words, data)]
        # A text's first word has nothing before it.
        starts, picks = lists.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        heads = self.wholes([words[i] for i in picks[starts[:-1]]])
        picks[starts[:-1]] = len(words) + np.arange(len(heads))
        ids = pa.array(data + heads, pa.large_binary()).take(pa.array(picks))
        _, ends, packed = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[starts].tolist()
        packed = memoryview(packed)
        return [packed[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of the words; they are kept while there is room, which frequent words take first.

        A mark behind a letter is a piece of its own for the tokenizer, so a word that ends so is put together from the two.
        """
        marked = {w: w[:-1] for w in new if w[-1] in self.marks and w[-2:-1].isalpha()}
        plain = set(new).difference(marked)
        plain.update(filterfalse(self.known.__contains__, marked.values()))
        letters = list(filter(self.of_letters, plain))
        plain.difference_update(letters)
        broken = [w for w in plain if w[0] == "\n"]
        found = self.encoded(letters, "\n ") | self.encoded(list(plain.difference(broken)), " ") | self.encoded(broken, "")
        found |= {w: (found.get(core) or self.known[core]) + self.marks[w[-1]] for w, core in marked.items()}
        if (room := self.most - len(self.known)) > 0:
            self.known.update(islice(((w, ids) for w, ids in found.items() if len(w) <= LONGEST), room))
        return found

    def encoded(self, words: list[str], before: str) -> dict[str, bytes]:
        """Packed ids of words, of which each starts with an id that has a space before it, or, with nothing put before them, a line break's.

        With both put before them they are words of letters, which then are spelled by their bytes and cut at the line breaks.
        """
        found = {}
        lines = [words[i : i + 128] for i in range(0, len(words), 128)]
        texts = [before + before.join(x) for x in lines]
        if by_letters := before == "\n ":
            texts = [charmap_decode(t.encode(), "strict", self.spelled)[0] for t in texts]
        w = self.width
        if not before:
            line_break = self.bpe.encode("a\nb", add_special_tokens=False).ids[1]
        for line, e in zip(lines, (self.letters if by_letters else self.bpe).encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(e.ids)
            starts = np.flatnonzero(self.spaced[ids] if before else ids == line_break)
            if len(starts) != len(line):
                raise ValueError("the tokenizer joins words")
            packed, at = ids.astype(self.kind).tobytes(), (starts * w).tolist()
            found.update(zip(line, [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)])]))
        return found


@cache
def encoder(tokenizer: str, end_id: int) -> Encoder:
    """A Python worker's own, with the words that it keeps from task to task.

    Tasks find it through this module: variables that a function sent to them names are copied into it, anew for each task.
    """
    return Encoder(tokenizer, end_id)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, row: int = 64) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of the column's texts, a row counting as some bytes itself."""
    held, size = [], 0
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + row)])
        at = 0
        while at < b.num_rows:
            to = min(int(np.searchsorted(ends, ends[at] + most - size)), b.num_rows)
            held.append(b.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None, file_bytes: int = 1 << 28, frame_bytes: int = 1 << 20, level: int = 1) -> DataFrame:
    """Encodes whole texts and writes them under folder; returns the table of places, itself written there.

    The table has id, start (ids of all documents before), n_tokens (end id included), file, frame, place. Null texts count as empty:
    end_id alone. Documents with the same id stand in the order of a hash of their texts, so that one id's rows can be dealt to
    several files; null ids come first. An empty table gives an empty result. There are as many files as ``files`` says, else one for
    each ``file_bytes`` of text, and at least one for each shuffle partition. A very long text is held whole in its task, in one frame
    of its own size, which must stay below 4 GB. A task writes under a name of its own attempt and renames it at its end, so that attempts of lost executors or
    speculative ones do no harm; only files that the table names count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = files or max(partitions(spark), -(-text_bytes(docs, text_col) // file_bytes))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    kind = rows.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        width, end = encode.width, np.array([end_id], dtype=encode.kind).tobytes()
        task = TaskContext.get()
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        part = task.partitionId()
        names = ["id", "part", "local", "n_tokens", "file", "width", "frame", "place"]
        name = f"tokens-{part:05d}.w{width}.{task.taskAttemptId()}.zst"
        out, writer, local = None, None, 0
        for b in by_bytes(batches, "text"):
            if writer is None:
                out = store.open_output_stream(f"{path}/_{name}", compression=None)
                writer = FrameWriter(out, width, frame_bytes, level)
            places, sizes = [], []
            for data in encode(b.column("text")):
                data += end
                places.append(writer.add(data))
                sizes.append(len(data) // width)
            starts = local + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            local += sum(sizes)
            frames, places = zip(*places)
            n = b.num_rows
            columns = [pa.repeat(pa.scalar(part, pa.int32()), n), starts, np.array(sizes), pa.repeat(name, n), pa.repeat(pa.scalar(width, pa.int32()), n), np.array(frames, np.int32), np.array(places)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names)
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{path}/_{name}", f"{path}/{name}")

    written = rows.mapInArrow(write, f"id {kind}, part int, local long, n_tokens long, file string, width int, frame int, place long")
    written.write.parquet(f"{folder}/places")
    places = spark.read.schema(written.schema).parquet(f"{folder}/places")
    # One row for each file: the sums run over files, not documents.
    sums = {r["part"]: r["n"] for r in places.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, base = 0, []
    for part in sorted(sums):
        base.append((part, before))
        before += sums[part]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return places.join(bases, "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "file", "width", "frame", "place")


def read_token_files(places: DataFrame, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """places with ids_crc32, from the ids that the files hold for each of its documents.

    places may be any part of write_token_files' result; only the frames that it names are decompressed.
    """
    rows = places.repartition(partitions(places.sparkSession), "file", "frame").sortWithinPartitions("file", "frame", "place")
    schema = schema_and(rows, ids_crc32="long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        store, path = open_folder(folder)
        name, reader, at, ids = None, None, None, None
        for b in batches:
            sums = []
            for file, width, frame, place, n in zip(*(b.column(c).to_pylist() for c in ("file", "width", "frame", "place", "n_tokens"))):
                if file != name:
                    name, reader, at = file, FrameReader(store.open_input_file(f"{path}/{file}"), width), None
                if frame != at:
                    at, ids = frame, reader.frame(frame)
                sums.append(zlib.crc32(ids[place : place + n].astype("<u4").tobytes()))
            yield b.append_column("ids_crc32", pa.array(sums, pa.int64()))

    return rows.mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs' token files under a new folder of the shared one and reads each document back."""
    folder = new_folder(docs.sparkSession, "tokens")
    id_col = options.get("id_col", "doc_id")
    return read_token_files(write_token_files(docs, tokenizer, folder, **options), folder, id_col=id_col)


def clean_up(spark: SparkSession, folder: str) -> None:
    """Removes a folder of token files that no result needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
