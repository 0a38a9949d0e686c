"""Token ids in Arrow files of equal-length sequences (operator 9).

Documents are range-partitioned and sorted by doc_id. Each partition writes one Arrow IPC file: record batches with a
fixed-size-list column of ids and one of masks (false for the padding of the last sequence), so that sequence i of a
memory-mapped file is read without a copy, and beside it a file with the documents' ids and lengths. Ids take 16 bits
where the vocabulary allows it. A task writes under a name of its own attempt and renames at the end, so a repeated or
lost attempt leaves one whole file.

The ids are those of the tokenizers library. Texts are cut before lone spaces (see bpe.chunks) and between a letter and
the stops that end such a part; parts met before come from a bounded table, new ones are encoded together. A tokenizer
whose pre-tokenizer joins characters across these places is recognised by a probe and gets whole texts instead. An added
token that a text spells out gets its own id, as the library does by default.

Defined results: doc_id is a number, text or date; null and empty texts have only the end id; documents of equal doc_id
follow one another in the order of a digest of their text, and rows equal in that too are alike; a null doc_id comes
first; a very long text fills as many sequences as it needs; columns beside doc_id and text play no part, whatever their
names; an empty table writes no file and gives no row.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import PROBE, chunks, spaces_stand_alone
from .common import fresh_path

SEQUENCE, BATCH = 2048, 64
#: Stops that end a part and never join with a letter before them.
STOPS = ".,;:!?"
#: Entries of a worker's table of parts; a full table starts anew, which changes no result.
PARTS = 800_000
#: Documents that are encoded at once.
GROUP = 64

_kept = sys.modules.setdefault("_tallymark_kept", types.ModuleType("_tallymark_kept"))


class Encoder:
    """Ids of texts by a tokenizers file, as bytes of the given integer type."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # parts come once; filling the library's own table costs more than it saves
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes; the vocabulary writes each as one sign
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)
        self.stops: dict[str, bytes] = {}
        self.cuts = self.tokenizer.normalizer is None and not any(c.isspace() or c in STOPS for t in self.added for c in t)
        probe = [PROBE, "".join(f" a{x} b{x}{y} é{y}" for x in STOPS for y in STOPS)]
        try:
            self.cuts = self.cuts and self.encode(probe) == self.whole(probe)
        except ValueError:
            self.cuts = False

    def spaced(self, wanted: list[str]) -> list[bytes]:
        """Ids of parts, each with a space before it. They are encoded as one text, as the pre-tokenizer joins nothing
        across a lone space; token lengths tell where each part ends. Such as end in white space or spell out an added
        token go by themselves."""
        joined = " " + " ".join(wanted)
        alone = {p for p in wanted if p[-1:].isspace()}
        for token in self.added:
            if token in joined:
                alone.update(p for p in wanted if token in p)
        parts = [p for p in wanted if p not in alone] if alone else wanted
        joined = " " + " ".join(parts) if alone else joined
        out: dict[str, bytes] = {}
        if parts:
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)) + 1)
            upto = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(upto, ends) + 1
            if not np.array_equal(upto[cuts - 1], ends):
                raise ValueError("a token crosses a lone space")
            data, at = ids.astype(self.kind).tobytes(), (cuts * self.kind.itemsize).tolist()
            out = dict(zip(parts, map(data.__getitem__, map(slice, [0, *at[:-1]], at))))
        out |= dict(zip(alone, self.whole([" " + p for p in alone])))
        return [out[p] for p in wanted]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, new: list[str]) -> list[str]:
        """Puts new parts, each with a space before it, into the table; gives those that are too long to stay there."""
        ending = {p: stem for p, stem in zip(new, (p.rstrip(STOPS) for p in new)) if len(stem) < len(p) and stem[-1:].isalpha()}
        need = list({p for p in new if p not in ending}.union(ending.values()).difference(self.known))
        self.known.update(zip(need, self.spaced(need)))
        if len(self.stops) >= PARTS:
            self.stops.clear()
        stops = list({p[len(stem) :] for p, stem in ending.items()}.difference(self.stops))
        self.stops.update(zip(stops, self.whole(stops)))
        self.known.update((p, self.known[stem] + self.stops[p[len(stem) :]]) for p, stem in ending.items())
        return [p for p in {*need, *ending} if len(p) > 64]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.whole(texts)
        heads, tails = [], []
        for t in texts:
            head, *tail = t.split(" ") if spaces_stand_alone(t) else [c[k > 0 :] for k, c in enumerate(chunks(t))]
            heads.append(head)
            tails.append(tail)
        if len(self.known) >= PARTS:
            self.known.clear()
        long = self.learn(list(set().union(*tails).difference(self.known)))
        out = [head + b"".join(map(self.known.__getitem__, tail)) for head, tail in zip(self.whole(heads), tails)]
        for p in long:
            del self.known[p]
        return out


def encoder(path: str) -> Encoder:
    table = _kept.__dict__.setdefault("encoders", {})
    if path not in table:
        table[path] = Encoder(path)
    return table[path]


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Packs a stream of ids into sequences of equal length and writes them batch by batch."""

    def __init__(self, out: pa.NativeFile, kind: np.dtype, length: int):
        self.length, self.kind = length, kind
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.parts, self.size = pa.ipc.new_file(out, self.schema), [], 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.size += len(ids) // self.kind.itemsize
        if self.size >= self.length * BATCH:
            self.flush(self.size - self.size % self.length)

    def flush(self, count: int, padding: int = 0) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.kind)
        full = np.concatenate([ids[:count], np.zeros(padding, self.kind)])
        mask = np.arange(len(full)) < count
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.parts, self.size = [ids[count:].tobytes()], len(ids) - count

    def close(self) -> None:
        if self.size:
            self.flush(self.size, -self.size % self.length)
        self.writer.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = SEQUENCE) -> list[tuple[str, str, int, int]]:
    """Writes the files below folder; gives (file of sequences, file of documents, documents, ids) in order. There is
    one entry a partition, so the list stays small."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = encoder(tokenizer)
        end = np.array([end_id], own.kind).tobytes()
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():05d}"
        attempt = f".attempt-{task.taskAttemptId()}"
        sequences = index = None
        docs_n = ids_n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                if sequences is None:
                    outs = [fs.open_output_stream(f"{name}.{k}.arrow{attempt}") for k in ("ids", "docs")]
                    sequences = SequenceWriter(outs[0], own.kind, length)
                    index = pa.ipc.new_file(outs[1], pa.schema([("doc_id", kind), ("n_tokens", pa.int64())]))
                counts = []
                for ids in own.encode([t or "" for t in part.column("text").to_pylist()]):
                    sequences.add(ids + end)
                    counts.append(len(ids) // own.kind.itemsize + 1)
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]))
                docs_n, ids_n = docs_n + len(counts), ids_n + sum(counts)
        if sequences is not None:
            sequences.close()
            index.close()
            for out, k in zip(outs, ("ids", "docs")):
                out.close()
                fs.move(f"{name}.{k}.arrow{attempt}", f"{name}.{k}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], names=["part", "docs", "ids"])

    order = [F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = rows.mapInArrow(run, "part int, docs long, ids long").collect()
    return [(f"{folder}/part-{r.part:05d}.ids.arrow", f"{folder}/part-{r.part:05d}.docs.arrow", r.docs, r.ids) for r in sorted(manifest)]


def read_documents(files: tuple[str, str], start: int) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32 of the documents in a pair of files, batch by batch; start: ids before them."""
    readers = []
    for uri in files:
        fs, path = opened(uri)
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        readers.append(pa.ipc.open_file(source))
    sequences, index = readers

    def streams() -> Iterator[np.ndarray]:
        for k in range(sequences.num_record_batches):
            batch = sequences.get_batch(k)
            ids = batch.column("ids").flatten().to_numpy()
            if k + 1 == sequences.num_record_batches:
                ids = ids[batch.column("mask").flatten().to_numpy(zero_copy_only=False)]
            yield ids

    stream, left = streams(), np.zeros(0, np.uint16)
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        starts, sums = [], []
        for n in batch.column("n_tokens").to_pylist():
            crc, need = 0, n
            while need:
                if not len(left):
                    left = next(stream)
                crc = zlib.crc32(left[:need].astype("<u4").tobytes(), crc)
                need, left = need - min(need, len(left)), left[need:]
            starts.append(start)
            sums.append(crc)
            start += n
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Writes docs to token files in the shared folder and reads them: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    manifest = write_token_files(docs, tokenizer, end_id, fresh_path(spark, "tokens"), length)
    entries, before = [], 0
    for ids_file, docs_file, _, n in manifest:
        entries.append((ids_file, docs_file, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_documents((row["ids_file"], row["docs_file"]), row["start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    files = spark.createDataFrame(entries, "ids_file string, docs_file string, start long").repartition(max(1, len(entries)))
    return files.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
