"""Flat token files: unsigned ids back to back, 64-bit document offsets, memory-mapped reading.

Documents are dealt by ranges of their id, sorted in each partition, encoded there and written as
one shard: ``.ids`` (unsigned 16- or 32-bit ids), ``.off`` (64-bit offsets, one more than documents)
and ``.doc`` (64-bit document ids). A task attempt writes under a name of its own and only the
manifest rows of the attempts that Spark commits are read, so a lost executor leaves at most files
that nobody names. The first id of each shard in the whole sequence is the prefix sum of the
shards' lengths: one number for each partition, whatever the corpus holds.

Defined cases: a null or empty text holds the end id alone; a null document id sorts first (stored as
the least 64-bit integer); rows with equal ids follow the hash of their text; an empty table gives no
shard; other columns are left out.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import lean, opened, saved, slices
from tagloom.session import scratch_path

CACHED_PIECES = 200_000
SLICE = 16 << 20
CACHED_CHARS = 48
# printable ASCII and the letters of Latin-1: composed already, and lowered alike everywhere
PLAIN = "[!-~À-ÖØ-öø-ÿ]"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
NO_DOCUMENT = -(1 << 63)
MANIFEST = "shard int, name string, documents long, tokens long, width int"


class WordEncoder:
    """A tokenizer of the tokenizers library whose model never looks across a blank.

    Texts are cut at blanks and line ends, which that kind of tokenizer drops, and each distinct
    word of a slice is encoded once. Plain words are lowered and cut into the tokenizer's pieces
    first, because far fewer pieces than words are distinct; each distinct piece goes through the
    library's model, without its normaliser, while it stays in one of two bounded generations of a
    cache. All other words, and those that may hold a special token, go through the whole tokenizer.
    A tokenizer whose normaliser or pieces are not of this kind uses the whole one throughout.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for one in (self.tokenizer, self.model):
            one.no_truncation()
            one.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pieces = self._cuts_alike()
        self.forget()

    def _cuts_alike(self) -> bool:
        """Whether the tokenizer cuts a text of all plain characters into the same pieces."""
        text = "".join(map(chr, [*range(33, 127), *range(192, 256)])).replace("×", "").replace("÷", "")
        text = f"{text}don't'S''sA'REb've'Mc'll'd12é3É--a..1"
        if self.tokenizer.normalizer is None or self.tokenizer.pre_tokenizer is None:
            return False
        if self.tokenizer.normalizer.normalize_str(text) != text.lower():
            return False
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text.lower())
        return [text.lower()[a:b] for _, (a, b) in cut] == PIECES.findall(text.lower())

    def forget(self) -> None:
        """Drop the encoded pieces kept so far."""
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of distinct pieces, from the two generations of the cache where they are."""
        if len(self.pieces) > CACHED_PIECES:
            self.older, self.pieces = self.pieces, {}
        found = [self.pieces.get(p) or self.older.get(p) for p in pieces]
        places = [i for i, ids in enumerate(found) if ids is None]
        unseen = [pieces[i] for i in places]
        for i, ids in zip(places, self._ids(self.model, unseen)):
            found[i] = ids
        self.pieces.update((p, ids) for p, ids in zip(pieces, found) if len(p) <= CACHED_CHARS)
        return found

    def _unpacked(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Packed ids back to back, and their numbers."""
        sizes = np.array(list(map(len, packed)), np.int64) // self.width
        return np.frombuffer(b"".join(packed), f"<u{self.width}"), sizes

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words without blanks, and where each word's ids begin and how many they are."""
        plain = np.zeros(len(words), bool)
        if self.by_pieces:
            fits = pc.match_substring_regex(words, f"^{PLAIN}+$")
            for token in self.special:
                fits = pc.and_(fits, pc.invert(pc.match_substring(words, token)))
            plain = fits.to_numpy(zero_copy_only=False)
        # one pass over all plain words, a line each; a line end is a piece that stands for no ids
        text = "\n".join(words.filter(pa.array(plain)).to_pylist()).lower()
        pieces = pa.array(PIECES.findall(text), pa.string()).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        at = known.index("\n") if "\n" in known else len(known)
        packed = self._piece_ids([p for p in known if p != "\n"])
        ids, sizes = self._unpacked([*packed[:at], b"", *packed[at:]])
        order = pieces.indices.to_numpy()
        own = np.bincount(np.cumsum(order == at), weights=sizes[order], minlength=plain.sum()).astype(np.int64)
        whole = words.filter(pa.array(~plain)).to_pylist()
        others, counts = self._unpacked(self._ids(self.tokenizer, whole))
        first = gathered(ids, np.cumsum(sizes) - sizes, sizes, order)
        lengths, begins = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lengths[plain], lengths[~plain] = own[: plain.sum()], counts
        begins[plain] = np.cumsum(lengths[plain]) - lengths[plain]
        begins[~plain] = len(first) + np.cumsum(counts) - counts
        return np.concatenate([first, others]), begins, lengths

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts back to back, each with the end id behind it, and their numbers."""
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        ids, begins, sizes = self._encoded(words.dictionary)
        # the words of each text by number, and behind them that of the end id
        begins, sizes = np.append(begins, len(ids)), np.append(sizes, 1)
        stops = cut.offsets.to_numpy()[1:] - cut.offsets.to_numpy()[0]
        order = np.insert(words.indices.to_numpy(), stops, len(sizes) - 1)
        ends = np.cumsum(sizes[order])
        lengths = np.diff(ends[stops + np.arange(len(stops))], prepend=0)
        return gathered(np.append(ids, np.array([end], ids.dtype)), begins, sizes, order), lengths

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The packed ids of each text with the end id behind them."""
        ids, lengths = self.encode_column(pa.array(texts, pa.string()), end)
        return [part.tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


def gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``begins``, back to back in the given order."""
    counts = sizes[order]
    shift = begins[order] - (np.cumsum(counts) - counts)
    return values[np.repeat(shift, counts) + np.arange(counts.sum())]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(df: DataFrame, vocabulary: str, folder: str, end: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards of ``df`` below ``folder`` in ascending document order; returns their manifest."""

    @lean
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (files, root) = _encoder(vocabulary), opened(folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        docs, lengths, out = [], [], None
        for batch in slices(batches, most=SLICE):
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}.ids")
            gc.disable()  # a slice makes many small lists and no cycles
            ids, sizes = encoder.encode_column(batch.column(1), end)
            gc.enable()
            out.write(ids.tobytes())
            lengths += sizes.tolist()
            docs += batch.column(0).fill_null(NO_DOCUMENT).to_pylist()
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        for kind, values in (("off", offsets), ("doc", np.array(docs, "<i8"))):
            with files.open_output_stream(f"{root}/{name}.{kind}") as file:
                file.write(values.tobytes())
        encoder.forget()
        row = [[number], [name], [len(docs)], [int(offsets[-1])], [encoder.width]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "name", "documents", "tokens", "width"]
        )

    given = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    ordered = given.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc", "tie")
    written = ordered.sortWithinPartitions("doc", "tie").select("doc", "text").mapInArrow(shard, MANIFEST)
    return saved(written, "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids of all shards before each: a prefix sum of one row a shard."""
    rows = sorted(manifest.collect(), key=lambda r: r.shard)
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in rows])]).tolist()
    spark = manifest.sparkSession
    listed = [(r.shard, r.name, r.documents, r.tokens, r.width, b) for r, b in zip(rows, bases)]
    return spark.createDataFrame(listed, MANIFEST + ", base long").repartition(max(1, len(listed)))


def _mapped(files, path: str, kind: str) -> np.ndarray:
    """A file's integers: mapped where the file system is local, else read."""
    if files.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of the shards, from the files: doc_id, start, n_tokens and ids (32-bit, packed).

    ``manifest`` needs the column ``base``; each shard is one row.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{root}/{row['name']}"
                ids = _mapped(files, f"{at}.ids", f"<u{row['width']}")
                offsets, docs = _mapped(files, f"{at}.off", "<u8"), _mapped(files, f"{at}.doc", "<i8")
                for begin in range(0, len(docs), 1000):
                    own = docs[begin : begin + 1000]
                    ends = offsets[begin : begin + len(own) + 1].astype(np.int64)
                    packed = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == NO_DOCUMENT),
                            pa.array(row["base"] + ends[:-1]),
                            pa.array(np.diff(ends)),
                            pa.array(packed, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    kind = "doc_id long, start long, n_tokens long, ids binary"
    return manifest.mapInArrow(documents, kind)


def round_trip(spark: SparkSession, df: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """Write ``df`` to files in the shared folder and return the documents read back from them."""
    folder = scratch_path(spark, "token-files")
    return read(with_bases(write(df, vocabulary, folder, end)), folder)
