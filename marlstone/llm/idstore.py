"""Token-ID output in a content-addressed store.

``tokenize`` encodes texts; ``write_store`` cuts each document's ids into chunks where a rolling hash of the last ids
matches, stores every distinct chunk once under its SHA-256, and keeps a recipe (the digests in order) per document;
``write_texts`` does both in one pass; ``read_store`` rebuilds the ids. A store is a folder of Parquet tables:

* ``chunks``: digest, packed (a byte ``width``, then the ids as little-endian integers of that many bytes, zstd), n (how
  often recipes name it), bucketed by digest, so that reading it back moves no chunk before it meets its recipes;
* ``buckets``: their number, as ``chunks`` is in no catalogue for longer than it takes to plan a query;
* ``recipes``: doc_id, begin (ids before it in its part), n_ids, digests, leaf, part, block; in ascending doc_id order
  over files;
* ``manifest``: a Merkle tree of fan-out ``FAN``: level 0 a digest per block of documents, level 1 per part, level 2
  the whole store, each over the digests below it in order, with the number of documents and ids; a leaf covers doc_id,
  n_ids and the chunk digests. Where a part starts follows from level 1.

Defined results: null text counts as the empty text; an empty document has only the end id; documents with the same
doc_id keep a recipe each (ties in any order, starts consistent with that order); an empty table gives an empty store
with a level 2 digest of the empty string; other columns don't enter the store.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.batches import mixed, sliced, string_bytes, text_column
from marlstone.llm.shared import joined_by_key, new_path, remove, small_batches

#: Distinct text units a task remembers; the older half is forgotten beyond that.
REMEMBERED = 400_000
#: A chunk ends where the hash of the last WINDOW ids has MEAN_BITS zero bits; LEAST and MOST bound its ids.
WINDOW, MEAN_BITS, LEAST, MOST = 4, 11, 512, 16384
FAN = 1024

#: A unit: white space with a Latin word that ASCII punctuation, white space or the end follows, or with what is left
#: up to the next white space. The byte-level pattern ends a token at each of these places, whatever stands around.
_UNITS = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ \n!-/:-@\[-`{-~]|\Z)|[ \n]*[^ \n]+|[ \n]+")
_LATIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: The byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
#: Texts are cut first, all bytes at once, where another byte meets white space and where an ASCII letter or digit meets
#: ASCII punctuation: no token crosses these places either.
_KINDS = np.array([1 if c in b" \n" else 2 if chr(c).isalnum() and c < 128 else 3 if 0x21 <= c < 0x7F else 0 for c in range(256)], dtype=np.uint8)
_CUT = np.array([b == 1 and a != 1 or a == 2 and b == 3 for a in range(4) for b in range(4)])
#: White space other than the space and the line feed, as either library may see it.
_ODD_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\u0085  ᠎ -‍    ⁠　﻿]"


class _Units(dict):
    """Ids of text units as bytes, encoded when first asked for; ``older`` holds the half that is forgotten next."""

    def __init__(self, encoder: _Encoder, older: dict[str, bytes]):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.encoder.direct(unit)
        self[unit] = found
        return found


class _Encoder:
    """Ids of texts by the tokenizers library; a text is cut at places that the byte-level pattern never crosses, and
    each distinct unit is encoded once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.merge, self.code = self.tokenizer.model.tokenize, "<%dH" if self.width == 2 else "<%dI"
        setup = json.loads(self.tokenizer.to_str())
        before = setup["pre_tokenizer"] or {}
        self.added = added = [t["content"] for t in setup["added_tokens"]]
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not setup["normalizer"] and not any(_LATIN.fullmatch(s) or any(c in " \n" for c in s) for s in added)
        self.units = _Units(self, {})

    def direct(self, text: str) -> bytes:
        # A Latin word with at most a space before it is one token of the byte-level pattern: its merges alone are asked for.
        plain = text.isascii()
        if self.byte_level and (plain and text.removeprefix(" ").isalpha() or _LATIN.fullmatch(text)):
            shown = text.replace(" ", "Ġ") if plain else text.encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self.merge(shown)]
        elif self.byte_level and text[0] == "\n" and _LATIN.fullmatch(text, 1) and text[1] != " ":
            return self.units["\n"] + self.units[text[1:]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(self.code % len(ids), *ids)

    def piece(self, piece: str) -> bytes:
        """Ids of what stands between two cuts: one unit as a rule, or several."""
        found = self.units.get(piece)
        if found is None:
            units = [piece] if piece.isascii() and piece.removeprefix(" ").isalpha() else _UNITS.findall(piece)
            found = self.units[piece] if len(units) == 1 else b"".join(map(self.units.__getitem__, units))
        return found

    def encode(self, column: pa.Array) -> list[bytes]:
        if len(self.units) > REMEMBERED // 2:
            self.units.older = {}
            self.units = _Units(self, self.units)
        # Whole texts go to the library where white space is odd or an added token stands, which a cut might split.
        odd = np.ones(len(column), bool) if not self.byte_level else np.array(pc.match_substring_regex(column, _ODD_SPACE))
        for token in self.added:
            odd |= np.asarray(pc.match_substring(column, token))
        raw, rows = string_bytes(pc.if_else(pa.array(odd), "", column) if odd.any() else column)
        kinds = _KINDS[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = _CUT[kinds[:-1] * 4 + kinds[1:]]
        cut[rows] = True
        places = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array([self.piece(x) for x in pieces.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(pieces.indices)
        ends, data = (np.frombuffer(x or b"", dtype=kind) for x, kind in zip(ids.buffers()[1:], (np.int64, np.uint8), strict=True))
        at = ends[np.searchsorted(places, rows)].tolist() if len(ids) else [0] * len(rows)
        out = [data[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.direct(text) if (text := column[i].as_py()) else b""
        return out


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Workers outlive their tasks: what is remembered goes where a worker meets a stage that encodes nothing."""
    for encoder in _ENCODERS.values():
        encoder.units = _Units(encoder, {})


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(tokenizer_path)
    end = b"" if end_id is None else np.array([end_id], dtype=encoder.kind).tobytes()
    for batch in sliced(batches, "text"):
        ids = [x + end for x in encoder.encode(text_column(batch, "text"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "width", "ids"])


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def tokenize(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0) -> DataFrame:
    """doc_id, width int, ids binary: the ids of each text, ``end_id`` appended, as little-endian integers of ``width`` bytes."""
    return _texts(df, doc_id, text).mapInArrow(lambda batches: _encoded(batches, tokenizer_path, end_id), "doc_id long, width int, ids binary")


_SALTED = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    salted = _SALTED[ids] if ids.itemsize == 2 else mixed(ids.astype(np.uint64) + np.uint64(1))
    rolled = salted[: n - WINDOW + 1].copy()
    for j in range(1, WINDOW):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + salted[j : n - WINDOW + 1 + j]
    out, last = [], 0
    for end in (np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW).tolist() + [n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n and end > last:
            out.append(end)
            last = end
    return out


def pack(raw: bytes, width: int, press) -> bytes:
    return bytes([width]) + press.compress(raw)


def unpack(packed: bytes, expand) -> tuple[np.ndarray, bytes]:
    """The ids of a packed chunk as little-endian unsigned 32-bit integers, and its digest."""
    raw = expand.decompress(packed[1:])
    return np.frombuffer(raw, dtype=f"<u{packed[0]}").astype("<u4"), hashlib.sha256(packed[:1] + raw).digest()


_CHUNKED = "doc_id long, n_ids long, digests array<binary>, packed array<binary>, leaf binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches, "ids"):
        counts, digests, packed, leaves = [], [], [], []
        for doc, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = raw or b""
            ends = cuts(np.frombuffer(raw, dtype=f"<u{width}"))
            parts = [raw[a * width : b * width] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            counts.append(len(raw) // width)
            digests.append([hashlib.sha256(bytes([width]) + p).digest() for p in parts])
            packed.append([pack(p, width, press) for p in parts])
            leaves.append(hashlib.sha256(f"{doc},{counts[-1]},".encode() + b"".join(digests[-1])).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(packed, pa.list_(pa.binary())), pa.array(leaves, pa.binary())],
            names=["doc_id", "n_ids", "digests", "packed", "leaf"],
        )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks as a bucketed table, which a plan keeps when its name is dropped again."""
    buckets, name, where = spark.read.parquet(f"{path}/buckets").first()[0], _table(path), path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, packed BINARY, n BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}/chunks'")
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return chunks


def _table(path: str) -> str:
    return "idstore_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_store(ids: DataFrame, path: str) -> None:
    """Write the store of ``tokenize``'s rows to ``path``, a folder that all executors share."""
    _write(ids.select("doc_id", "width", "ids").mapInArrow(_chunked, _CHUNKED), path)


def write_texts(df: DataFrame, tokenizer_path: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0) -> None:
    """``write_store`` of what ``tokenize`` gives; a task encodes and cuts in one Python worker instead of two."""
    _write(_texts(df, doc_id, text).mapInArrow(lambda batches: _chunked(_encoded(batches, tokenizer_path, end_id)), _CHUNKED), path)


def _write(chunked: DataFrame, path: str) -> None:
    spark = chunked.sparkSession
    staged = f"{path}/staged"
    chunked.write.option("compression", "uncompressed").parquet(staged)  # chunks are pressed already
    rows = spark.read.parquet(staged)
    pairs = rows.select(F.explode(F.arrays_zip("digests", "packed")).alias("c")).select("c.digests", "c.packed").toDF("digest", "packed")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = pairs.groupBy("digest").agg(F.first("packed").alias("packed"), F.count("*").alias("n"))
    chunks.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{path}/chunks").option("compression", "uncompressed").saveAsTable(_table(path))
    spark.sql(f"DROP TABLE {_table(path)}")  # the files stay
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/buckets")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _forget()
        part, upto, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            counts = np.asarray(batch.column(1), dtype=np.int64)
            begin = upto + np.cumsum(counts) - counts
            block = (row + np.arange(len(counts))) // FAN
            upto, row = upto + int(counts.sum()), row + len(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin), pa.array(np.full(len(counts), part)), pa.array(block)], names=["doc_id", "n_ids", "digests", "leaf", "begin", "part", "block"])

    ordered = rows.drop("packed").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    numbered = ordered.mapInArrow(number, "doc_id long, n_ids long, digests array<binary>, leaf binary, begin long, part long, block long")
    numbered.select("doc_id", "begin", "n_ids", "digests", "leaf", "part", "block").write.parquet(f"{path}/recipes")
    _merkle(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    remove(spark, staged)


def _merkle(recipes: DataFrame) -> DataFrame:
    def digest(column: str):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*([*order, column])))), lambda x: F.lower(F.hex(x[column]))), "")
        return F.unhex(F.sha2(joined.cast("binary"), 256))

    order = ["begin", "doc_id"]
    blocks = recipes.groupBy("part", "block").agg(digest("leaf").alias("digest"), F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    order = ["block"]
    parts = blocks.groupBy("part").agg(digest("digest").alias("top"), F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids")).withColumnRenamed("top", "digest")
    order = ["part"]
    whole = parts.agg(digest("digest").alias("top"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n_ids")).withColumnRenamed("top", "digest")
    columns = ["level", "part", "block", "digest", "n_docs", "n_ids"]
    none = F.lit(None).cast("long")
    return (
        blocks.withColumn("level", F.lit(0)).select(columns)
        .unionByName(parts.withColumn("level", F.lit(1)).withColumn("block", none).select(columns))
        .unionByName(whole.withColumn("level", F.lit(2)).withColumn("part", none).withColumn("block", none).select(columns))
    )


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest that the recipes no longer give (level, part, block); none for an intact store."""
    kept, made = (x.select("level", "part", "block", F.hex("digest").alias("digest"), "n_docs", "n_ids") for x in (spark.read.parquet(f"{path}/manifest"), _merkle(spark.read.parquet(f"{path}/recipes"))))
    return kept.exceptAll(made).unionByName(made.exceptAll(kept)).select("level", "part", "block").distinct()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_ids, ids binary (little-endian unsigned 32-bit); each chunk and recipe is held against its digest."""
    # One row per range partition: their number is that of the shuffle partitions, whatever the size of the data.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{path}/manifest").where("level = 1")
    offsets = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    recipes = spark.read.parquet(f"{path}/recipes").join(F.broadcast(offsets), "part").withColumn("start", F.col("begin") + F.col("offset"))
    chunks = _chunks(spark, path)
    wanted = recipes.select("doc_id", "start", "n_ids", "leaf", F.posexplode_outer("digests").alias("k", "digest"))
    found = joined_by_key(wanted, chunks, ["digest"], "n", "left").groupBy("doc_id", "start", "n_ids", "leaf").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "packed"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        _forget()
        expand = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                ids, ends = [], np.cumsum(pc.list_value_length(batch.column(4))).tolist()
                wanted, stored = (x.to_pylist() for x in batch.column(4).flatten().flatten()[1:])
                for doc, n, leaf, begin, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), [0, *ends[:-1]], ends, strict=True):
                    flat, digests = [], b""
                    for at in range(begin, end):
                        if wanted[at] is None:
                            continue
                        one, digest = unpack(stored[at], expand)
                        if digest != wanted[at]:
                            raise ValueError(f"a chunk of document {doc} does not have its digest")
                        digests += digest
                        flat.append(one.tobytes())
                    ids.append(b"".join(flat))
                    if len(ids[-1]) != 4 * n or hashlib.sha256(f"{doc},{n},".encode() + digests).digest() != leaf:
                        raise ValueError(f"the recipe of document {doc} does not have its digest")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_ids", "ids"])

    return found.mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to a store in the shared folder; the rows come from reading it back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "idstore")
    small_batches(spark)
    write_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    if not damaged(spark, path).isEmpty():
        raise ValueError("the recipes do not match the manifest")
    return read_store(spark, path).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
