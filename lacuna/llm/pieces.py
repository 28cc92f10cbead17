"""SentencePiece encoding and decoding by a table of distinct chunks.

The library turns each space into a marker and puts one before the text. Where no piece has a marker after another character (`separable` looks at the whole
model), merges never cross the place before a run of markers, so that a text is segmented chunk by chunk: a run of markers and the word after it.

Texts are cut, task by task, into blocks of about BLOCK_BYTES. A block keeps its distinct chunks, dealt to buckets by hash, and each document as the places of
its chunks among them. A bucket has a chunk from all blocks: there each distinct chunk is segmented once. The ids go back to their blocks and are
joined to the documents by position. What is shuffled are distinct chunks of blocks and places, not words; a frequent word is in a block once, so that no
key is hot. A task holds the distinct chunks of one bucket, or one block. More buckets than shuffle partitions keep tasks even. Texts are read and cut twice, once for
chunks and once for places, which costs less than to store both; a block is named by a hash of its chunks, so that blocks that were cut otherwise the second
time (rows dealt to tasks anew) don't find theirs, and the job fails instead of joining wrong ids.

A model that isn't separable (another normaliser, markers as suffixes, pieces over several words) gets whole texts as chunks: copies are segmented once.

Defined results: null text is empty and has only the begin and end ids; repeated rows are encoded alike; an empty table gives an empty result; white space other
than the space is part of a word; a marker character in a text counts as a space, as in the library; columns that aren't kept aren't read, and kept
ones may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import arrow_schema

MARK, BLOCK_BYTES = "\u2581", 4 << 20
#: Buckets for each shuffle partition.
BUCKETS_EACH = 4
#: A document comes after all chunks of its block.
AFTER_CHUNKS = 1 << 40


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(model: bytes) -> bool:
    """Whether texts can be segmented chunk by chunk."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    n, t = m.normalizer_spec, m.trainer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not (n.remove_extra_whitespaces or n.precompiled_charsmap or t.treat_whitespace_as_suffix)
    pieces = [p.piece for p in m.pieces]
    return plain and t.model_type == t.BPE and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)


def chunks_of(texts, by_word: bool = True):
    """All chunks of an Arrow array of texts, in order, and how many each text has. A chunk is its word, after a space for each marker but the first;
    markers at the end of a text are a chunk without a word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not by_word:
        some = pc.greater(pc.binary_length(texts), 0)
        return texts.filter(some), some.to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
    n, flat = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if full.all():
        return flat, n
    ends = np.cumsum(n)
    starts, at = ends - n, np.arange(len(flat))
    of = np.repeat(np.arange(len(n)), n)
    # the last full word up to each place, or the place before its text
    last = np.maximum(np.maximum.accumulate(np.where(full, at, -1)), starts[of] - 1)
    before = np.concatenate([[-1], last[:-1]])
    before = np.maximum(before, starts[of] - 1)
    tail = np.zeros(len(flat), bool)
    tail[ends[n > 0] - 1] = True
    # a text without any character is one empty word and has no chunk
    tail &= ~full & ~((n == 1)[of])
    kept = full | tail
    spaces = (at - before - 1)[kept]
    out = flat.filter(pa.array(kept))
    if spaces.any():
        out = pc.binary_join_element_wise(pc.binary_repeat(pa.array([" "] * len(spaces)), pa.array(spaces)), out, "")
    return out, np.bincount(of[kept], minlength=len(n))


def planes(a: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first, compressed: high bytes are mostly zero."""
    return _zstd()[0].compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def strings(lengths: np.ndarray, raw: bytes):
    """Strings from their lengths and their bytes, one after the other."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)).to_pylist()


def cut(docs: DataFrame, text: str, keep: Sequence[str], buckets: int, by_word: bool, chunks_wanted: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: a row for each bucket of a block's distinct chunks, sorted and compressed (at: the place of the first one), or one for each document
    (places)."""
    names = [f"k{i}" for i in range(len(keep))]
    kept = [f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    ddl = ", ".join(["block bigint", "bucket int", "at bigint", "lengths binary", "chunks binary", "places binary", *kept])
    schema = arrow_schema(ddl)
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        def block(table):
            chunks, n = chunks_of(table["text"].combine_chunks(), by_word)
            coded = chunks.dictionary_encode()
            distinct = coded.dictionary
            bucket = (pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(buckets)).astype(np.int64) if len(distinct) else np.empty(0, np.int64)
            order = pc.sort_indices(distinct).to_numpy().astype(np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            used, first = np.unique(bucket[order], return_index=True)
            dealt, last = distinct.take(pa.array(order)), np.append(first[1:], len(order))
            long = pc.binary_length(dealt).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, ends = dealt.buffers()[2], np.concatenate([[0], np.cumsum(long)])
            raw = raw.to_pybytes() if raw else b""
            name = int.from_bytes(hashlib.blake2b(long.tobytes() + raw, digest_size=8).digest(), "little", signed=True)
            if chunks_wanted:
                own = [(planes(long[a:b]), _zstd()[0].compress(raw[ends[a] : ends[b]])) for a, b in zip(first, last, strict=True)]
                return record({"block": [name] * len(used), "bucket": used, "at": first, "lengths": [a for a, _ in own], "chunks": [b for _, b in own]})
            places, ends = place[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(n)
            return record({"block": [name] * len(n), "at": AFTER_CHUNKS + np.arange(len(n)), "places": [planes(places[e - k : e]) for e, k in zip(ends, n, strict=True)]} | {c: table[c].combine_chunks() for c in names})

        def record(columns):
            m = len(columns["at"])
            return pa.RecordBatch.from_arrays([_column(columns.get(f.name), f.type, m) for f in schema], schema=schema)

        waiting, size = [], 0
        for b in batches:
            long = np.cumsum(pc.binary_length(b["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < b.num_rows:
                done = int(long[start - 1]) if start else 0
                # up to the row that fills the block
                stop = min(int(np.searchsorted(long, done + block_bytes - size)) + 1, b.num_rows)
                waiting.append(b.slice(start, stop - start))
                size += int(long[stop - 1]) - done
                start = stop
                if size >= block_bytes:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if waiting:
            yield block(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, ddl)


def _column(values, kind, n: int):
    import pyarrow as pa

    if values is None:
        return pa.nulls(n, kind)
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def segmented(chunks: DataFrame, model: bytes, by_word: bool) -> DataFrame:
    """(block, at, counts, ids) of the chunks (block, bucket, at, lengths, chunks), sorted by bucket: each distinct chunk of a bucket is segmented once."""
    ddl = "block bigint, at bigint, counts binary, ids binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp = processor(model)
        now, known = None, {}
        if by_word:
            lone = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        for b in batches:
            counts, ids = [], []
            for bucket, long, own in zip(b["bucket"].to_pylist(), b["lengths"], b["chunks"], strict=True):
                if bucket != now:
                    now, known = bucket, {"": lone} if by_word else {}
                own = strings(from_planes(long.as_py()), _zstd()[1].decompress(own.as_py()))
                new = [c for c in own if c not in known]
                known.update(zip(new, (np.array(x, "<u4").tobytes() for x in sp.encode(new, num_threads=1)), strict=True))
                got = [known[c] for c in own]
                counts.append(planes(np.array([len(g) for g in got], np.int64) // 4))
                ids.append(planes(np.frombuffer(b"".join(got), "<u4")))
            yield pa.RecordBatch.from_arrays([b["block"], b["at"], pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], schema=schema)

    return chunks.mapInArrow(run, ddl)


def encoded(docs: DataFrame, model_file: str | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",), add_bos: bool = True, add_eos: bool = True) -> DataFrame:
    """The kept columns and `ids` (binary, little-endian unsigned 32-bit numbers), as the library encodes each whole text."""
    spark = docs.sparkSession
    with open(model_file or default_model(), "rb") as f:
        model = f.read()
    by_word, tasks = separable(model), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sp = processor(model)
    begin, end = ([sp.bos_id()] if add_bos else []), ([sp.eos_id()] if add_eos else [])
    names = [f"k{i}" for i in range(len(keep))]
    # the kept columns are read for chunks too, so that both plans deal rows alike
    chunks = cut(docs, text, keep, BUCKETS_EACH * tasks, by_word, True).select("block", "bucket", "at", "lengths", "chunks").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    rows = cut(docs, text, keep, BUCKETS_EACH * tasks, by_word, False).select("block", "at", "places", *names)
    both = segmented(chunks, model, by_word).unionByName(rows, allowMissingColumns=True)
    ddl = ", ".join(["ids binary", *(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))])
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, parts, table, size = None, [], None, 0
        for b in batches:
            is_doc = b["places"].is_valid().to_numpy(zero_copy_only=False)
            out = []
            for k, (block, at) in enumerate(zip(b["block"].to_pylist(), b["at"].to_pylist(), strict=True)):
                if block != now:
                    now, parts, table, size = block, [], None, 0
                if not is_doc[k]:
                    # blocks with the same chunks have one name and the same rows
                    if at == size:
                        parts.append((from_planes(b["counts"][k].as_py()), from_planes(b["ids"][k].as_py())))
                        size += len(parts[-1][0])
                    continue
                if table is None:
                    counts, ids = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
                    table, parts = (counts, np.cumsum(counts) - counts, ids), []
                out.append(joined(from_planes(b["places"][k].as_py()), *table, begin, end))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *(b[n].filter(pa.array(is_doc)) for n in names)], schema=schema)

    rows = both.repartition(tasks, "block").sortWithinPartitions("block", "at").mapInArrow(run, ddl)
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "ids")


def joined(places: np.ndarray, counts: np.ndarray, starts: np.ndarray, ids: np.ndarray, begin: list[int], end: list[int]) -> bytes:
    """The ids of the chunks at the places, one after the other."""
    if len(places) and places.max() >= len(counts):
        raise RuntimeError("a block's chunks are missing: the documents were dealt to tasks anew between two reads; store them first")
    n = counts[places]
    total = int(n.sum())
    take = np.repeat(starts[places] - (np.cumsum(n) - n), n) + np.arange(total)
    return np.concatenate([begin, ids[take], end]).astype("<u4").tobytes()


def decoded(df: DataFrame, model_file: str | None = None, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the library's text of the ids (binary); of null ids null."""
    with open(model_file or default_model(), "rb") as f:
        model = f.read()
    schema = arrow_schema(ddl := ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "decoded string"]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp = processor(model)
        for b in batches:
            out = [None if (raw := x.as_py()) is None else sp.decode(np.frombuffer(raw, "<u4").tolist()) for x in b[ids]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], schema=schema)

    return df.mapInArrow(run, ddl)


def op12_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids with begin and end, and read back."""
    rows = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
