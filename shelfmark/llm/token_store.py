"""Content-addressed store of token-id streams.

A document's ids (with the end id) are cut where a rolling hash over WINDOW ids says so, so like
passages give like chunks wherever they stand.  The store has four Parquet tables below one path:

``chunks``    address, data: each distinct chunk once; the address is a digest of the data
``recipes``   in ascending document order: part, row, doc_id, n_tokens, start in the part, addresses
``manifest``  part, n_docs, n_tokens, root: the Merkle root over the part's recipes
``root``      n_docs, n_tokens, root: the Merkle root over the parts' roots

Ids are stored in 16 bits where the vocabulary allows it, else in 32.  Encoding writes each task's
new chunks once; a shuffle by address leaves each chunk once overall.  Reading never moves chunk
data: every chunk is checked against its address and summed up as (length, CRC) where it lies, and
documents combine those of their chunks, as the CRC of a concatenation follows from its parts'.

Cases with a defined result
    null or empty text: the end id alone
    null id: before every other id; rows that repeat an id: in order of their chunk addresses
    very long text: cut like any other; a chunk has MAX_CHUNK ids at most
    empty table: an empty store, an empty result
    repeated rows: stored and read each on its own, their chunks once
    extra columns, whatever their names: not read
    a changed or lost chunk: reading raises an error; a changed or lost recipe or part of the manifest:
        ``verify`` does
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import read_vocabulary
from .common import Scratch, ship
from .units import Runs, UnitEncoder, as_runs

END_ID = 2
WINDOW, MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 16, 64, 8, 2048
ADDRESS_BYTES = 20
#: Pieces that a worker keeps in a generation of its cache, and bytes of a group of texts (see units): each group
#: searches the whole cache, so groups are large.
CACHE_PIECES, GROUP_BYTES = 1_000_000, 1 << 24
#: How byte-level vocabularies write a space.
SPACE = "\u0120"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Where the sum of the WINDOW mixed ids before has MEAN_BITS zero bits."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    rolling = total[WINDOW:] - total[:-WINDOW]
    return np.flatnonzero((rolling >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW


def chunk_ends(places: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the document at start..end, from its cut places.  A chunk has MIN_CHUNK ids or
    more, so no window reaches into the document before."""
    ends, last = [], start
    for c in places:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK:
            ends.append(c)
            last = c
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < end:
        ends.append(end)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return chunk_ends(cut_places(ids).tolist(), 0, len(ids))


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=ADDRESS_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def leaf(doc_id: int | None, n_tokens: int, addresses: list[bytes]) -> bytes:
    return f"{doc_id}:{n_tokens}:".encode() + b"".join(addresses)


# --- CRC-32 of a concatenation: polynomials over GF(2), bit-reversed as zlib has them

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a times b modulo the CRC's polynomial."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _powers() -> np.ndarray:
    """x to the power of 8 * v * 256**k, as row k, column v."""
    out, step = np.empty((5, 256), np.uint32), 1 << 23  # x to the power of 8
    for row in out:
        row[0] = value = 1 << 31
        for v in range(1, 256):
            row[v] = value = _times(value, step)
        step = _times(value, step)
    return out


_POWERS = _powers()


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_times of each a with its b."""
    out, one = np.zeros(len(a), np.uint32), np.uint32(1)
    for k in range(31, -1, -1):
        out ^= b * (a >> np.uint32(k) & one)
        b = (b >> one) ^ (np.uint32(_POLY) * (b & one))
    return out


def join_crcs(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC of each run of pieces joined; ``first`` says where the runs start, and none is empty.  A piece counts as its
    CRC times x to the power of the bits that follow it in its run."""
    upto = np.cumsum(n_bytes, dtype=np.int64)
    ends = np.append(first[1:], len(crc)) - 1
    after = (np.repeat(upto[ends], np.diff(first, append=len(crc))) - upto).astype(np.int64)
    out = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length() + 7 >> 3):
        out = _times_all(_POWERS[k][after >> 8 * k & 255], out)
    return np.bitwise_xor.reduceat(out, first) if len(crc) else out


_encoders: dict[str, UnitEncoder] = {}
#: New pieces that the library gets as one text.
_JOINED = 1 << 14


def _library_units(tokenizer, starts: np.ndarray) -> Callable[[pa.Array], Runs]:
    """Encodes pieces as one text, set apart by spaces, and cuts its ids where a token begins with a space:
    a piece has no space of its own, so there is one such token a piece."""

    def encode(pieces: pa.Array) -> Runs:
        ids, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for k in range(0, len(pieces), _JOINED):
            run = pieces.slice(k, _JOINED)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(run)], pa.int32()), run), " ")[0].as_py()
            got = np.array(tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(starts[got])
            if len(at) != len(run):
                raise ValueError("the vocabulary joins tokens across spaces")
            ids.append(got)
            size.append(np.diff(at, append=len(got)).astype(np.int32))
        return np.concatenate(ids), np.concatenate(size)

    return encode


def _encoder(spec: str) -> UnitEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _encoders:
        t = Tokenizer.from_str(spec)
        t.no_truncation()
        t.no_padding()
        vocabulary = t.get_vocab()
        starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        starts[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        special = tuple(x.content for x in t.get_added_tokens_decoder().values())

        def whole(texts: list[str]) -> Runs:
            return as_runs([np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)])

        _encoders[key] = UnitEncoder(_library_units(t, starts), whole, special, CACHE_PIECES, GROUP_BYTES)
    return _encoders[key]


def _id_width(spec: str) -> str:
    import json

    j = json.loads(spec)
    most = max([*j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"]), END_ID])
    return "<u2" if most < 1 << 16 else "<u4"


def write(docs: DataFrame, vocabulary: str, path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` with the tokenizers library and write the store below ``path``."""
    spark = docs.sparkSession
    ship(spark)
    text_of = read_vocabulary(vocabulary)
    spec, width = spark.sparkContext.broadcast(text_of), _id_width(text_of)
    size, binaries = int(width[-1]), pa.list_(pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(spec.value), set()
        for batch in batches:
            n, addresses, fresh, data = [], [], [], []
            for ids, ends in encoder.encode(batch.column(1)):
                ids = np.insert(ids, ends, END_ID)
                ends = ends.astype(np.int64) + np.arange(1, len(ends) + 1)
                places = cut_places(ids)
                upto = np.searchsorted(places, ends, side="right").tolist()
                places, stored = places.tolist(), ids.astype(width).tobytes()
                start = first = 0
                for end, k in zip(ends.tolist(), upto, strict=True):
                    last, own, new, new_data = start, [], [], []
                    for c in chunk_ends(places[first:k], start, end):
                        chunk = stored[size * last : size * c]
                        a = address(chunk)
                        own.append(a)
                        if a not in seen:
                            seen.add(a)
                            new.append(a)
                            new_data.append(chunk)
                        last = c
                    n.append(end - start)
                    addresses.append(own)
                    fresh.append(new)
                    data.append(new_data)
                    start, first = end, k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(addresses, binaries), pa.array(fresh, binaries), pa.array(data, binaries)],
                names=["doc_id", "n_tokens", "addresses", "fresh", "data"],
            )

    schema = "doc_id long, n_tokens long, addresses array<binary>, fresh array<binary>, data array<binary>"
    encoded = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encode, schema)
    staged = scratch.path("encoded")
    encoded.write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.schema(encoded.schema).parquet(staged)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a not in seen:
                    seen.add(a)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    pieces = encoded.select(F.explode(F.arrays_zip("fresh", "data")).alias("c")).select(F.col("c.fresh").alias("address"), F.col("c.data").alias("data"))
    # a task has sent each chunk once, so an address has a row per task at most
    pieces.repartition("address").mapInArrow(once, "address binary, data binary").write.option("compression", "zstd").parquet(f"{path}/chunks")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            starts = start + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + len(n))), *batch.columns[1:], pa.array(starts)],
                names=["part", "row", "doc_id", "n_tokens", "addresses", "start_in_part"],
            )
            row, start = row + len(n), start + int(n.sum())

    recipes = (
        encoded.select("doc_id", "n_tokens", "addresses", F.xxhash64("addresses").alias("tie"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "addresses")
        .mapInArrow(in_order, "part int, row long, doc_id long, n_tokens long, addresses array<binary>, start_in_part long")
    )
    recipes.write.parquet(f"{path}/recipes")
    _write_manifest(spark, path)
    scratch.drop(staged)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, row long, doc_id long, n_tokens long, addresses array<binary>, start_in_part long").parquet(f"{path}/recipes")


#: Nodes below a node of the Merkle trees as they are folded here.
_FAN_IN = 1024


def _fold(level: DataFrame, most: int) -> DataFrame:
    """(part, n_docs, n, leaf) of ``level`` (part, row, n_docs, n, leaf): one root a part, by runs of _FAN_IN
    rows; ``most`` is the highest row number."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(roots, pa.binary())], names=["part", "row", "n_docs", "n", "leaf"])

    while True:
        lists = level.groupBy("part", F.floor(F.col("row") / _FAN_IN).cast("long").alias("row")).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("row", "leaf"))).alias("l")
        )
        level = lists.select("part", "row", "n_docs", "n", F.expr("transform(l, x -> x.leaf)").alias("leaf")).mapInArrow(fold, "part int, row long, n_docs long, n long, leaf binary")
        most //= _FAN_IN
        if not most:
            return level.drop("row")


def _roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root), one row per part: leaves are hashed where they lie, and only
    digests are brought together."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            digest = [hashlib.sha256(leaf(d, n, a)).digest() for _, _, d, n, a in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(digest, pa.binary())], names=["part", "row", "n", "leaf"])

    level = recipes.select("part", "row", "doc_id", "n_tokens", "addresses").mapInArrow(leaves, "part int, row long, n long, leaf binary").withColumn("n_docs", F.lit(1).cast("long"))
    most = recipes.agg(F.max("row")).first()[0] or 0
    return _fold(level, most).select("part", "n_docs", F.col("n").alias("n_tokens"), F.col("leaf").alias("root"))


def _store_root(manifest: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens, root): the Merkle root over the parts' roots; none for an empty store."""
    level = manifest.select(F.lit(0).alias("part"), F.col("part").cast("long").alias("row"), "n_docs", F.col("n_tokens").alias("n"), F.col("root").alias("leaf"))
    most = manifest.agg(F.max("part")).first()[0] or 0
    return _fold(level, most).select("n_docs", F.col("n").alias("n_tokens"), F.col("leaf").alias("root"))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, n_docs long, n_tokens long, root binary").parquet(f"{path}/manifest")


def _write_manifest(spark: SparkSession, path: str) -> None:
    _roots(_recipes(spark, path)).write.parquet(f"{path}/manifest")
    _store_root(_manifest(spark, path)).write.parquet(f"{path}/root")


def verify(spark: SparkSession, path: str) -> None:
    """Raise an error unless the recipes give just the parts and Merkle roots of the manifest, and the manifest
    the store's root.  A part that either side lacks is an error too."""
    manifest, same = _manifest(spark, path), ["part", "n_docs", "n_tokens", "root"]
    found = _roots(_recipes(spark, path)).select(*same, F.lit(True).alias("found"))
    sides = manifest.select(*same, F.lit(True).alias("listed")).join(found, same, "full_outer")
    if not sides.where("found IS NULL OR listed IS NULL").isEmpty():
        raise ValueError(f"the recipes of {path} do not agree with its manifest")
    stated = spark.read.schema("n_docs long, n_tokens long, root binary").parquet(f"{path}/root").collect()
    if _store_root(manifest).collect() != stated:
        raise ValueError(f"the manifest of {path} does not agree with its root")


def read_sums(spark: SparkSession, path: str, width: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    ship(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # all chunks of a batch are widened at once
            size = np.dtype(width).itemsize
            chunks = batch.column(1).to_pylist()
            if any(address(c) != a for a, c in zip(batch.column(0).to_pylist(), chunks, strict=True)):
                raise ValueError("a chunk does not have its address")
            ends = np.cumsum([len(c) for c in chunks], dtype=np.int64) // size
            wide = memoryview(np.frombuffer(b"".join(chunks), dtype=width).astype("<u4").tobytes())
            starts = [0, *(4 * ends).tolist()]
            n = np.diff(ends, prepend=0).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    chunks = spark.read.schema("address binary, data binary").parquet(f"{path}/chunks").mapInArrow(sums, "address binary, n int, crc long")
    recipes = _recipes(spark, path)
    used = recipes.select("part", "row", F.posexplode("addresses").alias("pos", "a"))
    met = used.join(chunks, F.col("a") == F.col("address"), "left")
    lists = met.groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("l"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = batch.column(2), batch.column(3).flatten()
            n = sizes.flatten()
            if n.null_count:
                raise ValueError("a document's chunk is missing from the store")
            first = (sizes.offsets.to_numpy()[:-1] - sizes.offsets[0].as_py()).astype(np.int64)
            n = n.to_numpy().astype(np.int64)
            total = np.add.reduceat(n, first) if len(n) else n
            crcs = join_crcs(sums.to_numpy(), 4 * n, first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(crcs)], names=["part", "row", "n", "crc"])

    found = lists.selectExpr("part", "row", "transform(l, x -> x.n) AS ns", "transform(l, x -> x.crc) AS cs").mapInArrow(combine, "p int, r long, n long, crc long")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = _manifest(spark, path).select(F.col("part").alias("m"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    return (
        recipes.select("part", "row", "doc_id", "start_in_part").join(found, (F.col("part") == F.col("p")) & (F.col("row") == F.col("r")))
        .join(F.broadcast(parts), F.col("part") == F.col("m"))  # as many rows as write() had partitions
        .select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    )


def read_documents(spark: SparkSession, path: str, width: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document, rebuilt from its chunks."""
    chunks = spark.read.parquet(f"{path}/chunks")
    used = _recipes(spark, path).select("part", "row", "doc_id", F.posexplode("addresses").alias("pos", "a"))
    lists = used.join(chunks, F.col("a") == F.col("address")).groupBy("part", "row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("l"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), dtype=width).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return lists.selectExpr("doc_id", "transform(l, x -> x.data) AS d").mapInArrow(rebuild, "doc_id long, ids array<int>")


def store_and_read(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Write the store, verify its manifest, and sum up its documents from the files."""
    scratch = scratch or Scratch(docs.sparkSession, "token-store")
    path = scratch.path("store")
    write(docs, vocabulary, path, scratch, id_col, text_col)
    verify(docs.sparkSession, path)
    return read_sums(docs.sparkSession, path, _id_width(read_vocabulary(vocabulary)))
