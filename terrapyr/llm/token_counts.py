"""Operator 2, token counts: a separator scan over flat, unindexed token files.

A flat file holds token identifiers of two or four bytes, little endian, and an
end-of-document identifier after each document; nothing says where documents begin.
`scan_counts` cuts files into blocks, finds the separators of each block in one vectorised
comparison, and stitches documents that cross blocks by a prefix scan over the blocks'
summaries: how many separators came before, and where the last one was. A rest without a
separator at a file's end is a document too.

`write_flat` makes such files of texts and returns the order of documents in them. Null and
empty texts have no tokens and still a separator. Texts are encoded whole, whatever their
length: a writer holds one document, a reader one block. Repeated rows are documents of their
own, and ties do not arise: a document is found by its place in its file. An empty table gives
no file and no counts. Other columns may have any names; they are not read. Files have names
of their own for every attempt and are complete before the manifest names them.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, settle, table
from .warc import _store

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: bytes):
    """An encoding of a public rank file, and the identifier that is free for separators."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


#: Fixed value: white space as the pattern's `\\s` has it.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def encode(encoding, text: str) -> list[int]:
    """The encoding of a text. The pattern's look-ahead recurses once a blank, so long runs of blanks are cut where it cuts them: all but the last, which goes with what follows, are one piece."""
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        last = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : last].encode())
        at = last
    return out + encoding.encode_ordinary(text[at:])


def token_type(separator: int) -> np.dtype:
    return np.dtype("<u2" if separator < 1 << 16 else "<u4")


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, file_bytes: int = 256 << 20) -> tuple[DataFrame, int]:
    """Writes the files. Returns (file, ordinal, doc_id) and the separator."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared, separator = docs.sparkSession.sparkContext.broadcast(raw), encoder(raw)[1]
    kind = token_type(separator)

    def work(batches):
        import pyarrow as pa

        encoding = encoder(shared.value)[0]
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, ids, size = None, "", [], 0

        def close():
            nonlocal out, ids, size
            out.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array([x.as_py() for x in ids], ids[0].type)], ["file", "ordinal", "doc_id"])
            out, ids, size = None, [], 0
            return done

        for batch in batches:
            texts = batch.column(1)
            for k in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.tokens"
                    out = store.open_output_stream(f"{root}/{name}.part")
                text = texts[k].as_py()
                tokens = np.array([*(encode(encoding, text) if text else ()), separator], kind)
                out.write(tokens.tobytes())
                ids.append(batch.column(0)[k])
                size += tokens.nbytes
                if size >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(work, f"file string, ordinal long, doc_id {id_kind}")
    return settle(rows, "manifest"), separator


def scan_counts(files: DataFrame, separator: int, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files (column file)."""
    kind = token_type(separator)
    step = block_bytes // kind.itemsize * kind.itemsize

    def stat(batches):
        import pyarrow as pa

        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([s.get_file_info(p).size for s, p in map(_store, paths)], pa.int64())], ["file", "bytes"])

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for path, block, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _store(path)
                with store.open_input_file(inner) as f:
                    tokens = np.frombuffer(f.read_at(min(step, size - block * step), block * step), kind)
                at = np.flatnonzero(tokens == separator) + block * (step // kind.itemsize)
                if (block + 1) * step >= size and len(tokens) and tokens[-1] != separator:
                    at = np.append(at, size // kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([at[-1] if len(at) else None], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "many", "last", "ends"])

    many = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = files.select("file").distinct().repartition(many, "file").mapInArrow(stat, "file string, bytes long").where("bytes > 0")
    blocks = blocks.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"), "bytes").repartition(many, "file", "block")
    found = settle(blocks.mapInArrow(scan, "file string, block long, many long, last long, ends array<long>"), "separators")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.select("file", "block", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    joined = found.where("many > 0").join(stitched, ["file", "block"])
    starts = F.concat(F.array("previous"), F.slice("ends", 1, F.size("ends") - 1))
    lengths = F.zip_with("ends", starts, lambda e, s: e - s - 1)
    return joined.select("file", "base", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, separator = write_flat(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"))
    return order.join(scan_counts(order, separator), ["file", "ordinal"]).select("doc_id", "n_tokens")
