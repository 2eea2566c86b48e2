"""Operator 1: byte-level BPE encoding and decoding.

The rank file of a public tokenizer becomes a sentencepiece BPE model without
any training: each token's bytes are mapped to printable characters (one per
byte), its score is the negative rank, and the normaliser is the identity.
Sentencepiece then merges the adjacent pair with the best score, leftmost
first, which is the rank order of byte-level BPE.  A pre-token that is itself
in the vocabulary is taken whole, as byte-level BPE encoders do.

Pre-tokens are the matches of the tokenizer's pattern, encoded one by one.
Their ids are remembered within a Python worker in a table of bounded size;
only pre-tokens not met before reach the merger.

Cases.  Null and empty texts give no ids and the hash of nothing.  Repeated
rows are encoded each for itself.  Other columns pass through; an input column
named like an output column is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the ranks' tokens as pieces 1, 2, ... and piece 0 unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank))
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes texts with the serialised model."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.to_chars = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.rank_of_piece = [-1, *sorted(ranks.values())]
        self.whole = {token: str(rank) for token, rank in ranks.items()}
        self.token_of = {str(rank): token for token, rank in ranks.items()}
        self.known: dict[str, str] = {}

    def _learn(self, pretokens: set[str]) -> dict[str, str]:
        out, rest = {}, []
        for p in pretokens:
            whole = self.whole.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                out[p] = whole
        if rest:
            mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in rest]
            for p, pieces in zip(rest, self.merger.encode(mapped, out_type=int, num_threads=1)):
                out[p] = ",".join([str(self.rank_of_piece[i]) for i in pieces])
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, for each text."""
        split = [self.split(t) for t in texts]
        seen = set().union(*split)
        new = self._learn(seen.difference(self.known)) if seen else {}
        if len(self.known) + len(new) > REMEMBERED:
            kept = {p: ids for p in seen if (ids := self.known.get(p)) is not None}
            self.known, new = {}, new | kept
        if len(new) > REMEMBERED:
            table = new
        else:
            self.known.update((p, ids) for p, ids in new.items() if len(p) <= LONGEST_REMEMBERED)
            table = self.known if all(len(p) <= LONGEST_REMEMBERED for p in new) else self.known | new
        return [",".join([table[p] for p in pretokens]) for pretokens in split]

    def decode(self, ids: str) -> bytes:
        return b"".join([self.token_of[i] for i in ids.split(",")]) if ids else b""


_codecs: dict[tuple[str, int, str], Codec] = {}


def _codec(shared: Broadcast, key: tuple[str, int, str]) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        ranks, model, pattern = shared.value
        _codecs[key] = Codec(ranks, model, pattern)
    return _codecs[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids (the token ids in decimal, joined by commas), n_tokens and decoded (the bytes that the ids stand for).

    One narrow pass over Arrow batches in pieces of about a megabyte of text;
    the broadcast is the vocabulary file and its model, of fixed size."""
    spark: SparkSession = docs.sparkSession
    ranks = read_ranks(rank_path)
    shared = spark.sparkContext.broadcast((ranks, serialise_model(ranks), pattern))
    key = (rank_path, len(ranks), pattern)
    added = {"ids": T.StringType(), "n_tokens": T.LongType(), "decoded": T.BinaryType()}
    kept = docs.drop(*added)
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        for batch in it:
            for piece in pieces(batch, at):
                ids = codec.encode([t or "" for t in piece.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(ids, pa.string()), pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()), pa.array([codec.decode(i) for i in ids], pa.binary())],
                    names=[*piece.schema.names, *added],
                )

    return kept.mapInArrow(batches, schema)


def pieces(batch: pa.RecordBatch, at: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes in a column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns of an encoded table."""
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
