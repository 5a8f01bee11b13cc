"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation is done here: at each place of the text the longest prefix in the model's compiled character map (a
double-array trie and a table of replacements) is replaced, and every byte written notes the byte of the text that it
came from. The library then segments the normalised text, with a copy of the model whose own normaliser is switched
off; its pieces tile the normalised bytes, so their edges, looked up in the alignment, are byte spans of the text.

Where no piece of the vocabulary holds a space symbol after another character, merges never cross from one word into
the next, so a normalised text may be segmented word by word and equal words looked up. That is checked when the model
is loaded; otherwise whole texts are segmented.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom._ship import ship
from pairloom.llm._common import table
from pairloom.llm._text import split_batch

SPACE = "▁"
#: Words whose pieces a worker remembers, in each of two halves, and the longest such word.
CACHE_WORDS = 250_000
CACHE_CHARS = 64
#: Bytes of text in one result batch.
PART_BYTES = 1 << 20


class CharsMap:
    """The compiled character map: longest_prefix(data, at) gives the replacement and the bytes it stands for."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.normalized = blob[4 + size :] if size else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest_prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        found, length = -1, 0
        if self.units:
            node = self._offset(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    found, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if length:
            return self.normalized[found : self.normalized.index(b"\0", found)], length
        first = data[at]
        length = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 0
        char = data[at : at + length]
        try:
            char.decode() if length else b"\xff".decode()
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd", 1
        return char, length


class Normalizer:
    def __init__(self, spec, suffix: bool = False):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = suffix
        self.plain = not self.map.units and not self.squeeze and self.escape and not suffix

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for their end the byte of the text that it came from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No map: only spaces change. All bytes of a character come from its first byte."""
        data = np.frombuffer(text, np.uint8)
        at = np.arange(len(data))
        lead = (data & 0xC0) != 0x80
        origin = np.maximum.accumulate(np.where(lead, at, 0))
        origin = np.repeat(origin, np.where(data == 0x20, 3, 1))
        head = np.zeros(3 if self.dummy else 0, np.int64)
        out = text.replace(b" ", SPACE.encode())
        return (SPACE.encode() if self.dummy else b"") + out, np.concatenate([head, origin, [len(data)]])

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, origin, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(text):
                got, n = self.map.longest_prefix(text, at)
                if got != b" ":
                    break
                at += n
            if at == len(text):
                return b"", np.array([at])

        def put(piece: bytes) -> None:
            for b in piece:
                add = space if b == 0x20 else bytes([b])
                out.extend(add)
                origin.extend([at] * len(add))

        if self.dummy and not self.suffix:
            put(b" ")
        after_space = self.squeeze
        while at < len(text):
            got, n = self.map.longest_prefix(text, at)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                put(got)
                after_space = self.squeeze and got.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[len(out) - len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        if self.dummy and self.suffix:
            put(b" ")
        return bytes(out), np.array([*origin, at])


class Encoder:
    def __init__(self, model: bytes, add_eos: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = [p.type for p in proto.pieces]
        if 4 in kinds:
            raise ValueError("models with user-defined symbols aren't supported")
        pieces = [p.piece for p in proto.pieces]
        self.lengths = np.array([1 if k == 6 else len(p.encode()) for k, p in zip(kinds, pieces, strict=True)], np.int64)
        self.unknown = self.library.unk_id()
        self.by_word = proto.trainer_spec.model_type == 2 and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = [self.library.eos_id()] if add_eos else []
        # the ids of a word as bytes; when the younger half is full it becomes the older one
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.words = re.compile(f"{SPACE}*[^{SPACE}]*")

    def _segment(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.segmenter.encode(text, num_threads=1), np.int32)
        words = self.words.findall(text)
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.older, self.cache = self.cache, {"": b""}
            new = set(words).difference(self.cache)
        cache, older = self.cache, self.older
        # a set's intersection with a dict would walk the whole dict
        known = {w for w in new if w in older}
        cache.update({w: older[w] for w in known})
        if ask := list(new.difference(known)):
            pieces = self.segmenter.encode(ask, num_threads=1)
            cache.update(zip(ask, [array("i", ids).tobytes() for ids in pieces], strict=True))
        out = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32)
        for w in ask:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and the end byte in the text of each; an end id stands at the text's end."""
        raw = text.encode()
        normal, origin = self.normalize(raw)
        segmented = normal.decode()
        ids = self._segment(segmented)
        sizes = self.lengths[ids]
        if (ids == self.unknown).any():
            surface = self.segmenter.encode(segmented, out_type=str, num_threads=1)
            sizes = np.array([len(p.encode()) if i == self.unknown else n for p, i, n in zip(surface, ids, sizes, strict=True)])
        edge = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=edge[1:])
        if edge[-1] != len(normal):
            raise ValueError("the pieces don't tile the normalised text")
        at = origin[edge].astype(np.int32)
        if self.end:
            tail = np.array([len(raw)], np.int32)
            return np.append(ids, np.int32(self.end[0])), np.append(at[:-1], tail), np.append(at[1:], tail)
        return ids, at[:-1], at[1:]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def read_model(path: str) -> bytes:
    """The model's bytes, read on the driver and sent with the tasks; models are a few MB at most."""
    with open(path, "rb") as f:
        model = f.read(64 << 20)
    if len(model) == 64 << 20:
        raise ValueError("the model is too large to be sent with each task")
    return model


_encoders: dict[tuple[int, bool], Encoder] = {}


def _encoder(model: bytes, add_eos: bool) -> Encoder:
    key = (hash(model), add_eos)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, add_eos)
    return _encoders[key]


def encode(
    docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", add_eos: bool = True, decoded: bool = False
) -> DataFrame:
    """One row per input row: the id, ids, starts, ends (arrays of int), and with decoded the text that ids decode to.

    starts and ends are bytes of the text in UTF-8, end exclusive. Pieces tile the text; of a character that is cut
    into byte pieces the last one has the whole span. A null or an empty text has the end id alone. Ids may repeat or
    be null; other columns are ignored. No shuffle.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model, add_eos)
        ints = pa.list_(pa.int32())
        for batch in batches:
            for part in split_batch(batch, 1, PART_BYTES):
                got = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32)
                flat = [pa.array(np.concatenate([g[k] for g in got])) for k in range(3)]
                cols = [part.column(0), *(pa.ListArray.from_arrays(pa.array(edges), x).cast(ints) for x in flat)]
                if decoded:
                    cols.append(pa.array([enc.decode(g[0].tolist()) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "starts", "ends", "decoded"][: len(cols)])

    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = "id long, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decoded
    return typed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and the text that ids_col decodes to; null ids decode to the empty text."""

    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model, True)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [enc.decode(ids) if ids else "" for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    typed = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").cast("array<int>"))
    return typed.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents"), read_model(tokenizer_path()), decoded=True)
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.alias("span_bytes"),
    )
