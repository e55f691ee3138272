"""SentencePiece encoding and decoding with the byte span of every piece.

A text is first normalized by the model's own compiled character map: at each place the
longest prefix that the map has is replaced, and each normalized byte remembers the original
bytes that it came from. The library then encodes the normalized text with a copy of the
model whose map is empty, so nothing is normalized twice; a piece's normalized bytes, taken
in order, give its span of original UTF-8 bytes.

Where no piece of the model has a space after another character, pieces never reach over the
start of a space; then the ids of words with their space are kept and joined, and only new
words are encoded. Texts with runs of spaces are encoded whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import kept_by, texts
from mediaframe.llm.tokens import in_slices, joined, slices

SPACE = "▁".encode()
#: Words kept per worker; an entry takes about 200 bytes.
KEPT_RUNS = 400_000
#: Stands before a text's first word, which has no space; texts that have it, the sign for a space or runs of spaces are encoded whole.
FIRST = "\x02"
ODD = "\x02|▁|  |^ | $|^$"


class CharacterMap:
    """The compiled map of a model: a double-array trie over source bytes, whose values are places in a block of null-ended replacements."""

    def __init__(self, blob: bytes):
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.to = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
        else:
            self.units, self.to = [], b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest mapped prefix of text[at:] takes, and what replaces them."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != text[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        taken, where = found
        return taken, self.to[where : self.to.index(b"\0", where)]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = proto.NormalizerSpec()
        self.spec.CopyFrom(model.normalizer_spec)
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        #: Symbols that are never normalized, by their first bytes, the longest first.
        self.symbols: dict[int, list[bytes]] = {}
        for symbol in sorted((p.piece.encode() for p in model.pieces if p.type == proto.ModelProto.SentencePiece.USER_DEFINED), key=len, reverse=True):
            self.symbols.setdefault(symbol[0], []).append(symbol)
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.decoder = sentencepiece.SentencePieceProcessor(model_file=path)
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.lengths = np.array([1 if p.type == proto.ModelProto.SentencePiece.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown, self.end = self.decoder.unk_id(), self.decoder.eos_id()
        #: Bytes of the text that a piece stands for, where a space is one byte.
        self.widths = np.array([n - 2 * p.piece.count("▁") for n, p in zip(self.lengths.tolist(), model.pieces, strict=True)], np.int64)
        normal = [p.piece for p in model.pieces if p.type in (proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece.USER_DEFINED)]
        whole_words = model.trainer_spec.byte_fallback and not any("▁" in p.lstrip("▁") for p in normal)
        self.texts_of_ids = list(map(str, range(len(model.pieces))))
        self.runs: dict[str, bytes] = {}
        #: Without map and space rules a text is normalized already, but for the sign that stands for a space and one before the text.
        self.plain = not self.map.units and not self.spec.remove_extra_whitespaces

        self.by_words = self.plain and whole_words

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with end ids, where each text's begin with the end of the last, and the byte of its
        text at which each id ends (that of the text for end ids)."""
        texts = pc.fill_null(texts, "")
        if len(self.runs) > KEPT_RUNS:
            self.runs.clear()
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        parts = [None] * len(texts)
        if len(plain):
            dummy = int(self.spec.add_dummy_prefix)
            ids, cuts = joined(pc.split_pattern(plain if dummy else pc.binary_join_element_wise(FIRST, plain, ""), " "), self.runs, self._learn)
            total = np.concatenate([[0], np.cumsum(self.widths[ids])])
            size = pc.binary_length(plain).to_numpy()
            for k, a, b, n in zip(np.flatnonzero(~odd).tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), size.tolist(), strict=True):
                if total[b] - total[a] == n + dummy:
                    parts[k] = ids[a:b], total[a + 1 : b + 1] - total[a] - dummy
        rest = [k for k, p in enumerate(parts) if p is None]
        if rest:
            whole = [texts[k].as_py() for k in rest]
            for k, i, (_, ends) in zip(rest, *self.encode(whole), strict=True):
                parts[k] = np.array(i[:-1], np.int64), ends
        cuts = np.concatenate([[0], np.cumsum([len(i) + 1 for i, _ in parts])])
        out, ends = np.full(cuts[-1], self.end, np.uint32), np.zeros(cuts[-1], np.int64)
        for (i, e), a, b in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[a : b - 1] = i
            ends[a : b - 1] = e
            ends[b - 1] = e[-1] if len(e) else 0
        return out, cuts, ends

    def _learn(self, new: list[str]) -> None:
        shown = [r[1:] if r.startswith(FIRST) else " " + r for r in new]
        self.runs.update((r, np.array(i, "<u4").tobytes()) for r, i in zip(new, self.encoder.encode(shown, out_type=int, num_threads=1), strict=True))

    def normalized(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalized text and, for each of its bytes, start and end of the original bytes it stands for."""
        raw = text.encode()
        if self.map.units or self.spec.remove_extra_whitespaces:
            data, lo, hi = self._mapped(raw)
        else:
            data, lo, hi = raw, np.arange(len(raw)), np.arange(1, len(raw) + 1)
        if self.spec.add_dummy_prefix and data:
            if self.suffix:
                data, lo, hi = data + b" ", np.append(lo, hi[-1:]), np.append(hi, hi[-1:])
            else:
                data, lo, hi = b" " + data, np.concatenate([lo[:1], lo]), np.concatenate([lo[:1], hi])
        return data.decode(errors="replace"), lo, hi

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Symbols are copied, else the longest prefix in the map is replaced, else a character is copied; then, if the model says so, spaces at the ends and after spaces go."""
        out, lo, hi, at, thin = bytearray(), [], [], 0, self.spec.remove_extra_whitespaces
        after_space = thin
        while at < len(raw):
            symbol = next((s for s in self.symbols.get(raw[at], ()) if raw.startswith(s, at)), None)
            got = None if symbol else self.map.longest(raw, at)
            if got is None:
                lead = raw[at]
                taken = len(symbol) if symbol else 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new, a, b = raw[at : at + taken], range(at, at + taken), range(at + 1, at + taken + 1)
            else:
                taken, new = got
                a, b = [at] * len(new), [at + taken] * len(new)
            skip = len(new) - len(new.lstrip(b" ")) if after_space else 0
            out += new[skip:]
            lo += a[skip:]
            hi += b[skip:]
            after_space = thin and out.endswith(b" ") if len(new) > skip else after_space
            at += taken
        keep = len(out.rstrip(b" ")) if thin else len(out)
        return bytes(out[:keep]), np.array(lo[:keep], np.int64), np.array(hi[:keep], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[tuple[np.ndarray, np.ndarray]]]:
        """Ids with the end id, and byte spans (starts, ends) of the ids before it."""
        normal = [None if self.plain and not self.spec.add_dummy_prefix else self.normalized(t) for t in texts]
        ids = self.encoder.encode([t if n is None else n[0] for t, n in zip(texts, normal, strict=True)], out_type=int, num_threads=1)
        spans = [self.spans(t, n, i) for t, n, i in zip(texts, normal, ids, strict=True)]
        return [[*i, self.end] for i in ids], spans

    def spans(self, text: str, normal, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        seen = text if normal is None else normal[0]
        raw = np.frombuffer(seen.encode(), np.uint8)
        width = np.where(raw == 32, len(SPACE), 1)  # bytes of the text that the library sees
        ends = self.lengths[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if self.unknown in ids or int(ends.sum()) != int(width.sum()):
            ends = self._slow(seen, ids)
        ends = np.cumsum(ends)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        source = np.repeat(np.arange(len(raw)), width)
        a = source[starts] if len(starts) else starts
        b = source[ends - 1] + 1 if len(ends) else ends
        if normal is None:
            return a, b
        lo, hi = normal[1], normal[2]
        return (lo[a], hi[b - 1]) if len(a) else (a, b)

    def _slow(self, seen: str, ids: list[int]) -> np.ndarray:
        """Widths of the pieces where unknown characters stand for runs of any length."""
        out, at = [], 0
        escaped = seen.encode().replace(b" ", SPACE)
        for k, i in enumerate(ids):
            if i != self.unknown:
                out.append(int(self.lengths[i]))
            else:
                after = next((self.encoder.id_to_piece(j).encode() for j in ids[k + 1 : k + 2]), None)
                end = len(escaped) if after is None else escaped.find(after, at + 1)
                out.append((len(escaped) if end < 0 else end) - at)
            at += out[-1]
        return np.array(out, np.int64)


def pieces(path: str) -> Pieces:
    loaded = kept_by("pieces")
    if path not in loaded:
        loaded[path] = Pieces(path)
    return loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id), starts and ends (byte spans in the original UTF-8 text of
    all ids but the end id). A null text is an empty one: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        for batch in batches:
            for doc_ids, text in in_slices(batch, 1_000_000):
                ids, spans = sp.encode([t or "" for t in text])
                cols = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([s for s, _ in spans], pa.list_(pa.int32())), pa.array([e for _, e in spans], pa.list_(pa.int32()))]
                yield pa.record_batch(cols, names=["doc_id", "ids", "starts", "ends"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(ids: Column, model: str) -> Column:
    """The text of a column of ids, by the library's decode(); a null gives null."""
    def run(column: pd.Series) -> pd.Series:
        sp = pieces(model).decoder
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in column], dtype=object)

    return F.pandas_udf(run, "string")(ids)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_crc32 (of the byte at which each id's
    span ends, as little-endian 32-bit): encode and decode in one pass, for tables whose ids needn't be kept."""
    import hashlib
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        names = sp.texts_of_ids.__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, 2_000_000):
                ids, cuts, ends = sp.encode_array(part.column(1))
                lists = [ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                back = sp.decoder.decode(lists, num_threads=1)
                ends = ends.astype("<i4")
                crc = [zlib.crc32(ends[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                cols = [part.column(0), np.diff(cuts), [sha(" ".join(map(names, x))) for x in lists], [sha(x) for x in back], crc]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
