"""Operator 9: SentencePiece encoding with source offsets, and decoding.

A text is normalised unit by unit: the longest prefix found in the model's compiled character map (a
double-array trie) is replaced, anything else is kept, and every normalised character remembers the
byte where its unit began. Byte-pair merges then cut the normalised text into pieces, and each piece
is projected back to a byte span of the original text.

No piece of the vocabulary contains certain neighbouring characters, so no merge ever crosses them:
texts are cut there into segments that are merged once per worker and then taken from a cache. With an
identity map, texts of Latin-1 characters are cut and looked up with array operations.

Cases: null text counts as empty, which has only the end id; characters outside the vocabulary fall
back to bytes, of which the last one spans the character; repeated rows are encoded alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waylake.llm.tokens import Pool, SegmentHash, groups_by_size, loaded, read_model

SPACE = "▁"
LONG = 200  # symbols from which a heap orders the merges
# fixed values: kinds of pieces in the model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Encoded(NamedTuple):
    ids: np.ndarray
    begin: np.ndarray  # byte spans in the original text
    end: np.ndarray


class CharMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.targets = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """(bytes matched, replacement) of the longest key that the text continues with."""
        units = self.units
        if not units:
            return None
        found = None
        # a unit holds its label in the low byte, a leaf flag in bit 8 and the offset of its children
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        stop = self.targets.index(0, found[1])
        return found[0], self.targets[found[1] : stop].decode()


class PieceBpe:
    """A byte-pair model of the sentencepiece library."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        spec = model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("only byte-pair models without user-defined pieces are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only models with white space as an escaped prefix are supported")
        self.library = SentencePieceProcessor(model_proto=content)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else []
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.identity = not spec.precompiled_charsmap and self.prefix and not self.squeeze
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.joined = np.zeros((256, 256), bool)
        for a, b in self.inside:
            a, b = a.replace(SPACE, " "), b.replace(SPACE, " ")
            if ord(a) < 256 and ord(b) < 256:
                self.joined[ord(a), ord(b)] = True
        self.hash, self.pool = SegmentHash(2), Pool()
        self.slot_of: dict[str, tuple[list[int], list[int]]] = {}
        self.end_id = self.library.eos_id()

    # normalisation with alignment

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised characters, and for each, and for the end, a byte position in the text."""
        source = text.encode("utf-8")
        out: list[str] = []
        origin: list[int] = []
        at = 0
        fresh = self.squeeze  # white space at this point is dropped
        prefixed = not self.prefix
        while at < len(source):
            hit = self.charmap.longest(source, at)
            if hit:
                width, unit = hit
            else:
                lead = source[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                unit = source[at : at + width].decode()
            for c in unit:
                if c == " " and fresh:
                    continue
                if not prefixed:
                    out.append(SPACE)
                    origin.append(at)
                    prefixed = True
                out.append(SPACE if c == " " else c)
                origin.append(at)
                fresh = self.squeeze and c == " "
            at += width
        stop = len(source)
        while self.squeeze and out and out[-1] == SPACE:
            out.pop()
            stop = origin.pop()
        return "".join(out), [*origin, stop]

    # merging

    def merge(self, segment: str) -> list[str]:
        if len(segment) > LONG:
            return self._merge_long(segment)
        score, none = self.score, float("-inf")
        parts = list(segment)
        pairs = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)  # leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, segment: str) -> list[str]:
        score = self.score
        part: list[str] = list(segment)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int, j: int) -> None:
            s = score.get(part[i] + part[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, j, part[i] + part[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not part[i] or not part[j] or after[i] != j or part[i] + part[j] != whole:
                continue  # one side was merged meanwhile
            part[i], part[j] = whole, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in part if p]

    def segment(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a segment, and the characters that each covers."""
        ids: list[int] = []
        spans: list[int] = []
        for p in self.merge(text):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
                spans.append(len(p))
            elif self.bytes:
                raw = p.encode()
                ids += [self.bytes[b] for b in raw]
                spans += [0] * (len(raw) - 1) + [len(p)]
            else:
                ids.append(self.unknown)
                spans.append(len(p))
        return ids, spans

    # encoding

    def encode(self, texts: Sequence[str | None]) -> list[Encoded]:
        """Ids and byte spans of each text, without the end id."""
        out: list[Encoded | None] = [None] * len(texts)
        plain: list[int] = []
        coded: list[bytes] = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = Encoded(*(np.zeros(0, np.int32),) * 3)
                continue
            try:
                b = t.encode("latin-1") if self.identity else None
            except UnicodeEncodeError:
                b = None
            if b is None:
                out[i] = self._general(t)
            else:
                plain.append(i)
                coded.append(b)
        for s, e in groups_by_size([len(b) for b in coded]):
            for i, x in zip(plain[s:e], self._latin(coded[s:e])):
                out[i] = x
        return out  # type: ignore[return-value]

    def _general(self, text: str) -> Encoded:
        norm, origin = self.normalise(text)
        ids: list[int] = []
        widths: list[int] = []
        start = 0
        if len(self.slot_of) > self.pool.limit:
            self.slot_of.clear()
        for i in range(1, len(norm) + 1):
            if i == len(norm) or norm[i - 1] + norm[i] not in self.inside:
                part = norm[start:i]
                found = self.slot_of.get(part)
                if found is None:
                    found = self.slot_of[part] = self.segment(part)
                ids += found[0]
                widths += found[1]
                start = i
        ends = np.cumsum(np.array(widths, np.int64))
        at = np.array(origin, np.int64)
        return Encoded(np.array(ids, np.int32), at[ends - np.array(widths, np.int64)], at[ends])

    def _latin(self, texts: list[bytes]) -> list[Encoded]:
        raw = b" " + b" ".join(texts)  # the space is each text's prefix
        buf = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = ~self.joined[buf[:-1], buf[1:]]
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        codes, keys = pd.factorize(self.hash(buf, starts, ends))
        pool, known = self.pool, keys.tolist()
        if len(pool.slot) > pool.limit:
            pool.clear()
        new = [j for j, k in enumerate(known) if k not in pool.slot]
        if new:
            first = np.empty(len(known), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            parts = [self.segment(raw[s:e].decode("latin-1").replace(" ", SPACE)) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            pool.add([known[j] for j in new], [p[0] for p in parts], [p[1] for p in parts])
        get = pool.slot.get
        slots = np.fromiter((get(k) for k in known), np.int64, len(known))[codes]
        ids, widths = pool.gather(slots, pool.ids), pool.gather(slots, pool.extra)
        char_end = np.cumsum(widths, dtype=np.int64)
        bytes_to = np.r_[0, np.cumsum(1 + (buf >= 0x80))]
        begin, end = bytes_to[char_end - widths], bytes_to[char_end]
        tokens = np.r_[0, np.cumsum(pool.len[slots])][np.searchsorted(starts, bounds)]
        out = []
        for a, b, at in zip(tokens[:-1].tolist(), tokens[1:].tolist(), bounds[:-1].tolist()):
            base = bytes_to[at] + 1  # the prefix has no bytes of its own
            out.append(Encoded(ids[a:b], np.maximum(begin[a:b] - base, 0), np.maximum(end[a:b] - base, 0)))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begin, end): ids with the end id, and the byte span of every id (the end id's is empty)."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PieceBpe, model.value)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                texts = b.column(1).to_pylist()
                found = bpe.encode(texts)
                stops = [len((t or "").encode()) for t in texts]
                ids = [np.append(x.ids, np.int32(bpe.end_id)) for x in found]
                begin = [np.append(x.begin, s).astype(np.int32) for x, s in zip(found, stops)]
                end = [np.append(x.end, s).astype(np.int32) for x, s in zip(found, stops)]
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (ids, begin, end)]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "ids", "begin", "end"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, begin array<int>, end array<int>")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes) of every document, encoded and decoded again."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PieceBpe, model.value)
        names = [str(i) for i in range(bpe.library.vocab_size())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                rows: list[tuple] = []
                for doc_id, x in zip(b.column(0).to_pylist(), bpe.encode(b.column(1).to_pylist())):
                    ids = [*x.ids.tolist(), bpe.end_id]
                    rows.append((doc_id, len(ids), sha(" ".join([names[i] for i in ids])), sha(bpe.decode(ids)), int((x.end - x.begin).sum())))
                c = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
