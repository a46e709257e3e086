"""SentencePiece BPE by backtracking over longest matches: exact ids, and the texts they stand for.

A sequence of pieces is what merging by score gives if and only if every two neighbours, merged
again from their characters, come back as these two. The search takes the longest piece at each
place (Aho-Corasick), goes to shorter pieces of which it is a prefix when neighbours do not fit,
steps back when none does, and marks places from which no way led on in a bit field.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import Memo, batches_by_size, small_batches, text_of

#: SentencePiece's sign for a space.
SPACE = "▁"
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Piece types in a model file.
NORMAL, BYTE = 1, 6
#: Pairs of pieces whose fit a worker remembers.
FITS_HELD = 100_000


class PieceCodec:
    """Pieces of a BPE model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str, limit: int = 32 << 20):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or BYTE not in kinds or 4 in kinds:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in x.lstrip(SPACE) for x in self.scores):
            raise ValueError("a piece goes on after the end of a word")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Pieces that merging can give; others never appear in an encoding.
        self.ids = {x: i for x, (_, i) in self.scores.items() if len(x) == 1 or self._merged(x) == [x]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.most = max(map(len, self.ids))
        self.shorter = {x: next((x[:k] for k in range(len(x) - 1, 0, -1) if x[:k] in self.ids), None) for x in self.ids}
        self.other = re.compile("([^" + "".join(re.escape(x) for x in self.ids if len(x) == 1) + "])")
        #: Whether two pieces fit as neighbours; pieces are bounded in length, so entries are too.
        self.fits: dict[tuple[str, str], bool] = {}
        self.chunks = Memo(lambda new: list(map(self._digest_part, new)), limit, 150)

    def _merged(self, text: str) -> list[str]:
        """Characters merged by score: the best pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: str, right: str) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= FITS_HELD:
                self.fits.clear()
            found = self.fits[left, right] = self._merged(left + right) == [left, right]
        return found

    def _search(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        longest = [x for _, x in self.automaton.iter_long(text)]
        if all(map(self._fit, longest, longest[1:])):
            return longest
        # A bit for each place, set while a way on from it may exist.
        open_at = bytearray(b"\xff" * (len(text) // 8 + 1))
        out: list[str] = []
        at, piece = 0, longest[0]
        while piece is not None:
            end = at + len(piece)
            if open_at[end >> 3] >> (end & 7) & 1 and (not out or self._fit(out[-1], piece)):
                out.append(piece)
                at = end
                piece = next(self.automaton.iter_long(text[at : at + self.most]))[1] if at < len(text) else None
            elif self.shorter[piece]:
                piece = self.shorter[piece]
            else:
                open_at[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                piece = out.pop()
                at -= len(piece)
        return out

    def _encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.other.split(chunk)):
            if k % 2:
                ids += [self.bytes[b] for b in part.encode()]
            elif part:
                ids += map(self.ids.__getitem__, self._search(part))
        return ids

    def split(self, text: str) -> list[str]:
        """Chunks no piece of which reaches into the next: spaces and the word after them."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text or text[-1] == SPACE:
            return _CHUNKS.findall(text)
        return [SPACE + x for x in text[1:].split(SPACE)]

    def encode(self, text: str) -> list[int]:
        """The ids that the library gives, without begin or end."""
        return [i for x in self.split(text) for i in self._encode_chunk(x)]

    def decode(self, ids: list[int]) -> str:
        """The text that the library's decode gives."""
        return self._surface(ids)[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else self._surface(ids)

    def _surface(self, ids: list[int]) -> str:
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        return out.decode(errors="replace").replace(SPACE, " ")

    def _digest_part(self, chunk: str) -> str | tuple[str, str]:
        """A chunk's ids, comma-joined, and the text they stand for, if that is not the chunk itself."""
        ids = self._encode_chunk(chunk)
        text, surface = ",".join(map(str, ids)), self._surface(ids)
        return text if surface == chunk.replace(SPACE, " ") else (text, surface)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the ids and of the text decoded from them."""
        lists = [self.split(x) for x in texts]
        distinct, out = list(set().union(*lists)), []
        known = dict(zip(distinct, self.chunks.values(distinct), strict=True))
        odd = {x for x, y in known.items() if type(y) is tuple}
        for chunks in lists:
            if odd.isdisjoint(chunks):
                ids, text = ",".join([known[x] for x in chunks]), "".join(chunks).replace(SPACE, " ")[1:]
            else:
                parts = [known[x] if x in odd else (known[x], x.replace(SPACE, " ")) for x in chunks]
                ids, text = ",".join([x[0] for x in parts]), "".join([x[1] for x in parts])[1:]
            out.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


_loaded: dict[tuple[str, int], PieceCodec] = {}

#: Bytes of a worker's memo of chunks (in each of two generations), rows and bytes of texts of a batch.
MEMO, ROWS, BATCH = 96 << 20, 1024, 2 << 20


def piece_codec(path: str, memo: int = MEMO) -> PieceCodec:
    """One codec for each worker process and size of memo, kept between tasks."""
    if (path, memo) not in _loaded:
        _loaded[path, memo] = PieceCodec(path, memo)
    return _loaded[path, memo]


def piece_ids(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with ``piece_ids`` (array of int) and ``piece_text`` (decoded from the ids) added.

    A null text counts as empty and gives no ids; every row stays; columns of these two names are
    replaced.
    """
    kept = [c for c in docs.columns if c not in ("piece_ids", "piece_text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        for batch in small_batches(batches):
            ids = [codec.encode(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], [*kept, "piece_ids", "piece_text"])

    return docs.select(*kept).mapInArrow(run, f"{fields}, piece_ids array<int>, piece_text string")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256. memo and rows bound a worker's
    memory (bytes of its memo, rows of a batch); results don't depend on them.

    Every whole text is encoded, then decoded from its ids. Null texts count as empty (no ids);
    null and repeated ids keep their rows; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model, memo)
        for batch in batches_by_size(small_batches(batches, rows), 1, BATCH):
            n, ids, decoded = zip(*codec.digests(batch.column(1).to_pylist()), strict=True)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
