"""Encoding to and decoding from sentence pieces by weighted finite-state transducers.

A model compiles to three machines over characters and pieces; weights are tropical (they add along a path, the least
wins):

- the normaliser has a state before the first character, one inside the text and, if the model drops extra white space,
  one behind a space that is still to be written. It writes the piece mark for spaces and one before the text;
- the pieces' machine has a state per prefix of a piece. An arc reads a character; a state at the end of a piece writes
  that piece and returns to the start. Characters that are no piece get a fallback arc, which writes their bytes;
- the neighbours' machine reads pieces. Unigram models have one state and a piece weighs minus its score, a fallback
  character more than any piece. Pair-merge models have a state per last piece: piece b after piece a weighs one if merging
  the text of a and b gives a, b back (see prefix_dp), and infinity otherwise.

An input is composed with the three in turn, on demand: the normaliser's output with the pieces' machine gives the arcs
that leave a position, and the shortest path over (position, state of the neighbours' machine) is the encoding. For
pair-merge models one path of finite weight is left, which is the merge result.

No piece holds a mark behind another character, so the composition falls apart before every run of spaces, and the
normaliser is inside the text there; the shortest path of each part is kept per distinct part.

Models with a compiled character map, or that treat white space as a suffix, are refused. Null and empty texts give no
pieces; very long texts are encoded whole, part by part; repeated rows get equal pieces; an empty table gives no rows;
columns other than doc_id and text are ignored. A literal mark in a text reads back as a space, so
decode(encode(text)) differs from such a text.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taleweave.llm.prefix_dp import PrefixSegmenter

MARK = "▁"
PART = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
BEGIN, INSIDE, GAP = 0, 1, 2
#: What a fallback character weighs over the dearest piece.
PENALTY = 10.0


class Normaliser:
    """arcs[state][character] = (output, next state); OTHER stands for every character without an arc, written behind the
    output."""

    OTHER = ""

    def __init__(self, dummy_prefix: bool, squeeze: bool) -> None:
        before = MARK if dummy_prefix else ""
        if squeeze:
            self.arcs = [{" ": ("", BEGIN), self.OTHER: (before, INSIDE)}, {" ": ("", GAP), self.OTHER: ("", INSIDE)}, {" ": ("", GAP), self.OTHER: (MARK, INSIDE)}]
        else:
            self.arcs = [{" ": (before + MARK, INSIDE), self.OTHER: (before, INSIDE)}, {" ": (MARK, INSIDE), self.OTHER: ("", INSIDE)}]

    def run(self, part: str, state: int) -> str:
        out, at = [], 0
        while at < len(part):
            if state == INSIDE:  # its arcs copy everything up to a space
                end = part.find(" ", at)
                end = len(part) if end < 0 else end
                out.append(part[at:end])
                if (at := end) == len(part):
                    break
            c = part[at]
            text, state = self.arcs[state].get(c) or self.arcs[state][self.OTHER]
            out.append(text if c == " " else text + c)
            at += 1
        return "".join(out)


class Pieces:
    """arcs[state][character] = next state, state 0 at the start; ends[state] = (piece, weight, length) where a piece ends."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, float, int] | None] = [None]
        self.fallback = max(weights.values(), default=0.0) + PENALTY
        for piece, weight in weights.items():
            state = 0
            for c in piece:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][c]
            self.ends[state] = (piece, weight, len(piece))

    def leaving(self, text: str, at: int) -> list[tuple[str, float, int]]:
        """The arcs of the composition with text that leave position at, shortest first."""
        arcs, ends, size = self.arcs, self.ends, len(text)
        state, out = arcs[0].get(text[at]), []
        if state is None or ends[state] is None:
            out.append((text[at], self.fallback, 1))
        while state is not None:
            if arc := ends[state]:
                out.append(arc)
            at += 1
            state = arcs[state].get(text[at]) if at < size else None
        return out


class Transducer:
    """pieces: (text, score, type) by id, types numbered as in a model file."""

    MOST_PARTS, LONG = 600_000, 48

    def __init__(self, pieces: list[tuple[str, float, int]], pairs: bool, dummy_prefix: bool = True, squeeze: bool = False) -> None:
        self.pairs, self.dummy_prefix = pairs, dummy_prefix
        scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        if bad := [p for p in scores if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces hold a mark behind another character: {bad[:3]}")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for p, _, kind in pieces]
        self.normaliser = Normaliser(dummy_prefix, squeeze)
        self.machine = Pieces({p: 1.0 if pairs else -s for p, s in scores.items()})
        rank = lambda a, b: -s if (s := scores.get(a + b)) is not None else None
        self.merges = PrefixSegmenter(set(scores), rank)
        self.parts: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        if n.precompiled_charsmap or not n.escape_whitespaces or t.treat_whitespace_as_suffix or t.model_type not in (1, 2):
            raise ValueError("the model's normaliser or type is not compiled here")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], t.model_type == 2, n.add_dummy_prefix, n.remove_extra_whitespaces)

    def shortest(self, text: str) -> tuple[float, list[str]]:
        """Weight and pieces of the shortest path of a normalised text. Unigram models have one state a position: the least
        weight so far, ties to the longer last piece. In pair-merge models the only finite path is the shortest, so arcs are
        followed depth first, longest first, and (position, last piece) states that lead nowhere are not entered twice."""
        return self._only(text) if self.pairs else self._least(text)

    def _least(self, text: str) -> tuple[float, list[str]]:
        weights, lasts = [0.0] + [float("inf")] * len(text), [""] * (len(text) + 1)
        for start in range(len(text)):
            for piece, weight, length in self.machine.leaving(text, start):
                if weights[start] + weight < weights[start + length]:
                    weights[start + length], lasts[start + length] = weights[start] + weight, piece
        out, at = [], len(text)
        while at:
            out.append(lasts[at])
            at -= len(lasts[at])
        return weights[-1], out[::-1]

    def _only(self, text: str) -> tuple[float, list[str]]:
        known, leaving, size = self.merges.fits.get, self.machine.leaving, len(text)
        path: list[tuple[str, float, int]] = []
        waiting: list[list[tuple[str, float, int]]] = []
        dead: set[tuple[int, str]] = set()
        at, last, arcs = 0, "", leaving(text, 0) if text else []
        while at < size:
            while arcs:
                arc = arcs.pop()
                piece = arc[0]
                allowed = known((last, piece)) if last else self.merges.stands(piece)
                if allowed is None:
                    allowed = self.merges.stand_together(last, piece)
                if allowed and not (dead and (at + arc[2], piece) in dead):
                    path.append(arc)
                    waiting.append(arcs)
                    at, last = at + arc[2], piece
                    arcs = leaving(text, at) if at < size else []
                    break
            else:  # only arcs of infinite weight are left: one step back
                if not path:
                    raise ValueError(f"no finite path for {text!r}: the scores do not fit the pieces")
                dead.add((at, last))
                at -= path.pop()[2]
                arcs, last = waiting.pop(), path[-1][0] if path else ""
        return sum([a[1] for a in path]), [a[0] for a in path]

    def _part(self, part: str, state: int) -> bytes:
        path = self.shortest(self.normaliser.run(part, state))[1]
        ids = list(map(self.ids.get, path))
        if None in ids:
            ids = []
            for piece in path:
                known = self.ids.get(piece)
                if known is not None:
                    ids.append(known)
                elif self.bytes:
                    ids += [self.bytes[b] for b in piece.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        out = struct.pack(f"<{len(ids)}I", *ids)
        kept = self.first if state == BEGIN else self.parts
        if len(kept) >= self.MOST_PARTS:
            kept.clear()
        if len(part) <= self.LONG:
            kept[part] = out
        return out

    def encode(self, text: str) -> bytes:
        """ids as little-endian uint32."""
        parts = PART.findall(text)
        if not parts:
            return b""
        known, make = self.parts, self._part
        out = [known.get(p) or make(p, INSIDE) for p in parts[1:]]
        out.insert(0, self.first.get(parts[0]) or make(parts[0], BEGIN))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out


@functools.lru_cache(maxsize=1)
def kept_machine(path: str) -> Transducer:
    """One machine per Python worker, so that its parts serve all tasks that the worker runs."""
    return Transducer.load(path)


def encode_documents(documents: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids (unless keep_ids is false), ids_crc32, round_trip (whether the ids decode to the text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept_machine(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = [machine.encode(t) for t in texts]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            good = [machine.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(good)]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
            if keep_ids:
                starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return documents.select("doc_id", "text").mapInArrow(encode, kind)
