"""SentencePiece BPE encoding and decoding with byte spans, on plain tables.

The model file is parsed once on the driver; tasks get its tables.  A text is
normalised by longest-prefix matches through the model's compiled character
map, each normalised byte remembering the original byte it came from.  Byte
pair merges then run over the normalised text, best score first and leftmost
among equals, and every piece is projected back to the original byte span.
Merges cannot cross from another character into a space mark when no piece
does, so a text falls into short units whose pieces are remembered.  The short
units that are new in a run of rows are merged together, a step in all of them
at once; the ids of a run are projected together, by the bytes that each stands
for, and become digests and decoded text by taking from Arrow arrays.

Defined cases: null and empty text give no ids and decode to empty text;
characters without a piece fall back to their bytes (or to the unknown id when
the model has none); literal control pieces in a text are ordinary text;
repeated rows are encoded each; other columns are kept.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import heapq
import re
import struct
from array import array
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Rows that a task encodes at a time, fewer if they have this many characters.
ROWS = 500
CHARACTERS = 1 << 18
#: Symbols up to which a unit is merged with others, or alone by rescanning; below 62.
SHORT = 48
#: Units that are merged together.
TOGETHER = 2_048
NEVER = float("-inf")
#: Symbols in the units of a generation that a task remembers; it keeps two generations.
MEMORY = 1_500_000
#: Symbols of the longest unit that is remembered.
LONG = 1_000
#: Allocations between runs of the garbage collector in a task.
COLLECT = 100_000
COLUMNS = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string", "n_tokens": "bigint",
           "ids_sha256": "string", "spans_sha256": "string", "decoded_sha256": "string"}


def load_model(path: str) -> dict:
    """The tables of a BPE model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type != proto.TrainerSpec.BPE:
        raise ValueError("a BPE model is needed")
    if any(p.type == UNUSED for p in m.pieces):
        raise ValueError("models with unused pieces are not supported")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "types": [p.type for p in m.pieces],
            "charsmap": m.normalizer_spec.precompiled_charsmap, "dummy": m.normalizer_spec.add_dummy_prefix,
            "squeeze": m.normalizer_spec.remove_extra_whitespaces, "escape": m.normalizer_spec.escape_whitespaces,
            "suffix": m.trainer_spec.treat_whitespace_as_suffix, "unk_surface": m.trainer_spec.unk_surface}


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a trie of 32-bit
    units (two-array layout) followed by NUL-terminated replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.text = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) at a position."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found

    def replacement(self, place: int) -> bytes:
        return self.text[place:self.text.index(b"\0", place)]


def _first_char(data: bytes, at: int) -> int:
    """Length of the well-formed UTF-8 character at a position, or 0."""
    for n in range(1, 5):
        try:
            data[at:at + n].decode()
            return n if at + n <= len(data) else 0
        except UnicodeDecodeError:
            continue
    return 0


class Remembered(dict):
    """What ``work`` makes of a key.  A full generation becomes the older one,
    from which keys seen again return, so rare keys go and frequent ones stay.
    A generation is bounded by its keys' symbols, as texts without spaces make
    long keys."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older, self.held = work, {}, 0

    def __missing__(self, key):
        if (got := self.older.pop(key, None)) is None:
            got = self.work(key)
        self.keep(key, got)
        return got

    def keep(self, key, got) -> None:
        if len(key) <= LONG:
            self.make_room()
            self.held += len(key)
            self[key] = got

    def make_room(self) -> None:
        if self.held >= MEMORY:
            self.older, self.held = dict(self), 0
            self.clear()

    def learn(self, keys: list, work) -> None:
        """Remembers those of the keys that it does not hold; ``work`` makes
        the values of some keys of similar length."""
        new = [k for k in keys if k not in self]
        seen = [k for k in new if k in self.older]
        new = sorted(set(new).difference(seen), key=len)
        for key, got in [(k, self.older.pop(k)) for k in seen]:
            self.keep(key, got)
        for lo in range(0, len(new), TOGETHER):
            some = new[lo:lo + TOGETHER]
            self.make_room()
            self.held += sum(map(len, some))
            self.update(zip(some, work(some)))


class Pairs:
    """What two neighbouring symbols merge into, as arrays.  Symbols are the
    pieces and their characters, and one more that stands for none.  A pair's
    slot is the first free one after its hash."""

    def __init__(self, id_of: dict[str, int], scores: list[float]):
        longer = [p for p in id_of if len(p) > 1]
        symbols = {s: k for k, s in enumerate([*sorted({c for p in id_of for c in p}), *longer])}
        self.none = len(symbols)
        self.id = np.array([id_of.get(s, -1) for s in symbols] + [-1], dtype=np.int32)
        #: the symbol of a code point; characters that are no piece have none here
        self.char = np.full(0x110000, self.none, dtype=np.int32)
        for s, k in symbols.items():
            if len(s) == 1 and s in id_of:
                self.char[ord(s)] = k
        rank = dict(zip(longer, np.unique([scores[id_of[p]] for p in longer], return_inverse=True)[1].tolist()))
        pairs = [(a * (self.none + 1) + b, rank[p], symbols[p]) for p in longer for cut in range(1, len(p))
                 if (a := symbols.get(p[:cut])) is not None and (b := symbols.get(p[cut:])) is not None]
        keys, ranks, into = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        bits = (2 * len(keys) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank, self.into = np.full(1 << bits, -1, dtype=np.int32), np.full(1 << bits, self.none, dtype=np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = keys[free]
            left = left[self.key[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask
        self.rank[at], self.into[at] = ranks, into

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair's piece by score, -1 without one, and its symbol."""
        keys = a * np.int64(self.none + 1) + b
        at = self.slot(keys)
        held = self.key[at]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            held = self.key[at[other]]
            other = other[(held != keys[other]) & (held >= 0)]
        return self.rank[at], self.into[at]

    def merge(self, sym: np.ndarray) -> np.ndarray:
        """Byte pair merges in every column of ``sym``, best score first, then
        topmost; the first and the last row hold no symbol, and cells whose
        symbol went into another hold none afterwards."""
        rows, n = sym.shape
        if not n:
            return sym
        sym = sym.ravel()
        after, before = (np.repeat(np.arange(rows, dtype=np.int64) + d, n) for d in (1, -1))
        order, into = np.full(rows * n, -1, dtype=np.int32), np.full(rows * n, self.none, dtype=np.int32)

        def offer(row: np.ndarray, cell: np.ndarray, below: np.ndarray) -> None:
            rank, into[cell] = self.find(sym[cell], sym[below])
            order[cell] = np.where(rank < 0, -1, rank << 6 | 63 - row)

        cells = np.arange(n, (rows - 1) * n)
        offer(cells // n, cells, cells + n)
        while len(at := np.flatnonzero((best := order.reshape(rows, n).max(axis=0)) >= 0)):
            row = 63 - (best[at] & 63)
            cell = row * n + at
            gone = after[cell] * n + at
            below, above = after[gone], before[cell]
            sym[cell], sym[gone], order[gone] = into[cell], self.none, -1
            after[cell], before[below * n + at] = below, row
            offer(row, cell, below * n + at)
            offer(above, above * n + at, cell)
        return sym.reshape(rows, n)


class Codec:
    def __init__(self, model: dict):
        self.m = model
        self.map = CharacterMap(model["charsmap"])
        self.user = sorted((p.encode() for p, t in zip(model["pieces"], model["types"]) if t == USER), key=len, reverse=True)
        self.id_of = {p: i for i, (p, t) in enumerate(zip(model["pieces"], model["types"])) if t in (NORMAL, USER)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model["pieces"], model["types"])) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next((i for i, t in enumerate(model["types"]) if t == UNKNOWN), 0)
        # places where no piece can reach across: into a space mark, and beside a line end
        crossing = [p for p in self.id_of if SPACE in p.lstrip(SPACE)]
        self.lines = lines = any("\n" in p and len(p) > 1 for p in self.id_of)
        self.whole = bool(crossing or self.user)
        if self.whole:
            self.units = re.compile(r"(?s).+")
        else:
            end = "" if lines else r"\n"
            self.units = re.compile(rf"{SPACE}*[^{SPACE}{end}]+|{SPACE}+" + ("" if lines else r"|\n"))
        self.known, self.packed = Remembered(self.unit), Remembered(self.pack)
        self.score_of = {p: model["scores"][i] for p, i in self.id_of.items()}.get
        self.pairs = Pairs(self.id_of, model["scores"])
        self.plain = [None if t == BYTE else model["unk_surface"] if t == UNKNOWN else "" if t == CONTROL else p.replace(SPACE, " ")
                      for p, t in zip(model["pieces"], model["types"])]
        #: the normalised bytes that an id stands for; for a byte piece that begins a character, the character's
        self.size = np.array([0 if t == BYTE else len(p.encode()) for p, t in zip(model["pieces"], model["types"])], dtype=np.int64)
        self.begins = np.zeros(len(self.plain), dtype=np.int64)
        for b, i in self.byte_id.items():
            self.begins[i] = 1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        self.label = pa.array([b"%d," % i for i in range(len(self.plain))], pa.large_binary())
        self.bytes = pa.array([bytes([self.byte_of[i]]) if p is None else p.encode() for i, p in enumerate(self.plain)], pa.large_binary())

    # ------------------------------------------------------------ normalising
    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        for u in self.user:
            if data.startswith(u, at):
                return u, len(u)
        if (hit := self.map.longest(data, at)) is not None:
            return self.map.replacement(hit[1]), hit[0]
        n = _first_char(data, at)
        return (data[at:at + n], n) if n else ("�".encode(), 1)

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its bytes and its end, the
        original byte position; None for the positions when nothing changes
        but spaces (see ``origins``)."""
        m = self.m
        if not text:
            return "", None
        if not m["charsmap"] and not m["squeeze"] and not self.user and m["escape"]:
            text = text.replace(" ", SPACE)
            return (text + SPACE if m["suffix"] else SPACE + text) if m["dummy"] else text, None
        data, mark = text.encode(), SPACE.encode() if m["escape"] else b" "
        out, origin, at = bytearray(), [], 0
        if m["squeeze"]:
            while at < len(data):
                piece, n = self._prefix(data, at)
                if piece != b" ":
                    break
                at += n
            if at == len(data):
                return "", []
        if m["dummy"] and not m["suffix"]:
            out += mark
            origin += [at] * len(mark)
        was_space = m["squeeze"]
        while at < len(data):
            piece, n = self._prefix(data, at)
            while was_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                new = piece.replace(b" ", mark)
                out += new
                origin += [at] * len(new)
                was_space = piece.endswith(b" ")
            at += n
            if not m["squeeze"]:
                was_space = False
        if m["squeeze"]:
            while out.endswith(mark):
                del out[-len(mark):]
                at = origin[len(out)]
                del origin[len(out):]
        if m["dummy"] and m["suffix"]:
            out += mark
            origin += [at] * len(mark)
        return out.decode(), [*origin, at]

    def origins(self, text: str) -> np.ndarray:
        """Positions for the plain case: only spaces were rewritten."""
        width = len(SPACE.encode())
        data = np.frombuffer(text.encode(), np.uint8)
        times = np.ones(len(data) + 1, dtype=np.int64)
        times[:-1][data == 32] = width
        extra = width * bool(self.m["dummy"] and len(data))
        times[-1 if self.m["suffix"] else 0] += extra
        return np.repeat(np.arange(len(data) + 1), times)

    # --------------------------------------------------------------- merging
    def merge(self, unit: str) -> list[str]:
        """Byte pair merges of one unit: best score first, then leftmost."""
        score, id_of = self.m["scores"], self.id_of
        if not self.user and len(unit) <= SHORT:
            return self._merge_short(unit)
        part = list(unit) if not self.user else self._symbols(unit)
        fixed = [len(self.user) > 0 and p.encode() in self.user for p in part]
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and not fixed[a] and not fixed[b] and (i := id_of.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-score[i], a, b, len(part[a]) + len(part[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != size or right[a] != b:
                continue
            part[a] += part[b]
            part[b] = ""
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def _merge_short(self, unit: str) -> list[str]:
        """The same by rescanning the neighbours' scores, faster on few
        symbols; ``edge`` holds where the symbols begin, and the end."""
        n, score = len(unit), self.score_of
        edge = [*range(n + 1)]
        pair = [*map(score, map(add, unit, unit[1:]), repeat(NEVER))]
        while pair and (best := max(pair)) > NEVER:
            i = pair.index(best)
            del edge[i + 1], pair[i]
            if i:
                pair[i - 1] = score(unit[edge[i - 1]:edge[i + 1]], NEVER)
            if i < len(pair):
                pair[i] = score(unit[edge[i]:edge[i + 2]], NEVER)
        return [unit[a:b] for a, b in zip(edge, edge[1:])]

    def _symbols(self, unit: str) -> list[str]:
        out, at = [], 0
        users = [u.decode() for u in self.user]
        while at < len(unit):
            hit = next((u for u in users if unit.startswith(u, at)), unit[at])
            out.append(hit)
            at += len(hit)
        return out

    def unit(self, unit: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """A unit's ids and its pieces: tuples, which the garbage collector
        need not visit again and again."""
        parts = self.merge(unit)
        return tuple(self.ids_of(parts)), tuple(parts)

    def pack(self, unit: str) -> bytes:
        """A unit's ids as 32-bit integers, a fraction of what tuples and texts take."""
        return array("i", self.ids_of(self.merge(unit))).tobytes()

    def pack_all(self, units: list[str]) -> list[bytes]:
        """``pack`` of some short units, merged together."""
        size = np.array([*map(len, units)])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        row, column = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(units)), size)
        symbols, foreign = self.pairs.char[codes], np.zeros(len(units), dtype=bool)
        foreign[column[symbols == self.pairs.none]] = True  # with characters that are no piece
        sym = np.full((int(size.max()) + 2, len(units)), self.pairs.none, dtype=np.int32)
        sym[row, column] = np.where(foreign[column], self.pairs.none, symbols)
        sym = self.pairs.merge(sym).T
        there = sym != self.pairs.none
        ends = (4 * np.cumsum(there.sum(axis=1))).tolist()
        data = self.pairs.id[sym[there]].tobytes()
        return [self.pack(u) if f else data[a:b] for u, f, a, b in zip(units, foreign.tolist(), [0, *ends], ends)]

    def ids_of(self, parts: list[str]) -> list[int]:
        try:
            return [*map(self.id_of.__getitem__, parts)]
        except KeyError:
            ids = []
            for p in parts:
                if p in self.id_of:
                    ids.append(self.id_of[p])
                else:
                    ids += [self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unknown]
            return ids

    def spans(self, parts: tuple[str, ...]) -> list[tuple[int, int]]:
        """The byte range of every id of these pieces."""
        out, at = [], 0
        for p in parts:
            size = len(p.encode())
            if p not in self.id_of and self.byte_id:  # the last byte stands for the whole character
                out += [(at, at)] * (size - 1)
            out.append((at, at + size))
            at += size
        return out

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, and each piece's first and end byte in ``text``."""
        normal, origin = self.normalise(text)
        origin = self.origins(text).tolist() if origin is None else origin
        ids, starts, ends, at = [], [], [], 0
        for u in self.units.findall(normal):
            got = self.known[u]
            ids += got[0]
            spans = self.spans(got[1])
            starts += [origin[at + a] for a, _ in spans]
            ends += [origin[at + b] for _, b in spans]
            at += len(u.encode())
        if not self.byte_id:  # neighbouring unknown pieces are one
            keep = [i for i in range(len(ids)) if not (i and ids[i] == ids[i - 1] == self.unknown)]
            ends = [ends[(keep + [len(ids)])[k + 1] - 1] for k in range(len(keep))]
            ids, starts = [ids[i] for i in keep], [starts[i] for i in keep]
        return ids, starts, ends

    def encode_ids(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.encode_rows(texts)[0]

    def encode_rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """``encode`` of each text: all ids, all starts, all ends."""
        if not self.byte_id:
            rows = [[np.array(x, dtype=np.int32) for x in self.encode(t)] for t in texts]
            return tuple([*column] for column in zip(*rows)) if rows else ([], [], [])
        normal = [self.normalise(t) for t in texts]
        ids = self.merge_all([n for n, _ in normal])
        return ids, *self.project(ids, [self.origins(t) if origin is None else origin or [0] for t, (_, origin) in zip(texts, normal)])

    def project(self, ids: list[np.ndarray], origins: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The first and end byte of each row's ids, from the ``origins`` of its normalised bytes and their end."""
        if not ids:
            return [], []
        counts, flat = [*map(len, ids)], np.concatenate(ids)
        size, begins = self.size[flat], self.begins[flat]
        at = np.flatnonzero(begins)
        size[at + begins[at] - 1] = begins[at]  # the last byte stands for the whole character
        ends = np.cumsum(size)
        row, origin = np.repeat(np.arange(len(ids)), counts), np.concatenate(origins).astype(np.int32)  # one more in each row
        cuts = np.cumsum(counts)[:-1]
        return np.split(origin[ends - size + row], cuts), np.split(origin[ends + row], cuts)

    def merge_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each normalised text, for models with byte pieces."""
        units, counts = self.cut(texts)
        seen = units.dictionary_encode()
        distinct = seen.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.user:
            self.packed.learn([u for u in distinct if len(u) <= SHORT], self.pack_all)
        packed = pa.array([*map(self.packed.__getitem__, distinct)], pa.large_binary())
        return [np.frombuffer(row, dtype=np.int32) for row in taken(packed, seen.indices, counts)]

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of normalised texts, one after the other, and the number in each text."""
        data = [t.encode() for t in texts]
        size, data = np.cumsum([0, *map(len, data)]), np.frombuffer(b"".join(data), np.uint8)
        first = np.zeros(len(data) + 1, dtype=bool)
        if not self.whole:
            a, b, c = SPACE.encode()
            mark = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
            first[mark] = True
            first[mark[1:][np.diff(mark) == 3]] = False  # beside another mark
            if not self.lines:
                end = np.flatnonzero(data == 10)
                first[end] = first[end + 1] = True
        first[size[:-1]] = True
        starts = np.flatnonzero(first[:-1])
        where = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(data))
        return units, np.diff(np.searchsorted(starts, size))

    def close(self) -> None:
        """Lets go of the remembered units, which refer to the codec, so that
        both go with the task and need not wait for the garbage collector."""
        self.known = self.packed = None

    # -------------------------------------------------------------- decoding
    def surface(self, ids: list[int]) -> str:
        """The text of a run of ids, space marks as spaces."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # byte pieces among them
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(self._bytes(run))
            run = bytearray()
            out.append(self.plain[i])
        return "".join([*out, self._bytes(run)])

    @staticmethod
    def _bytes(run: bytearray) -> str:
        """Well-formed characters as they are, every other byte as U+FFFD."""
        out, data, at = [], bytes(run), 0
        while at < len(data):
            n = _first_char(data, at)
            out.append(data[at:at + n].decode() if n else "�")
            at += n or 1
        return "".join(out)

    def strip_dummy(self, text: str) -> str:
        """Decoded text without the space that encoding put in front (or behind)."""
        if self.m["dummy"] or self.m["squeeze"]:
            if self.m["suffix"]:
                return text[:-1] if text.endswith(" ") else text
            return text[1:] if text.startswith(" ") else text
        return text

    def decode(self, ids: list[int]) -> str:
        return self.strip_dummy(self.surface(ids))

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """``decode`` of each row's ids."""
        out = []
        for row, data in zip(ids, taken(self.bytes, np.concatenate(ids), [*map(len, ids)])):
            try:
                out.append(self.strip_dummy(str(data, "utf-8")))
            except UnicodeDecodeError:  # byte pieces that make no characters
                out.append(self.decode(row.tolist()))
        return out

    def digests(self, ids: list[np.ndarray]) -> tuple[list[int], list[str], list[str]]:
        """For each row's ids: n_tokens, SHA-256 of the ids as text and of the decoded text."""
        sha, counts = lambda s: hashlib.sha256(s).hexdigest(), [*map(len, ids)]
        return (counts, [sha(x[:-1]) for x in taken(self.label, np.concatenate(ids), counts)],
                [sha(t.encode()) for t in self.decode_all(ids)])

    @staticmethod
    def span_digests(starts: list[np.ndarray], ends: list[np.ndarray]) -> list[str]:
        """For each row: SHA-256 of its spans as text, as in "0-3,3-5"."""
        if not starts:
            return []
        dash, comma = (pa.scalar(x, pa.large_string()) for x in "-,")
        pairs = pc.binary_join_element_wise(*(pa.array(np.concatenate(x)).cast(pa.large_string()) for x in (starts, ends)), dash)
        rows = pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, starts)]), pairs)
        _, where, data = pc.binary_join(rows, comma).buffers()
        where, data = np.frombuffer(where, dtype=np.int64, count=len(rows) + 1).tolist(), memoryview(data if data is not None else b"")
        return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(where, where[1:])]


def taken(table: pa.Array, places, counts) -> list[memoryview]:
    """The binary table's values at the places, joined for each row: it has the next ``counts`` places."""
    got = table.take(places if isinstance(places, pa.Array) else pa.array(places))
    _, where, data = got.buffers()
    ends = np.cumsum([0, *counts])
    if len(got):
        ends = np.frombuffer(where, dtype=np.int64, count=len(got) + 1)[ends]
    data = memoryview(data if data is not None else b"")
    return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def runs(texts: pa.Array):
    """First and end row of runs of rows that are encoded together."""
    size = [0, *np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)).tolist()]
    lo = 0
    while lo < len(texts):
        hi = min(max(bisect.bisect_right(size, size[lo] + CHARACTERS) - 1, lo + 1), lo + ROWS, len(texts))
        yield lo, hi
        lo = hi


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", columns=("ids", "starts", "ends", "decoded")) -> DataFrame:
    """``docs`` without the text, plus any of COLUMNS."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    carried = [c for c in docs.columns if c != text_col and c not in columns]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} {COLUMNS[c]}" for c in columns])
    kinds = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    digests = bool({"n_tokens", "ids_sha256", "decoded_sha256"} & {*columns})

    def encode(batches):
        codec, before = Codec(shared.value), gc.get_threshold()
        gc.set_threshold(COLLECT, *before[1:])  # what is remembered holds no cycles
        try:
            for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in runs(b.column(text_col))):
                out, texts = {}, [t or "" for t in batch.column(text_col).to_pylist()]
                out["ids"], out["starts"], out["ends"] = codec.encode_rows(texts)
                if "decoded" in columns:
                    out["decoded"] = codec.decode_all(out["ids"])
                if "spans_sha256" in columns:
                    out["spans_sha256"] = codec.span_digests(out["starts"], out["ends"])
                if digests:
                    out["n_tokens"], out["ids_sha256"], out["decoded_sha256"] = codec.digests(out["ids"])
                yield pa.record_batch([batch.column(c) for c in carried] + [pa.array(out[c], kinds.get(c, pa.string())) for c in columns],
                                      names=[*carried, *columns])
        finally:
            codec.close()
            gc.set_threshold(*before)

    return docs.select(*carried, text_col).mapInArrow(common.tidied(encode), schema)
