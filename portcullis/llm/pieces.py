"""A SentencePiece BPE model read from its file: normaliser with alignment, spans, decoder.

Helpers that tasks call on some texts at a time; the Spark jobs are in ``sentencepiece_codec`` and
``token_shards``. Nothing is trained here.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
# Fixed values of the public model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Segmented units a task may keep, and characters of texts segmented together.
CACHE_UNITS, PORTION = 1 << 18, 1 << 20
#: Normaliser settings appended to a model file, which then takes texts as they are: a later value
#: overrides in protocol buffers (field 3; an empty map, and no prefix, trimming or escaping).
AS_IS = bytes([3 << 3 | 2, 8, 2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])


def portions(texts: list[str]):
    """The texts in runs of about ``PORTION`` characters, so that their units fit in memory."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > PORTION:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _fields(data: bytes):
    """(field number, value) of a protocol-buffers message: int, or bytes for lengths and floats."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def charsmap_entries(blob: bytes) -> dict[bytes, bytes]:
    """Source prefix -> replacement of a compiled character map (double-array trie + strings)."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
    strings = blob[4 + size :]
    found: dict[bytes, bytes] = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    todo = [(offset(units[0]), b"")]
    while todo:
        node, prefix = todo.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            child = at ^ offset(units[at])
            if units[at] >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                found[prefix + bytes([byte])] = strings[start : strings.index(b"\0", start)]
            todo.append((child, prefix + bytes([byte])))
    return found


@dataclass
class PieceModel:
    """A model's pieces and rules. The library merges pieces of texts that are normalised here."""

    pieces: list[str] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    charsmap: dict[bytes, bytes] = field(default_factory=dict)
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    byte_fallback: bool = False
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    unk_surface: str = " ⁇ "

    @classmethod
    def from_bytes(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(value))
                model.pieces.append(piece[1].decode())
                model.scores.append(struct.unpack("<f", piece[2])[0])
                model.types.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
                if spec.get(24):
                    raise ValueError("white space as a suffix isn't supported")
                model.byte_fallback = bool(spec.get(35, 0))
                model.unk_id, model.bos_id, model.eos_id = (spec.get(k, d) for k, d in ((40, 0), (41, 1), (42, 2)))
                model.unk_surface = spec.get(44, model.unk_surface.encode()).decode()
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = charsmap_entries(spec.get(2, b""))
                model.add_dummy_prefix = bool(spec.get(3, 1))
                model.remove_extra_whitespaces = bool(spec.get(4, 1))
                model.escape_whitespaces = bool(spec.get(5, 1))
        if USER_DEFINED in model.types:
            raise ValueError("user-defined pieces aren't supported")
        return model._compiled(data)

    def _compiled(self, data: bytes) -> PieceModel:
        self.merges = SentencePieceProcessor(model_proto=data + AS_IS)
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i, t in enumerate(self.types) if t == BYTE}
        # Units start before a run of spaces and at what no longer piece has in it.
        joined = set("".join(p for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL and len(p) > 1)) - {SPACE}
        inside = any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL)
        self.joined, self.whole = joined, inside or not self.byte_fallback
        classed = "".join(map(re.escape, sorted(joined)))
        self.unit = re.compile(".+" if self.whole or not joined else f"{SPACE}*[{classed}]+|{SPACE}+|[^{classed}{SPACE}]", re.S).findall
        self.cache: dict[str, bytes] = {}
        self.own_unit = None
        self.starts = {k.decode(errors="ignore")[:1] for k in self.charsmap}
        self.longest = max(map(len, self.charsmap), default=0)
        self.surface = [
            b"" if t in (CONTROL, BYTE) else self.unk_surface.encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, t in zip(self.pieces, self.types, strict=True)
        ]
        self.norm_bytes = np.array(
            [1 if t == BYTE else 0 if t == CONTROL else len(p.encode()) for p, t in zip(self.pieces, self.types, strict=True)],
            np.int64,
        )
        self.is_byte = np.array([t == BYTE for t in self.types])
        return self

    # Normalisation -----------------------------------------------------------------------------

    def _prefixes(self, text: str):
        """(replacement, source bytes consumed) of each longest prefix that the map has, or character."""
        data, at = text.encode(), 0
        while at < len(data):
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            into, used = data[at : at + width], width
            if data[at : at + width].decode() in self.starts:
                for size in range(min(self.longest, len(data) - at), 0, -1):
                    if (hit := self.charsmap.get(data[at : at + size])) is not None:
                        into, used = hit, size
                        break
            yield into, used
            at += used

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte it comes from."""
        if not text:
            return "", np.zeros(1, np.int64)
        space = SPACE if self.escape_whitespaces else " "
        if not self.charsmap and not self.remove_extra_whitespaces:
            source = np.frombuffer(text.encode(), np.uint8)
            prefix = len(space.encode()) if self.add_dummy_prefix else 0
            widths = np.where(source == 32, len(space.encode()), 1) if self.escape_whitespaces else np.ones(len(source), np.int64)
            aligned = np.concatenate([np.zeros(prefix, np.int64), np.repeat(np.arange(len(source)), widths), [len(source)]])
            return (space if self.add_dummy_prefix else "") + (text.replace(" ", space) if self.escape_whitespaces else text), aligned
        out, aligned, at, before = bytearray(), [], 0, self.remove_extra_whitespaces
        wide = space.encode()
        lead = 0
        steps = list(self._prefixes(text))
        if self.remove_extra_whitespaces:
            while lead < len(steps) and steps[lead][0] == b" ":
                at += steps[lead][1]
                lead += 1
            if lead == len(steps):
                return "", np.array([at])
        if self.add_dummy_prefix:
            out += wide
            aligned += [at] * len(wide)
        for into, used in steps[lead:]:
            if self.remove_extra_whitespaces and before:
                into = into.lstrip(b" ")
            if into:
                for byte in into:
                    put = wide if byte == 32 else bytes([byte])
                    out += put
                    aligned += [at] * len(put)
                before = into.endswith(b" ")
            at += used
            if not self.remove_extra_whitespaces:
                before = False
        if self.remove_extra_whitespaces:
            while out.endswith(wide):
                at = aligned[len(out) - len(wide)]
                del out[-len(wide) :], aligned[-len(wide) :]
        return out.decode(), np.array([*aligned, at])

    def plain(self, text: str) -> str:
        """The normalised text alone."""
        if self.charsmap or self.remove_extra_whitespaces or not text:
            return self.normalize(text)[0]
        space = SPACE if self.escape_whitespaces else " "
        return (space if self.add_dummy_prefix else "") + text.replace(" ", space)

    # Segmentation and spans --------------------------------------------------------------------

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of texts, without begin and end.

        A model that normalises nothing but spaces takes them as they are: a text of Latin letters has a byte
        for each in memory, but two or more once its spaces are the model's.
        """
        if self.charsmap or self.remove_extra_whitespaces or self.whole or not (self.escape_whitespaces and self.add_dummy_prefix):
            return self.segment([self.plain(t) for t in texts])
        if self.own_unit is None:
            classed = "".join(map(re.escape, sorted(self.joined)))
            self.own_unit = re.compile(f" *[{classed}]+| +|[^{classed} ]" if classed else ".+", re.S).findall
        return self.segment(["" if not t else f" {t}" if SPACE not in t else f" {t}".replace(SPACE, " ") for t in texts], self.own_unit)

    def segment(self, normalized: list[str], unit_of=None) -> list[np.ndarray]:
        """Token ids of normalised texts, without begin and end (with ``unit_of``: whose spaces are spaces).

        No piece goes on over the start of a unit, so units are segmented alone, each once.
        """
        found, known = [], self.cache
        for some in portions(normalized):
            units = [(unit_of or self.unit)(text) for text in some]
            new = [u for u in set().union(*units) if u not in known]
            if len(known) + len(new) > CACHE_UNITS:
                known.clear()
                new = list(set().union(*units))
            own = [u.replace(" ", SPACE) for u in new] if unit_of else new
            for unit, ids in zip(new, self.merges.encode(own), strict=True):
                known[unit] = struct.pack(f"<{len(ids)}I", *ids)
            found += [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in units]
        return found

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the token ids, and the (begin, end) source bytes of each.

        A piece that comes from nothing (the dummy prefix alone) has an empty span. The bytes of a
        character that falls back to byte pieces have a byte each.
        """
        normal = [self.normalize(text) for text in texts]
        ids = self.segment([text for text, _ in normal])
        return [(i, self._spans(i, *pair)) for i, pair in zip(ids, normal, strict=True)]

    def _spans(self, ids: np.ndarray, normalized: str, aligned: np.ndarray) -> np.ndarray:
        if self.byte_fallback or not len(ids):
            ends = np.cumsum(self.norm_bytes[ids])
        else:  # an unknown piece stands for one character
            widths, at = self.norm_bytes[ids].copy(), 0
            data = normalized.encode()
            for i, token in enumerate(ids.tolist()):
                if token == self.unk_id:
                    first = data[at]
                    widths[i] = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                at += widths[i]
            ends = np.cumsum(widths)
        begins = np.concatenate([np.zeros(min(1, len(ids)), np.int64), ends[:-1]])
        return np.stack([aligned[begins], aligned[ends]], 1).astype("<u4") if len(ids) else np.zeros((0, 2), "<u4")

    # Decoding ----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: control pieces vanish, the first space of the dummy prefix too."""
        surface, parts, at = self.surface, [], 0
        strip = self.add_dummy_prefix or self.remove_extra_whitespaces
        runs = np.flatnonzero(self.is_byte[ids]).tolist() if len(ids) else []
        listed, seen = ids.tolist(), not strip
        # Up to the first piece that leaves text, one leading space goes.
        while at < len(listed) and not seen:
            piece = surface[listed[at]]
            if listed[at] in self.byte_of:
                break
            if piece.startswith(b" ") and self.types[listed[at]] == NORMAL:
                piece, seen = piece[1:], not self.remove_extra_whitespaces
            parts.append(piece)
            at += 1
            if piece:
                seen = True
        k = 0
        while k < len(runs):
            end = k + 1
            while end < len(runs) and runs[end] == runs[end - 1] + 1:
                end += 1
            parts += map(surface.__getitem__, listed[at : runs[k]])
            parts.append(self._bytes_text([self.byte_of[listed[i]] for i in runs[k:end]]))
            at, k = runs[end - 1] + 1, end
        parts += map(surface.__getitem__, listed[at:])
        return b"".join(parts).decode(errors="replace")

    @staticmethod
    def _bytes_text(values: list[int]) -> bytes:
        """UTF-8 of a run of byte pieces; each byte that starts no valid character is U+FFFD."""
        data, at, out = bytes(values), 0, []
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            pass
        while at < len(data):
            for width in (1, 2, 3, 4):
                try:
                    data[at : at + width].decode()
                except UnicodeDecodeError:
                    continue
                if at + width <= len(data):
                    out.append(data[at : at + width])
                    at += width
                    break
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)
