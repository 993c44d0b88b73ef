"""Secrets in texts, also below layers of encoding.

Method. A worklist starts with the text itself. Each layer is scanned with the base patterns, then
searched for encoded regions: percent escapes, \\u and \\x escapes, base64 (also wrapped over lines),
and gzip or zlib streams inside base64 (all members of one). Every region's decoded form is a new layer
until none is left. Escapes of escapes are replaced layer by layer ``LEVELS`` times; what is nested deeper
is reduced to its fixpoint in one pass and scanned there, so the work stays in proportion to the text.
Decoded content is opened once and what it holds is kept by digest and reported at every place that has
it; the same content at the same place is not visited again, so cycles end. A layer of the text remembers
which part of it each of its characters came from, so findings are reported at places of the original text.

A content of more than ``WINDOW`` characters, which a short stream can unpack to, is read in pieces and never
held whole, with the results of one that is: findings, escapes and encoded regions go on from piece to piece
whatever their length, and what a long region stands for is kept packed until it is opened in its turn.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches
from cairn.llm.pii import scan
from cairn.llm.spans import SPAN, ordered

KINDS = ["assign", "access", "hex"]
#: Layers of escapes that are scanned one by one.
LEVELS = 8
#: Characters of a decoded content that are held at a time, and those from which on an encoded region of a longer
#: content, put together from pieces, is also reported as ``cut``. It is opened as any other is.
WINDOW, OVERLAP = 4 << 20, 1 << 20
#: Bytes given to a decompressor at a time.
BLOCK = 1 << 16

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_ESCAPE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 wrapped over lines of one length, as mail and key files have it, with a shorter last line.
_WRAPPED = re.compile(r"^(?:[A-Za-z0-9+/_-]{40,}\r?\n)+[A-Za-z0-9+/_-]*={0,2}", re.M)
#: For contents in pieces: where wrapped lines may begin, runs of escapes of either kind, an escape that is
#: not complete, and, read backwards, all that what follows may still complete.
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_LINE = re.compile(r"^[A-Za-z0-9+/_-]{40}", re.M)
_ESCAPES = re.compile(f"({_PERCENT.pattern})|{_ESCAPE.pattern}")
_PART = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?)\Z")
_PARTS = re.compile(r"(?:[0-9A-Fa-f]?%|(?:[0-9A-Fa-f]{0,3}u|[0-9A-Fa-f]?x)?\\)*+")
_OCTETS = re.compile("([\U0010ff80-\U0010ffff]+)|[^\U0010ff80-\U0010ffff]+")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: A byte of 128 or more of an escape is a private character until its neighbours are known.
_BYTE = 0x10FF00


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    """The base findings of one layer: leftmost non-overlapping matches of each kind that pass."""
    found = []
    if _HINT.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Layer:
    """Decoded text and where it came from: piece i of it starts at ``at[i]`` and stands for ``of[i]``."""

    def __init__(self, text: str, at: list[int], of: list[tuple[int, int, bool]]) -> None:
        self.text, self._at, self._of = text, at, of

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The part of the original text behind [start, end). A verbatim piece maps place by place,
        a decoded one as a whole."""
        first, last = bisect_right(self._at, start) - 1, bisect_right(self._at, max(start, end - 1)) - 1
        a, _, same = self._of[first]
        lo = a + start - self._at[first] if same else a
        b, to, same = self._of[last]
        return lo, b + end - self._at[last] if same else to


def _is_stream(data: bytes) -> bool:
    """Whether bytes start a gzip or zlib stream that can be unpacked."""
    if data[:2] != b"\x1f\x8b" and not (data[:1] == b"\x78" and int.from_bytes(data[:2]) % 31 == 0):
        return False
    try:
        return bool(zlib.decompressobj(47).decompress(data, 64))
    except zlib.error:
        return False


def _blocks(data: bytes) -> Iterator[bytes]:
    return (data[k : k + BLOCK] for k in range(0, len(data), BLOCK))


def _chunks(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked bytes of a stream's members, in chunks; all before a fault if it has one. What
    follows the last member comes as it is."""
    z = zlib.decompressobj(47)
    for block in blocks:
        while block:
            before = z.copy()
            try:
                chunk = z.decompress(block, WINDOW)
            except zlib.error:
                yield _until_fault(before, block)
                return
            yield chunk
            block = z.unconsumed_tail
            if z.eof:
                block = z.unused_data.lstrip(b"\0")
                while len(block) < BLOCK and (more := next(blocks, None)) is not None:
                    block = (block + more).lstrip(b"\0")
                if not _is_stream(block):
                    yield block
                    yield from blocks
                    return
                z = zlib.decompressobj(47)
    yield z.flush()


def _until_fault(z, block: bytes) -> bytes:
    """What a decompressor gives of a block before it fails."""
    out = []
    try:
        for k in range(len(block)):
            out.append(z.decompress(block[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


class Packed:
    """Bytes of any number, compressed: as they came out of a compressed stream, they are few again."""

    def __init__(self) -> None:
        self._z, self._parts, self._head = zlib.compressobj(1), [], b""
        self._hash = blake2b(digest_size=16, person=b"Packed")

    def put(self, data: bytes) -> None:
        self._head += data[: BLOCK - len(self._head)]
        self._hash.update(data)
        if part := self._z.compress(data):
            self._parts.append(part)

    def end(self) -> None:
        self._parts.append(self._z.flush())
        self._z = None

    def mark(self) -> bytes:
        return self._hash.digest()

    def chunks(self) -> Iterator[bytes]:
        """The bytes, unpacked if they are a stream."""
        return _chunks(self.blocks()) if _is_stream(self._head) else self.blocks()

    def blocks(self) -> Iterator[bytes]:
        z = zlib.decompressobj()
        for part in self._parts:
            while part:
                yield from _blocks(z.decompress(part, WINDOW))
                part = z.unconsumed_tail
        yield from _blocks(z.flush())


def _pieces(content: str | bytes | Packed) -> Iterator[str]:
    """The text of a content in pieces; what is not UTF-8 in a stream is replaced."""
    if isinstance(content, str):
        yield from (content[k : k + WINDOW] for k in range(0, len(content), WINDOW))
        return
    yield from _text(_chunks(_blocks(content)) if isinstance(content, bytes) else content.chunks())


def _text(chunks: Iterator[bytes]) -> Iterator[str]:
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield reader.decode(chunk)
    yield reader.decode(b"", True)


def _unbase64(blob: str) -> bytes | None:
    body = blob.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _blobs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of what may be base64."""
    for m in _BASE64.finditer(text):
        yield *m.span(), m[0]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            lines = m[0].split()
            if len({len(x) for x in lines[:-1]}) == 1 and len(lines[-1]) <= len(lines[0]):
                yield *m.span(), "".join(lines)


def escapes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the runs of escapes of one layer, by start."""
    out = []
    if "%" in text:
        for m in _PERCENT.finditer(text):
            out.append((*m.span(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")))
    if "\\" in text:
        for m in _ESCAPE.finditer(text):
            raw = "".join(chr(int(u or x, 16)) for u, x in _ESCAPE_ONE.findall(m[0]))
            out.append((*m.span(), _paired(raw)))
    return sorted(out)


def _paired(raw: str) -> str:
    """Surrogate halves joined; lone ones replaced."""
    return raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def blobs(text: str) -> Iterator[tuple[int, int, str | bytes]]:
    """(start, end, content) of the base64 regions of one layer: text, or a stream as bytes."""
    for start, end, blob in _blobs(text):
        if (content := _content(blob)) is not None:
            yield start, end, content


def _content(blob: str) -> str | bytes | None:
    # Plain words and hexadecimal runs are not base64: it mixes cases or has digits and letters beyond f.
    if blob.islower() and blob.isalpha() or blob.isdigit() or (data := _unbase64(blob)) is None:
        return None
    return data if _is_stream(data) else data.decode("utf-8", "replace")


def _whole(chars: list[str]) -> tuple[int, str] | None:
    """The length of the escape that ends ``chars`` and what it stands for."""
    if chars[-1] not in _HEX_DIGITS or len(chars) < 3 or chars[-2] not in _HEX_DIGITS:
        return None
    code = int(chars[-2] + chars[-1], 16)
    if chars[-3] == "%":
        return 3, chr(code) if code < 128 else chr(_BYTE + code)
    if chars[-4:-2] == ["\\", "x"]:
        return 4, chr(code)
    if chars[-6:-4] == ["\\", "u"] and all(c in _HEX_DIGITS for c in chars[-4:-2]):
        return 6, chr(int("".join(chars[-4:]), 16))
    return None


def reduced(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of what escapes of any depth stand for in the end. One pass: a character is
    pushed, and as long as the top of the stack is a whole escape, what it stands for takes its place."""
    chars: list[str] = []
    places: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        chars.append(c)
        places.append((i, i + 1))
        while found := _whole(chars):
            n, c = found
            places[-n:] = [(places[-n][0], i + 1)]
            chars[-n:] = [c]
    out, k = [], 0
    while k < len(chars):
        start, end = places[k]
        if end - start == 1:
            k += 1
            continue
        m = k
        while m < len(chars) and places[m][1] - places[m][0] > 1:
            m += 1
        run = _paired("".join(chars[k:m]))
        decoded = re.sub("[\U0010ff80-\U0010ffff]+", lambda x: bytes(ord(c) - _BYTE for c in x[0]).decode("utf-8", "replace"), run)
        out.append((start, places[m - 1][1], decoded))
        k = m
    return out


def _spliced(layer: Layer, cut: list[tuple[int, int, str]]) -> Layer:
    """The layer with its escape regions replaced by what they stand for."""
    parts, at, of, here, size = [], [], [], 0, 0

    def put(piece: str, start: int, end: int, verbatim: bool) -> None:
        nonlocal size
        if piece:
            lo, hi = layer.place(start, end)
            parts.append(piece)
            at.append(size)
            of.append((lo, hi, verbatim and hi - lo == len(piece)))
            size += len(piece)

    for start, end, decoded in cut:
        put(layer.text[here:start], here, start, True)
        put(decoded, start, end, False)
        here = end
    put(layer.text[here:], here, len(layer.text), True)
    return Layer("".join(parts), at, of)


def _layers(layer: Layer) -> Iterator[Layer]:
    """The layer and what it becomes as its escapes are replaced."""
    yield layer
    for level in range(LEVELS + 1):
        if not (cut := escapes(layer.text)):
            return
        layer = _spliced(layer, cut if level < LEVELS else reduced(layer.text))
        yield layer


class _Decoder:
    """What escapes of a run stand for, as they come: bytes of UTF-8 and halves of surrogate pairs wait."""

    def __init__(self) -> None:
        self._bytes, self._half = codecs.getincrementaldecoder("utf-8")("replace"), ""

    def octets(self, data: bytes) -> str:
        half, self._half = self._half, ""
        return _paired(half) + self._bytes.decode(data)

    def chars(self, raw: str) -> str:
        before, raw = self._bytes.decode(b"", True), self._half + raw
        n = len(raw) - ("\ud800" <= raw[-1] <= "\udbff")
        self._half = raw[n:]
        return before + _paired(raw[:n])

    def end(self) -> str:
        return self.octets(b"") + self._bytes.decode(b"", True)


def _unescaped(pieces: Iterator[str]) -> Iterator[str]:
    """The text in pieces with the runs that ``escapes`` gives replaced."""
    run, octets, held = _Decoder(), False, ""

    def replaced(text: str) -> Iterator[str]:
        nonlocal octets
        here = 0
        for m in _ESCAPES.finditer(text):
            if m.start() > here or octets != bool(m[1]):
                yield run.end() + text[here : m.start()]
            here, octets = m.end(), bool(m[1])
            yield run.octets(bytes.fromhex(m[0].replace("%", ""))) if octets else run.chars("".join(chr(int(u or x, 16)) for u, x in _ESCAPE_ONE.findall(m[0])))
        if here < len(text):
            yield run.end() + text[here:]

    for piece in pieces:
        held += piece
        m = _PART.search(held, max(0, len(held) - 5))
        n = m.start() if m else len(held)
        yield "".join(replaced(held[:n]))
        held = held[n:]
    yield "".join(replaced(held)) + run.end()


def _reduced(pieces: Iterator[str]) -> Iterator[str]:
    """The text in pieces with what ``reduced`` gives replaced."""
    run = _Decoder()
    chars: list[str] = []
    decoded: list[bool] = []

    def done(n: int) -> Iterator[str]:
        k = 0
        while k < n:
            m = k
            while m < n and decoded[m] == decoded[k]:
                m += 1
            text = "".join(chars[k:m])
            if not decoded[k]:
                yield run.end() + text
            else:
                for part in _OCTETS.finditer(text):
                    yield run.octets(bytes(ord(c) - _BYTE for c in part[0])) if part[1] else run.chars(part[0])
            k = m
        del chars[:n], decoded[:n]

    for piece in pieces:
        for c in piece:
            chars.append(c)
            decoded.append(False)
            while found := _whole(chars):
                n, c = found
                chars[-n:], decoded[-n:] = [c], [True]
        yield "".join(done(len(chars) - _PARTS.match("".join(reversed(chars))).end()))
    yield "".join(done(len(chars))) + run.end()


class _Kinds:
    """The kinds of base findings in a text in pieces."""

    def __init__(self, kinds: set[str]) -> None:
        self._kinds, self._tail, self._held = kinds, "", ""

    def put(self, piece: str) -> None:
        text = self._tail + piece
        if "AKIA" in text and _ACCESS.search(text):
            self._kinds.add("access")
        if "hex" not in self._kinds and _HEX.search(text):
            self._kinds.add("hex")
        self._tail = text[-32:]
        if "assign" not in self._kinds:
            self._assign(piece)

    def _assign(self, piece: str) -> None:
        # One space is as good as many between name and value; a match without the value then has 13 characters.
        text, end = re.sub("  +", " ", self._held + piece), 0
        if _HINT.search(text):
            for m in _ASSIGN.finditer(text):
                if len(m[1]) >= 6:
                    self._kinds.add("assign")
                    return
                if m.end() == len(text):
                    self._held = m[0]
                    return
                end = m.end()
        self._held = text[max(end, len(text) - 16) :]


class _Blob:
    """Base64 of any length in parts; ``content`` is what ``blobs`` gives of it, or none."""

    def __init__(self) -> None:
        self.size, self._lower, self._numeric = 0, True, True
        self._parts, self._held, self._packed = [], 0, None

    def put(self, part: str) -> None:
        if not part:
            return
        self.size += len(part)
        self._lower = self._lower and part.islower() and part.isalpha()
        self._numeric = self._numeric and part.isdigit()
        self._parts.append(part)
        self._held += len(part)
        if self._held > WINDOW:
            text = "".join(self._parts)
            n = len(text) // 4 * 4
            self._packed = self._packed or Packed()
            self._packed.put(_unbase64(text[:n]))
            self._parts, self._held = [text[n:]], len(text) - n

    def pad(self, n: int) -> None:
        """It ends with this many signs of equality, as no plain word does."""
        if n:
            self._lower = self._numeric = False

    def content(self) -> str | bytes | Packed | None:
        if self._lower or self._numeric or (data := _unbase64("".join(self._parts))) is None:
            return None
        if self._packed is None:
            return data if _is_stream(data) else data.decode("utf-8", "replace")
        self._packed.put(data)
        self._packed.end()
        return self._packed


class _Regions:
    """The regions that ``_blobs`` gives, of a text in pieces: ``met`` is called with the size and content of each."""

    def __init__(self, met: Callable[[int, str | bytes | Packed | None], None]) -> None:
        self._met, self._run, self._held, self._lines = met, _Blob(), "\n", None

    def put(self, piece: str, last: bool) -> None:
        self._runs(piece, last)
        self._wrapped(piece, last)

    def _runs(self, piece: str, last: bool) -> None:
        here = _RUN.match(piece).end()
        self._run.put(piece[:here])
        if here < len(piece):
            self._end_run(piece[here] == "=")
            end = len(piece.rstrip(_DIGITS))
            for m in _BASE64.finditer(piece, here, end):
                self._met(len(m[0]), _content(m[0]))
            self._run.put(piece[end:])
        if last:
            self._end_run(False)

    def _end_run(self, padded: bool) -> None:
        if self._run.size >= 16:
            self._run.pad(padded)
            self._met(self._run.size, self._run.content())
        if self._run.size:
            self._run = _Blob()

    def _wrapped(self, piece: str, last: bool) -> None:
        # The first character is the one before those that are still to be read.
        text, here = self._held + piece, 1
        while True:
            if self._lines is None:
                if (m := _LINE.search(text, here)) is None:
                    line = max(text.rfind("\n") + 1, 1)
                    self._held = text[line - 1 :] if text[line - 1] == "\n" and line >= here and not text[line:].strip(_DIGITS) else text[-1]
                    return
                self._lines, here = _Lines(), m.start()
            here, over = self._lines.put(text, here, last)
            if not over:
                self._held = text[here - 1 :]
                return
            if self._lines.whole():
                self._met(self._lines.blob.size, self._lines.blob.content())
            self._lines = None


class _Lines:
    """Wrapped base64: lines of 40 characters or more, all of one length but the last, which may be shorter."""

    def __init__(self) -> None:
        self.blob = _Blob()
        self._ended = self._count = self._first = self._size = 0
        self._short, self._equal = False, True

    def put(self, text: str, here: int, last: bool) -> tuple[int, bool]:
        """Reads on at ``here``; where it stopped, and whether the region is over."""
        while True:
            end = _RUN.match(text, here).end()
            if end > here:
                if not self._size:
                    self._count += 1
                    self._equal = self._equal and not self._short
                self._size += end - here
                if self._equal:
                    self.blob.put(text[here:end])
            here = end
            after = text[here : here + 2]
            if not last and after in ("", "\r", "="):
                return here, False
            n = 1 if after[:1] == "\n" else 2 if after == "\r\n" else 0
            over = not n or self._size < 40
            pad = len(after) - len(after.lstrip("="))
            self._count += pad > 0 and not self._size
            self._equal = self._equal and not (pad and self._short and not self._size)
            self.blob.pad(pad)
            if self._size or pad:
                self._first = self._first or self._size
                self._short = self._short or self._size < self._first
                self._equal = self._equal and self._size + pad <= self._first
            if over:
                return here, True
            self._ended += 1
            self._size = 0
            here += n

    def whole(self) -> bool:
        return self._ended > 0 and self._count > 1 and self._equal


def _long_layers(content: str | bytes | Packed) -> Iterator[Iterator[str]]:
    """The layers of a content as ``_layers`` gives them, each in pieces; each must be read before the next."""
    escaped = False

    def read(pieces: Iterator[str], kept: Packed | None) -> Iterator[str]:
        nonlocal escaped
        held = ""
        for piece in pieces:
            held += piece
            escaped = escaped or ("%" in held or "\\" in held) and _ESCAPES.search(held) is not None
            held = held[-5:]
            if kept is not None:
                kept.put(piece.encode("utf-8", "replace"))
            yield piece

    yield read(_pieces(content), None)
    pieces = _pieces(content)
    for level in range(LEVELS + 1):
        if not escaped:
            return
        escaped, kept = False, Packed()
        yield read(_unescaped(pieces) if level < LEVELS else _reduced(pieces), kept)
        kept.end()
        pieces = _text(kept.blocks())


def find(text: str) -> list[tuple]:
    """(kind, start, end, score, base) of a text's findings, by start and then kind. Findings of
    inner layers carry base = false and the score 0.8; those of the text itself 1.0."""
    found: dict[tuple, tuple] = {}
    waiting: dict[bytes, str | bytes | Packed] = {}  # decoded contents that are not opened yet
    held: dict[bytes, tuple[set[str], set[bytes]]] = {}  # the kinds and the contents in an opened one
    work, seen = deque(), set()

    def note(kind: str, start: int, end: int, base: bool = False) -> None:
        found.setdefault((kind, start, end), (kind, start, end, 0.5 if kind == "cut" else 1.0 if base else 0.8, base))

    def meet(content: str | bytes | Packed) -> bytes:
        if isinstance(content, Packed):
            mark = content.mark()
        else:
            mark = blake2b(content if isinstance(content, bytes) else content.encode("utf-8", "replace"), digest_size=16, person=type(content).__name__.encode()).digest()
        if mark not in held:
            waiting.setdefault(mark, content)
        return mark

    def visit(mark: bytes, place: tuple[int, int]) -> None:
        if (mark, place) not in seen:
            seen.add((mark, place))
            work.append((mark, place))

    def opened(content: str | bytes | Packed) -> tuple[set[str], set[bytes]]:
        kinds: set[str] = set()
        inner: set[bytes] = set()
        parts, size = [], 0
        for piece in _pieces(content):
            parts.append(piece)
            size += len(piece)
            if size > WINDOW:
                break
        else:
            for layer in _layers(Layer("".join(parts), [0], [(0, size, True)])):
                kinds.update(kind for kind, _, _ in base_secrets(layer.text))
                inner.update(meet(decoded) for _, _, decoded in blobs(layer.text))
            return kinds, inner
        del parts

        def met(size: int, decoded: str | bytes | Packed | None) -> None:
            if size > OVERLAP:
                kinds.add("cut")
            if decoded is not None:
                inner.add(meet(decoded))

        for pieces in _long_layers(content):
            scan, regions = _Kinds(kinds), _Regions(met)
            for piece in pieces:
                scan.put(piece)
                regions.put(piece, False)
            regions.put("", True)
        return kinds, inner

    for level, layer in enumerate(_layers(Layer(text, [0], [(0, len(text), True)]))):
        for kind, start, end in base_secrets(layer.text):
            note(kind, *layer.place(start, end), base=level == 0)
        for start, end, decoded in blobs(layer.text):
            visit(meet(decoded), layer.place(start, end))
    # A decoded content stands for its place as a whole, so what it holds is the same at every place.
    while work:
        mark, place = work.popleft()
        if mark not in held:
            held[mark] = opened(waiting.pop(mark))
        kinds, inner = held[mark]
        for kind in kinds:
            note(kind, *place)
        for mark in inner:
            visit(mark, place)
    return ordered(found.values(), [*KINDS, "cut"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score, base) of every row's whole text.

    Null and empty texts have no spans; repeated rows give repeated rows, null ids stay null; an empty
    table gives no rows; very long texts are scanned whole, in time that grows with their length; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan(find), f"doc_id long, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
