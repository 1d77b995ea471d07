"""Secret scans through nested encodings.

Every whole text is scanned for three kinds of secrets. Then a worklist unwraps URL escapes, Unicode escapes, base64 runs and
compressed payloads; every unwrapped layer is scanned and unwrapped again until no new layer appears. A layer seen before at the same place
(cycle) is not opened twice. Spans found in a layer are mapped back to code points of the text: escapes position by position, base64
by its four-to-three ratio (runs wrapped over lines are joined), compressed payloads (zlib, gzip with all its members, bare deflate) to the run that held them.

Decoded bytes need not be text: all patterns are ASCII, so they are looked for byte by byte and, where there are zero bytes, in units of two and four
bytes of either order; whatever is not ASCII stands as one other character. Compressed payloads are read to their end, in windows.

Defined results: a null text counts as empty; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
#: Bytes of an inflated payload that are scanned at a time, and how many of them the next window repeats at least (all of an unfinished base64 run of
#: up to half a window).
WINDOW, OVERLAP = 1 << 24, 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_HEADS = (b"\x1f\x8b", b"x\x01", b"x^", b"x\x9c", b"x\xda")
_HEADS_IN_BASE64 = ("H4s", "eA", "eF", "eJ", "eN")
#: No secret, and no layer that holds one, comes without this many printable characters on end.
_LEGIBLE = re.compile(rb"[\x20-\x7e\t\r\n]{12}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#x([0-9A-Fa-f]{1,6});")
_HEX_MAP = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class _Same:
    """A sequence that holds one value everywhere."""

    def __init__(self, value: int, size: int):
        self.value, self.size = value, size

    def __getitem__(self, i: int | slice):
        return [self.value] * len(range(*i.indices(self.size))) if isinstance(i, slice) else self.value


class Layer:
    """A text and, for each of its code points and its end, the span of the outer text it came from."""

    def __init__(self, text: str, starts: list[int] | range | _Same, ends: list[int] | range | _Same):
        self.text, self.starts, self.ends = text, starts, ends

    def outer(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        parts.append(layer.text[at : m.start()])
        starts += layer.starts[at : m.start()]
        ends += layer.ends[at : m.start()]
        for char, a, b in got:
            parts.append(char)
            starts.append(layer.starts[m.start() + a])
            ends.append(layer.ends[m.start() + b - 1])
        at = m.end()
    if not at:
        return None
    parts.append(layer.text[at:])
    starts += layer.starts[at:]
    ends += layer.ends[at:]
    return Layer("".join(parts), starts, ends)


def _percent(run: str):
    raw = bytes(int(run[i + 1 : i + 3], 16) for i in range(0, len(run), 3))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _unicode(run: str):
    out, found, i = [], list(_ONE.finditer(run)), 0
    codes = [int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16) for m in found]
    while i < len(found):
        m, code, step = found[i], codes[i], 1
        if 0xD800 <= code < 0xDC00 and i + 1 < len(found) and 0xDC00 <= codes[i + 1] < 0xE000:
            code, step = 0x10000 + ((code - 0xD800) << 10) + codes[i + 1] - 0xDC00, 2
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            out += [(c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m[0])]
        else:
            out.append((chr(code), m.start(), found[i + step - 1].end()))
        i += step
    return out


def _texts(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, offset, width) of bytes: one character for each ``width`` bytes from ``offset`` on."""
    if _LEGIBLE.search(raw):
        yield raw.decode("latin-1"), 0, 1
    if 0 not in raw:
        return
    for width, order, offset in ((w, o, k) for w in (2, 4) for o in "<>" for k in range(w)):
        n = (len(raw) - offset) // width
        units = np.frombuffer(raw, f"{order}u{width}", n, offset) if n > 0 else np.zeros(0, np.uint16)
        flat = np.where(units < 0x80, units, 0xFF).astype(np.uint8).tobytes()
        if _LEGIBLE.search(flat):
            yield flat.decode("latin-1"), offset, width


def _inflated(chunks: Iterable[bytes], bits: int = 47) -> Iterator[bytes]:
    """What a compressed stream and the gzip members right after it hold, as far as it is sound; a MB at a time. ``bits`` of -15: a bare stream without a head."""
    unpack = zlib.decompressobj(bits)
    try:
        for data in chunks:
            while True:
                out = unpack.decompress(data, 1 << 20)
                if out:
                    yield out
                data = unpack.unconsumed_tail
                if unpack.eof:
                    data = unpack.unused_data
                    if data and data[:2] != _HEADS[0]:
                        return
                    unpack = zlib.decompressobj(47)
                if not data and len(out) < 1 << 20:
                    break
    except zlib.error:
        return


def _windows(raw: bytes, bare: bool = False) -> Iterator[bytes]:
    """The windows of a compressed payload (compressed again or not); none if it is not compressed."""
    first, rest, seen = raw, iter(()), set()
    if bare:
        rest = _inflated([raw], -15)
        first = next(rest, b"")
        seen.add(raw)
    while first[:2] in _HEADS and first not in seen:
        seen.add(first)
        inner = _inflated(chain([first], rest))
        if not (head := next(inner, b"")):
            break
        first, rest = head, inner
    if not seen or first is raw or not first:
        return
    hold = bytearray()
    for chunk in chain([first], rest):
        hold += chunk
        if len(hold) >= WINDOW:
            yield bytes(hold)
            run = len(hold) - len(hold.rstrip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"))
            del hold[: -max(OVERLAP, run if run <= WINDOW // 2 else 0)]
    if hold:
        yield bytes(hold)


def _bare(raw: bytes) -> bool:
    """Whether bytes look like a deflate stream without a head: a first block of fixed or dynamic codes whose first bytes are legible or compressed again."""
    if len(raw) < 12 or raw[0] & 6 not in (2, 4):
        return False
    try:
        start = zlib.decompressobj(-15).decompress(raw[:4096], 256)
    except zlib.error:
        return False
    return bool(_LEGIBLE.search(start)) or start[:2] in _HEADS


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)


def _runs(text: str) -> Iterator[tuple[str, range | list[int], int]]:
    """(base64 run, position of each of its characters, end with padding): runs within a line, and runs joined over lines from the first line, from
    lines at another place of the four-character rhythm, and from lines that open a compressed payload."""
    for m in _RUN.finditer(text):
        run = m[0].rstrip("=")
        yield run, range(m.start(), m.start() + len(run)), m.end()
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        lines = [x.span() for x in _LINE.finditer(m[0])]
        if sum(b - a for a, b in lines) < 16:
            continue
        run = "".join(m[0][a:b] for a, b in lines)
        places = [m.start() + i for a, b in lines for i in range(a, b)]
        at, rhythms = 0, set()
        for a, b in lines:
            opens = run.startswith(_HEADS_IN_BASE64, at) and any(_inflated([_decoded(run[at : at + 256])]))
            if (opens or at % 4 not in rhythms) and len(run) - at >= 16:
                yield run[at:], places[at:], m.end()
            rhythms.add(at % 4)
            at += b - a


def _unpacked(layer: Layer) -> Iterator[Layer]:
    for run, places, end in _runs(layer.text):
        raw = _decoded(run)
        bare = raw[:2] not in _HEADS and _bare(raw)
        if bare or raw[:2] in _HEADS:
            a, b = layer.outer(places[0], end)
            for window in _windows(raw, bare):
                for text, _, _ in _texts(window):
                    yield Layer(text, _Same(a, len(text)), _Same(b, len(text)))
        for text, offset, width in _texts(raw):
            stop, last = offset + len(text) * width, len(run) - 1
            starts = [layer.starts[places[i * 4 // 3]] for i in range(offset, stop, width)]
            ends = [layer.ends[places[min(-(-i * 4 // 3) - 1, last)]] for i in range(offset + width, stop + 1, width)]
            yield Layer(text, starts, ends)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans of base and all layers), each by start, then kind as listed."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found, seen = set(base), {(text, 0, len(text))}
    work = [_opened(Layer(text, range(len(text)), range(1, len(text) + 1)))]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        # one text may lie at several places of the document: each of them is a layer of its own
        seal = (x.text, *x.outer(0, len(x.text))) if x.text else None
        if seal and seal not in seen:
            seen.add(seal)
            found.update((k, *x.outer(a, b)) for k, a, b in base_spans(x.text))
            work.append(_opened(x))
    return base, sorted(found, key=order)


def _opened(layer: Layer) -> Iterator[Layer]:
    yield from _unpacked(layer)
    if "%" in layer.text and (x := _substituted(layer, _PERCENT, _percent)):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _substituted(layer, _UNICODE, _unicode)):
        yield x


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join((*out, text[at:]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_added); a narrow map, one row a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "")
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """The rows and columns of ``docs`` with every secret span of ``text`` replaced by ``mark``; null texts stay null."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redacted(t, spans, mark) if (spans := all_spans(t)[1]) else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(work, docs.schema)
