"""Secret scans with a recursive decoding worklist.

Each text is scanned as it stands.  Then its URL and Unicode escapes are decoded where they stand, so that the text
around them stays, and encoded stretches (base64, also over line ends, and zlib or gzip data inside) are decoded; each
layer is scanned again and joins the worklist until nothing new appears; a layer seen before within the same text (a
cycle) is not decoded again.  A find in a decoded layer is mapped to the stretch of the original text that holds it.
"""

from __future__ import annotations

import base64
import codecs
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: The patterns of the three kinds, with letters of the first in either case.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
URL = re.compile(r"(?<![A-Za-z0-9._~+-])[A-Za-z0-9._~+-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~+-]*+)+")  # from a run's start only, so that long runs take linear time
FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+")  # escapes alone, where the text between has become words
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over line ends; what stands before it on lines of its own may shift it, so it is read from four places.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++")
_OCTETS = re.compile(r"(?:%[0-7][0-9A-Fa-f])|(?:%[89A-Fa-f][0-9A-Fa-f])+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_PACKED = re.compile("(?=e[A-P]|H4s)")  # how zlib and gzip data begin in base64
#: So many characters of base64 are unpacked first, as most of what looks like the beginning of compressed data breaks off within them.
_PROBE = 128
#: Compressed layers are read to their end, in windows of about LAYER_BYTES that overlap by CARRY characters.
LAYER_BYTES, CARRY = 1 << 24, 1 << 22


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and without overlap per kind."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _escape(m: re.Match) -> str:
    code = int(m[5]) if m[5] else int(next(filter(None, m.groups())), 16)
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else m[0]


def _bytes(s: str) -> bytes:
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _octet_text(s: str) -> str:
    """Base64 as text with a character for each byte: the patterns are ASCII, and places can be told."""
    return _bytes(s).decode("latin-1")


def _inflated(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """zlib or gzip data (members too) in parts of some MB at most, as far as it can be unpacked, and how much was read."""
    at, unpack = 0, zlib.decompressobj(47)
    while at < len(raw):
        part, before = raw[at : at + 4096], unpack.copy()
        at += len(part)
        try:
            yield unpack.decompress(part), at - len(unpack.unused_data)
        except zlib.error:  # what comes before the damage
            for k in range(len(part)):
                try:
                    yield before.decompress(part[k : k + 1]), at - len(part) + k + 1
                except zlib.error:
                    return
        if unpack.eof:
            at -= len(unpack.unused_data)
            if raw[at : at + 2] != b"\x1f\x8b":
                return
            unpack = zlib.decompressobj(47)


def _unpacked(raw: bytes) -> Iterator[str]:
    """Compressed data as windows of text, each with the last CARRY characters of the one before."""
    decoder, tail, held = codecs.getincrementaldecoder("utf-8")("replace"), "", []
    size = 0
    for part, _ in _inflated(raw):
        held.append(part)
        size += len(part)
        if size >= LAYER_BYTES:
            window = tail + decoder.decode(b"".join(held))
            yield window
            tail, held, size = window[-CARRY:], [], 0
    if size:
        yield tail + decoder.decode(b"".join(held), True)


def _base64(s: str) -> Iterator[str]:
    """What a stretch decodes to: whatever is glued to its front, base64 begins at one of four places, and compressed data
    wherever they can be unpacked."""
    for k in range(4):
        yield _bytes(s[k:]).decode(errors="replace")
    for m in _PACKED.finditer(s):
        first = _bytes(s[m.start() : m.start() + _PROBE])
        if used := max((n for _, n in _inflated(first)), default=0):
            yield from _unpacked(_bytes(s[m.start() :]) if used + 2 > len(first) else first)


def _octets(m: re.Match) -> str:
    return urllib.parse.unquote(m[0], errors="replace")


class Layer(NamedTuple):
    """A text, and for each of its characters where it comes from: the stretch of the original text, one stretch for all, or (None) just there."""

    text: str
    start: np.ndarray | int | None = None
    end: np.ndarray | int | None = None

    def stretch(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return (self.start, self.end) if isinstance(self.start, int) else (int(self.start[a:b].min()), int(self.end[a:b].max()))


def _unescaped(layer: Layer, stretches: re.Pattern, escapes: re.Pattern, decode: Callable[[re.Match], str]) -> Layer:
    """The whole layer with its escapes decoded.  What an escape decodes to comes from the stretch of escapes around it."""
    text, at, pieces, starts, ends = layer.text, 0, [], [], []
    if layer.start is None and escapes.search(text):
        layer = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
    whole = isinstance(layer.start, int)
    for run in stretches.finditer(text):
        s, e = layer.stretch(*run.span())
        for m in escapes.finditer(text, *run.span()):
            new = decode(m)
            pieces += [text[at : m.start()], new]
            if not whole:
                starts += [layer.start[at : m.start()], np.full(len(new), s)]
                ends += [layer.end[at : m.start()], np.full(len(new), e)]
            at = m.end()
    if not pieces:
        return layer
    out = "".join([*pieces, text[at:]])
    return Layer(out, layer.start, layer.end) if whole else Layer(out, np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def layers(layer: Layer) -> Iterator[Layer]:
    """What a layer decodes to: itself without escapes, and its base64 stretches."""
    text = layer.text
    if "%" in text and (plain := _unescaped(layer, URL, _OCTETS, _octets)).text != text:
        yield plain
        if "+" in text:  # a blank in forms
            yield _unescaped(layer._replace(text=text.replace("+", " ")), FORM, _OCTETS, _octets)
    if ("\\" in text or "&#" in text) and (plain := _unescaped(layer, UNICODE, _ESCAPE, _escape)).text != text:
        yield plain
    for m in BASE64.finditer(text):
        for decoded in _base64(m[0]):
            yield Layer(decoded, *layer.stretch(*m.span()))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield from _wrapped(layer, m)


def _wrapped(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """Base64 over line ends; what is found in it comes from the lines that it covers."""
    lines = [(x.start(), x.end()) for x in re.compile(r"[^\s]+").finditer(layer.text, *m.span())]
    body = "".join(layer.text[a:b] for a, b in lines)
    if len(body) < 16:
        return
    lines[-1] = lines[-1][0], m.end() + re.match("={0,2}", layer.text[m.end() : m.end() + 2]).end()
    first = np.cumsum([0, *(b - a for a, b in lines[:-1])])
    start, end = np.array([layer.stretch(a, b) for a, b in lines]).T
    line = lambda i: np.minimum(np.searchsorted(first, i, side="right") - 1, len(lines) - 1)
    for k in range(4):
        text = _octet_text(body[k:])
        bit = 8 * np.arange(len(text))
        yield Layer(text, start[line(k + bit // 6)], end[line(k + (bit + 7) // 6)])
    for i, (a, b) in enumerate(lines):
        if _PACKED.match(layer.text, a, b):
            raw = _bytes(body[first[i] :])
            used = max((n for _, n in _inflated(raw)), default=0)
            last = int(line(first[i] + (8 * used - 1) // 6)) if used else i
            for text in _unpacked(raw):
                yield Layer(text, int(start[i]), int(end[last]))


Spans = list[tuple[str, int, int]]


def find_secrets(text: str) -> tuple[Spans, Spans]:
    """The base spans, and those that decoding adds, each by start and kind."""
    return examine(text)[:2]


def examine(text: str) -> tuple[Spans, Spans, int]:
    """The same, and how many characters decoding gave: far more than the text has tells of data made to swell."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(scan(text), key=order)
    added: set[tuple[str, int, int]] = set()
    seen: set[bytes] = set()
    decoded = 0

    work = [layers(Layer(text))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        decoded += len(layer.text)
        whole = isinstance(layer.start, int)
        key = blake2b(f"{(layer.start, layer.end) if whole else ''}:{layer.text}".encode(errors="replace"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        for kind, a, b in scan(layer.text):
            s, e = layer.stretch(a, b)
            if whole or layer.text[a:b] != text[s:e]:  # what stands there as it is was the base scan's
                added.add((kind, s, e))
        work.append(layers(layer))
    return base, sorted(added - set(base), key=order), decoded


def _joined(spans: Spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, decoded_chars for each row of docs (doc_id, text):
    counts of base spans, a digest of them, all spans, how many decoding added, and how many characters it gave.

    Null texts count as empty and have no spans; repeated rows, null ids and further columns don't matter; an empty
    table gives an empty result.  Whole texts are scanned, however long, and so are their decoded layers, but for one
    case: compressed data of over CARRY characters of base64 within another compressed layer may be cut where a window
    of LAYER_BYTES of that layer ends.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                base, added, decoded = examine(text or "")
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                every = sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                out.append((*n, sha256(_joined(base).encode()).hexdigest(), _joined(every), len(added), decoded))
            yield pd.concat([part[["doc_id"]].reset_index(drop=True).astype("Int64"), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "decoded_chars"])], axis=1)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, decoded_chars long")


def masked(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    base, added = find_secrets(text)
    pieces, at = [], 0
    for _, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s >= at:
            pieces += [text[at:s], mark]
        at = max(at, e)
    return "".join([*pieces, text[at:]])


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span, decoded or not, replaced by mark; n_chars, if there, follows the new text.

    Null texts stay null; repeated rows, null ids and further columns of any name and type stay; empty tables stay empty.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, mark) for t in texts], dtype=object)

    out = docs.withColumn("text", mask("text"))
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out
