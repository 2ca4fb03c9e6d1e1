"""Secret scans by a recursive decoding worklist.

A text is the first layer.  Every layer is scanned for secrets, then each encoded run in it (URL escapes,
Unicode escapes, base64, hexadecimal, and compressed bytes inside these) is decoded into a further layer and put on the worklist, until
no layer gives a new one.  Layers are remembered by content for each span of the original text that they were decoded from, so a
cycle ends, and a layer is looked at in every span that holds it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import chain
from math import log2

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

#: A private key: through its END line, or without one to the end of its base64 lines.
_KEY_LINE = r"PRIVATE KEY(?: BLOCK)?-----"
_PRIVATE_KEY = (
    rf"(-----BEGIN (?:[A-Z0-9]+ )*{_KEY_LINE}(?:(?:(?!-----BEGIN )(?s:.))*?-----END (?:[A-Z0-9]+ )*{_KEY_LINE}"
    r"|(?:(?:\s|\\[rn])*+(?:[A-Z][A-Za-z-]+: [^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}))*+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?))"
)

#: (rule, pattern, group that holds the secret, least bits per character of the secret)
RULES = (
    ("aws_access_key", r"(?<![A-Za-z0-9])((?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16})(?![A-Za-z0-9])", 1, 0.0),
    ("github_token", r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", 1, 0.0),
    ("slack_token", r"(?<![A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{10,})", 1, 0.0),
    ("stripe_key", r"(?<![A-Za-z0-9])([rs]k_(?:live|test)_[A-Za-z0-9]{16,})", 1, 0.0),
    ("google_api_key", r"(?<![A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])", 1, 0.0),
    ("jwt", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 0.0),
    ("private_key", _PRIVATE_KEY, 1, 0.0),
    ("url_password", r"(?<![A-Za-z])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*:([^\s/:@]+)@", 1, 0.0),
    ("assigned_secret", r"(?i)(?<![a-z])(?:api[_-]?key|apikey|access[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|auth[_-]?token|access[_-]?token|token|passwd|password|pwd)[\"']?\s{0,4}(?:=>|:=|[=:])\s{0,4}[\"']?([A-Za-z0-9_\-+/=.!@#$%^&*~]{8,})", 1, 2.5),
)
#: Encoded runs shorter than this hold less than 12 bytes: no secret of any rule but the password of a URL of up to 11 characters in all.
LEAST_RUN = 16
#: Bytes that are unpacked at a time, and of a chunk of unpacked text.
PIECE, CHUNK = 1 << 20, 4096
_ZLIB = type(zlib.decompressobj())

#: Lower-case strings of which a rule's matches hold at least one.
_HINTS = {
    "aws_access_key": ("akia", "asia", "aroa", "aida"), "github_token": ("gh",), "slack_token": ("xox",), "stripe_key": ("k_",),
    "google_api_key": ("aiza",), "jwt": ("eyj",), "private_key": ("private key",), "url_password": ("://",), "assigned_secret": ("key", "secret", "token", "passwd", "password", "pwd"),
}
_RULES = [(n, re.compile(p), g, b, _HINTS[n]) for n, p, g, b in RULES]
_URL = re.compile(r"(?<![^\s%])[^\s%]*+(?:%[0-9A-Fa-f]{2}[^\s%]*+)+")
_UNICODE = re.compile(r"(?<![^\s\\])[^\s\\]*+(?:\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})[^\s\\]*+)+")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}|[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST_RUN)
_GLUE = re.compile(r"[/_-]")
#: Base64 of the first bytes of gzip, zstd, bzip2, xz and zlib.
_PACKED = re.compile(r"H4sI|KLUv/|Qlpo|/Td6WFoA|e(?:J[w-z]|N[o-r]|A[E-H]|F[4-7])")
#: Text of at least the bytes of LEAST_RUN characters.
_STRETCH = re.compile(rb"(?:[\t\n\r -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}" % (LEAST_RUN * 3 // 4))
#: Of the separators in a stretch of text the first and last so many are tried one by one, and all of them together.
GLUED = 8
_TO_BASE64 = str.maketrans("-_", "+/", "\r\n=")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){%d,}+(?![0-9A-Za-z])" % (LEAST_RUN * 3 // 4))

#: What a text must match for any rule or decoder to find something in it; everything else is passed over by the JVM.
CANDIDATE = r"(?i)akia|asia|aroa|aida|gh[pousr]_|github_pat|xox[a-z]-|[rs]k_(?:live|test)|aiza|eyJ|PRIVATE KEY|://[^\s/:@]*:|api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|%[0-9a-f]{2}|\\u[0-9a-f]{4}|\\x[0-9a-f]{2}|[a-z0-9+/_-]{16}"


def _bits(s: str) -> float:
    n = len(s)
    return -sum(k / n * log2(k / n) for k in map(s.count, set(s)))


def _text(data: bytes) -> str | None:
    """data as text, if nearly all of it can be."""
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in s if c < " " and c not in "\t\n\r")
    return s if odd * 20 <= len(s) else None


def _stream(data: bytes):
    """The decompressor of the stream that data begins with."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 6 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unpacked(data: bytes):
    """All streams, members or frames that data begins with, unpacked one after the other, in pieces of about PIECE bytes."""
    while data:
        if data[1:4] == b"\x2a\x4d\x18" and data[0] >> 4 == 5:  # a frame of zstd that holds no text
            data = data[8 + int.from_bytes(data[4:8], "little") :]
            continue
        stream = _stream(data)
        if stream is None:
            return
        try:
            if isinstance(stream, _ZLIB):
                while True:
                    yield stream.decompress(data, PIECE)
                    data = stream.unconsumed_tail
                    if stream.eof or not data:
                        break
                data = stream.unused_data
            elif isinstance(stream, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                while not stream.eof and (data or not stream.needs_input):
                    yield stream.decompress(data, PIECE)
                    data = b""
                data = stream.unused_data
            else:  # zstandard gives all that its input holds, so it gets little at a time
                at = 0
                while not stream.eof and at < len(data):
                    yield stream.decompress(data[at : at + 64])
                    at += 64
                data = stream.unused_data + data[at:]
        except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        data = data.lstrip(b"\0")  # members may be padded


_SPACE = re.compile(rb"\s")


def _folded(pieces) -> bytes:
    """Unpacked text without the repetitions of what it holds already.

    It's cut at white space into chunks of some CHUNK bytes; of two chunks that follow each other as two did before, nothing new can come, and
    they're left out.  So whatever lies within two chunks is kept whole, and text that unpacks to a thousand times its size takes little room and time.
    """
    out, seen, last, gap, rest = [], set(), b"", False, b""

    def take(chunk: bytes):
        nonlocal last, gap
        key = hash((last, chunk))
        if key in seen:
            gap = True
        else:
            seen.add(key)
            out.extend((b"\n", last, chunk) if gap else (chunk,))
            gap = False
        last = chunk

    for piece in pieces:
        rest, at = rest + piece if rest else piece, 0
        while len(rest) - at > 2 * CHUNK:
            found = _SPACE.search(rest, at + CHUNK, at + 2 * CHUNK)
            end = found.end() if found else at + 2 * CHUNK
            take(rest[at:end])
            at = end
        rest = rest[at:]
    if rest:
        take(rest)
    return b"".join(out)


def _inflate(data: bytes) -> bytes | None:
    """What data unpacks to; whole if it's packed again, else folded."""
    pieces = _unpacked(data)
    head = b""
    for piece in pieces:
        head += piece
        if len(head) >= 8:
            break
    if not head:
        return None
    if _stream(head) is not None:
        return head + b"".join(pieces)
    return _folded(chain((head,), pieces))


def _opened(data: bytes, how: str):
    """(how, text) of decoded bytes: unpacked for as long as they are compressed."""
    while (inner := _inflate(data)) is not None and inner != data:
        data, how = inner, how + ">compressed"
    text = _text(data)
    if text is not None:
        yield how, text


def _unescape(run: str) -> str:
    def one(m):
        c = int(m[1] or m[2] or m[3], 16)
        return chr(c) if c < 0x110000 else "�"

    out = _ESCAPE.sub(one, run)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _layers(text: str):
    """(start, end, how, decoded text) of the encoded runs of one layer."""
    if "%" in text:
        for m in _URL.finditer(text):
            data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0].encode("utf-8", "replace"))
            for how, out in _opened(data, "url"):
                yield m.start(), m.end(), how, out
    if "\\" in text:
        for m in _UNICODE.finditer(text):
            yield m.start(), m.end(), "unicode", _unescape(m[0])
    for m in _HEX.finditer(text):
        for how, out in _opened(binascii.unhexlify(m[0]), "hex"):
            yield m.start(), m.end(), how, out
    for m in _BASE64.finditer(text):
        yield from _base64_layers(m[0], m.start(), m.end())
        if "\n" in m[0]:
            # the last line may be a word of the text that follows the block
            yield from _base64_layers(m[0].rpartition("\n")[0], m.start(), m.start() + m[0].rindex("\n"))


def _base64_layers(run: str, start: int, end: int):
    """Layers of a base64 run, to which other words, paths or names may be glued by letters, digits, '/', '-' and '_'."""
    at = None
    if "\n" in run:
        at = [i for i, c in enumerate(run) if c not in "\r\n="]
    ends = [m.start() for m in _GLUE.finditer(run)]
    plain = run.translate(_TO_BASE64)

    def place(a: int, b: int) -> tuple[int, int]:
        return (start + a, start + b) if at is None else (start + at[a], start + at[min(b, len(at)) - 1] + 1)

    def decoded(skip: int) -> bytes:
        body = plain[skip:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        return base64.b64decode(body + "=" * (-len(body) % 4))

    # bare, or glued to something before: an alignment in which the whole rest is text
    for skip in range(4):
        if len(plain) - skip < LEAST_RUN:
            break
        found = list(_opened(decoded(skip), "base64"))
        for how, out in found:
            yield place(skip, 0)[0] if at is None else start + at[skip], end, how, out
        if found and (skip == 0 or at is not None or not ends):
            return
        if found:
            break
    # compressed bytes anywhere in the run; what follows their end doesn't matter
    for m in _PACKED.finditer(plain):
        if len(plain) - m.start() >= LEAST_RUN:
            for how, out in _opened(decoded(m.start()), "base64"):
                if how != "base64":
                    yield *place(m.start(), len(plain)), how, out
    # text anywhere in the run: in each alignment the longest stretches, and these cut where something may be glued
    cuts = [e + 1 for e in ends] if at is None else []
    for skip in range(4):
        if len(plain) - skip < LEAST_RUN:
            return
        data = decoded(skip)
        for m in _STRETCH.finditer(data):
            a, b = m.span()
            first, last = skip + a * 4 // 3, min(len(plain), skip + -(-b * 4 // 3))
            yield *place(first, last), "base64", m[0].decode("utf-8", "replace")
            # offsets in the stretch where a part between separators begins or ends in this alignment
            here = [(c, (c - skip) * 3 // 4 - a) for c in cuts[bisect_right(cuts, first) : bisect_left(cuts, last)] if (c - skip) % 4 == 0]
            stops = [(e - skip) * 3 // 4 - a for e in ends[bisect_right(ends, first) : bisect_left(ends, last)]] if at is None else []
            for c, k in here[:GLUED]:
                yield c + start, start + last, "base64", m[0][k:].decode("utf-8", "replace")
            for k in stops[-GLUED:]:
                yield start + first, start + last, "base64", m[0][:k].decode("utf-8", "replace")
            if here or stops:
                parts = sorted({0, len(m[0]), *(k for _, k in here), *stops})
                yield start + first, start + last, "base64", "\n".join(m[0][x:y].decode("utf-8", "replace") for x, y in zip(parts, parts[1:]))


def scan_text(text: str | None) -> list[tuple[str, str, int, int, int, str]]:
    """(rule, secret, start, end, depth, how) of every secret of a text, in the order of their spans.

    start and end are characters of the original text: of the secret itself in the first layer, of the outermost
    encoded run below it.  A secret found again within one span by another layer counts once, with the least depth.
    """
    if not text:
        return []
    found: dict[tuple, tuple] = {}
    seen, work = set(), [(text, None, 0, "")]
    while work:
        layer, span, depth, how = work.pop()
        taken, low = [], layer.lower()
        for rule, pattern, group, bits, hints in _RULES:
            if not any(h in low for h in hints):
                continue
            for m in pattern.finditer(layer):
                secret, at = m[group], m.span(group)
                if _bits(secret) < bits or any(a <= at[0] and at[1] <= b for a, b in taken):
                    continue
                taken.append(at)
                start, end = span or at
                key = (rule, secret, start, end)
                if key not in found or found[key][4] > depth:
                    found[key] = (rule, secret, start, end, depth, how)
        for start, end, kind, inner in _layers(layer):
            # the same layer in another span of the original text is another finding, in the same one it's a cycle
            key = (span or (start, end), inner)
            if len(inner) >= 8 and key not in seen:
                seen.add(key)
                work.append((inner, key[0], depth + 1, f"{how}>{kind}" if how else kind))
    # one encoded run may give the same secret by several cuts: the widest span stands for those it overlaps
    out, reach = [], {}
    for f in sorted(found.values(), key=lambda f: (f[2], -f[3], f[0], f[1])):
        if f[4] and f[2] < reach.get(f[:2], 0):
            continue
        if f[4]:
            reach[f[:2]] = f[3]
        out.append(f)
    return sorted(out, key=lambda f: (f[2], f[3], f[0], f[1]))


def mask_text(text: str | None, label: str = "[SECRET]") -> str | None:
    """text with the span of every secret replaced."""
    spans = [(f[2], f[3]) for f in scan_text(text)]
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], label]
        at = max(at, end)
    return "".join([*out, text[at:]])


_FOUND = "array<struct<rule:string,secret:string,start:int,end:int,depth:int,layers:string>>"


def candidate(text: Column) -> Column:
    """Whether a text could hold a secret at all."""
    return text.rlike(CANDIDATE)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, secret, start, end, depth, layers): every secret, with its span in the original text.

    A map without a shuffle.  Null and empty texts have none; a null id is passed on; repeated rows are each
    reported; of two rules that match at one place the first in RULES counts; an empty table gives no rows; other
    columns aren't read; texts of any length are scanned whole, in all their layers.
    """

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.Series:
        names = ("rule", "secret", "start", "end", "depth", "layers")
        return texts.map(lambda t: [dict(zip(names, f)) for f in scan_text(t)])

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter(candidate(F.col("text")))
    return narrow.select("doc_id", F.inline(found("text")))


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret's span replaced by [SECRET], and length_col (if there) set to the new length of a changed text.

    Texts without secrets, null and empty ones among them, are as before; the cases of scan_secrets() hold.
    """

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask_text)

    text = F.col("row").getField(text_col)
    work = packed(docs).withColumn("new", F.when(candidate(text), masked(text)).otherwise(text))

    def field(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == text_col:
            return F.col("new").alias(c)
        if c == length_col and docs.schema[c].dataType.simpleString() in ("int", "bigint"):
            return F.when(F.col("new") == text, old).when(text.isNull(), old).otherwise(F.length("new").cast(docs.schema[c].dataType)).alias(c)
        return old.alias(c)

    return work.select(*[field(c) for c in docs.columns])
