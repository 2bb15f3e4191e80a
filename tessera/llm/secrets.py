"""Secret scan: fixed patterns, and strings that compress badly given their surroundings.

The pattern spans are the base. A candidate of the novelty method is a run of key characters with letters and digits
within `REACH` characters after a sensitive word. Its novelty is the growth of a zstandard frame, primed with a
dictionary of usual identifiers, when the candidate joins the text around it: names, paths and repeated values are
cheap there, random keys are not.

A candidate is the whole secret, of any length: its run carries on through further segments (after a dot or tilde, up
to the last that isn't a plain word) and through wrapped lines. It is measured in pieces of `PIECE` characters, as a
long string's letters compress by their frequencies alone; with one piece of at least `rate` bytes a character all of
it is reported as kind `novel`, but for the parts that base spans have.

Edge cases: a very long text is scanned whole, by one task; null and empty texts have no spans; repeated rows are scanned each for itself; an empty table gives an
empty table; other columns are ignored (`redacted` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, release, released, texts

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as no shorter run is left at its start
SENSITIVE = re.compile(r"(?ai:passw|secret|token|key|credential|bearer|private|login)")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16}")  # how one starts
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
SEGMENT = re.compile(r"[.~]([A-Za-z0-9+/_=-]+)")
#: A line of key characters only, after a line break or an escaped one.
LINE = re.compile(r"""(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_=-]+)(?=[ \t]*(?:\r?\n|\\[rn]|["'`,;]|\Z))""")
#: Lines of a wrapped secret, but the last, have so many characters at least.
WRAPPED = 32
#: Characters after a sensitive word, around a candidate, and of a piece that is measured at once.
REACH, AROUND, PIECE = 48, 512, 128
#: Usual identifiers of code and configuration: fixed values.
IDENTIFIERS = " ".join(
    """
    password passwd secret token api_key apikey access_key private_key public_key client_id client_secret username
    user_name login auth authorization bearer credential credentials session cookie config configuration settings
    environment production development staging default example sample placeholder changeme your_key_here database
    connection host localhost port url uri endpoint server service account bucket region version timeout request
    response header content_type application/json text/html https:// http:// www .com .org .net /usr/local/bin
    /home/user/ import from return function class public static void string integer boolean true false null none
    select insert update delete where order_by group_by get set put post patch parse format encode decode encrypt
    decrypt hash md5 sha1 sha256 sha512 base64 utf-8 ascii uuid 0123456789 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 00000000 ffffffff deadbeef lorem ipsum
    """.split()
).encode()
KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind:string,start:int,end:int,value:int>>"


@cache
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the pattern matches, in order."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(text: str, start: int, end: int, whole: tuple[int, int] | None = None) -> float:
    """Bytes a character that the string, a piece of `whole`, adds to the compressed surroundings of `whole`."""
    a, b = whole or (start, end)
    before, after = text[max(0, a - AROUND) : a].encode("utf-8", "replace"), text[b : b + AROUND].encode("utf-8", "replace")
    z = compressor()
    return (len(z.compress(before + after + text[start:end].encode())) - len(z.compress(before + after))) / (end - start)


def _plain(s: str) -> bool:
    """Whether a short string is a word rather than a part of a key."""
    return len(s) < LEAST and s.isalpha() and (s.islower() or s.istitle() or s.isupper())


def secret_end(text: str, start: int) -> int:
    """End of the secret whose run of key characters starts here: with its further segments and lines."""
    end = at = RUN.match(text, start).end()
    while m := SEGMENT.match(text, at):
        at = m.end()
        if not _plain(m[1]):
            end = at
    width = None
    while m := LINE.match(text, end):
        n = len(m[1])
        if n >= WRAPPED and width in (None, n):
            width, end = n, m.end()
            continue
        if n <= (width or end - start) and (width or end - start >= WRAPPED) and not _plain(m[1]):
            end = m.end()
        break
    return end


def _outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of an interval that the others, in order, leave."""
    parts = []
    for x, y in taken:
        if y > start and x < end:
            if x > start:
                parts.append((start, x))
            start = y
    return [*parts, (start, end)] if start < end else parts


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the dots and line breaks at either end."""
    runs = list(RUN.finditer(text, start, end))
    return (runs[0].start(), runs[-1].end()) if runs else (start, start)


def spans(text: str, rate: float = 0.8) -> list[tuple[int, int, int, int]]:
    """Base spans and novel strings, by start, then kind."""
    found = base_spans(text)
    taken = [(a, b) for a, _, b, _ in found]
    seen, whole = set(), (0, 0)
    for m in SENSITIVE.finditer(text):
        at, last = m.end(), m.end() + REACH
        while c := CANDIDATE.search(text, at, last + LEAST):
            a = c.start()
            known = whole[0] <= a < whole[1]
            b = at = whole[1] if known else secret_end(text, a)
            if a in seen:
                continue
            seen.add(a)
            if not known:
                whole = a, b
            # a secret whose pieces have been measured: only the piece of this start is another
            head = min(b, a + PIECE) if known else b
            parts = [(x, y) for x, y in (_trimmed(text, x, y) for x, y in _outside(a, b, taken)) if x < y]
            s = "".join(text[x:y] for x, y in parts)
            if not any(x.isdigit() for x in s) or not any(x.isalpha() for x in s):
                continue
            if any(novelty(text, x, y, (a, b)) >= rate for u, v in parts if v - u >= LEAST for x, y in pieces(u, min(v, head))):
                found += [(x, 3, y, x) for x, y in parts if x not in seen or x == a]
                seen.update(x for x, _ in parts)
    return sorted(found)


def pieces(start: int, end: int):
    """An interval in pieces of PIECE characters; what is left at the end, if short, is measured with those before it."""
    for at in range(start, end, PIECE):
        if end - at >= LEAST:
            yield at, min(end, at + PIECE)
        elif end - LEAST >= start:
            yield max(start, end - PIECE), end


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.8) -> DataFrame:
    """doc_id and its spans (kind, start, end in code points, start of the secret value); one scan, no shuffle."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())]))

    def run(batches):
        for ids, batch in texts(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "value": v} for a, k, b, v in spans(t, rate)] for t in batch]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kinds)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), f"doc_id long, spans {SPANS}")


def joined(found) -> F.Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]", rate: float = 0.8) -> DataFrame:
    """The table with each secret value replaced; a null text stays null."""

    def mask(text):
        if text is None:
            return None
        out, at = [], 0
        for _, _, end, value in spans(text, rate):
            if end > at:
                out += [text[at : max(at, value)], mark]
                at = end
        return "".join(out) + text[at:]

    @F.arrow_udf(T.StringType())
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [pa.array([mask(t) for t in column.slice(at, 256).to_pylist()], pa.string()) for at in range(0, len(column), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        release()

    return docs.withColumn(text_col, masked(F.col(text_col)))
