"""Secrets in whole texts.

An Aho-Corasick automaton finds keywords, regular expressions are tried only where one was found, and credentials that carry
a checksum are kept only if it holds. Long runs of hex digits have no keyword and are found by their own expression.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive, ordered by start and then by kind.
Equal texts have equal spans; other columns are kept, those named like a result are replaced.
"""
import base64
import binascii
import functools
import itertools
import json
import re
import zlib

from pyspark.sql import DataFrame, functions as F

from curbloop.llm.batches import mapped

#: Kinds in the order they are listed in; the first three are the base kinds.
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "private_key"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{16,})")
KEY = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]{64,}?)-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_checksum(body: str) -> str:
    """CRC-32 of a token's body in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _unpadded(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _is_jwt(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(_unpadded(m[1])) and isinstance(json.loads(_unpadded(m[2])), dict)
    except (ValueError, binascii.Error):
        return False


def _is_key(m: re.Match) -> bool:
    """The body is base64 of a DER sequence whose length field agrees with its size."""
    try:
        der = base64.b64decode("".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return m[1].startswith("OPENSSH") and der.startswith(b"openssh-key-v1\0")
    wide = der[1] & 0x7F if der[1] & 0x80 else 0
    return len(der) == 2 + wide + (int.from_bytes(der[2:2 + wide], "big") if wide else der[1])


#: Kind -> (keywords, expression that starts at the keyword, what a match must satisfy).
RULES = {
    "assign": (["pass", "secr", "toke", "apik", "api_"], ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (["AKIA"], ACCESS, lambda m: len(m[0]) >= 18),
    "github": (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], GITHUB, lambda m: base62_checksum(m[1]) == m[2]),
    "npm": (["npm_"], NPM, lambda m: base62_checksum(m[1]) == m[2]),
    "jwt": (["eyJ"], JWT, _is_jwt),
    "private_key": (["-----BEGIN "], KEY, _is_key),
}


@functools.cache
def automaton():
    """Keywords of all kinds; those of ``assign`` in upper and lower case."""
    import ahocorasick
    found: dict[str, list[str]] = {}
    for kind, (words, _, _) in RULES.items():
        for word in words:
            cases = [{c.lower(), c.upper()} for c in word] if kind == "assign" else [{c} for c in word]
            for form in itertools.product(*cases):
                found.setdefault("".join(form), []).append(kind)
    a = ahocorasick.Automaton()
    for word, kinds in found.items():
        a.add_word(word, (len(word), kinds))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind). Within a kind they are leftmost and do not overlap; a match that fails its test still uses up
    its characters, as if all matches were found first and tested after."""
    spans, free = [], {}
    for last, (length, kinds) in automaton().iter(text):
        start = last - length + 1
        for kind in kinds:
            if start >= free.get(kind, 0) and (m := RULES[kind][1].match(text, start)):
                free[kind] = m.end()
                if RULES[kind][2](m):
                    spans.append((start, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "array<struct<start:long,end:long,kind:string>>"


def find_secrets(docs: DataFrame, text="text", redact: str | None = None) -> DataFrame:
    """Add ``secrets``, the spans of each row. With ``redact`` the text is given back with every span replaced by it."""
    import pyarrow as pa
    kept = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(*kept)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def find(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = [scan(t) if t else [] for t in texts]
            columns = {c: batch.column(c) for c in kept}
            if redact is not None:
                columns[text] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, spans)], pa.string())
            columns["secrets"] = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], arrow)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mapped(rows, find, rows.withColumn("secrets", F.lit(None).cast(SPANS)).schema)


def redacted(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]
