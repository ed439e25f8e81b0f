"""Secret scan: keyword automaton first, anchored patterns near its hits, checksums last.

Base kinds, leftmost and not overlapping within a kind (spans are the whole
match, in code points, end exclusive):

* assign: a keyword, an assignment sign and a value of 6 characters or more;
* access: `AKIA` and capitals or digits, 20 characters or more;
* hex: a run of 0-9a-f of 24 characters or more.

Kinds that the method adds, each only with a valid embedded checksum:

* github: `gh[pousr]_` and 36 letters or digits, the last six being the CRC-32
  of the 30 before in base 62; npm: `npm_` likewise;
* wallet: base58check extended private keys (`xprv`, double SHA-256 checksum);
* card: 13 to 19 digits after a payment keyword, with a valid Luhn digit.

A null or empty text has no spans. Letters of keywords match in either case for
a-z only. Rows are independent: repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lower_ascii, map_arrow

#: Keyword -> kind, in lower case.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "xprv": "wallet", "card": "card", "visa": "card", "pan:": "card",
}
KINDS = ("assign", "access", "hex", "github", "npm", "wallet", "card")
BASE = KINDS[:3]
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "wallet": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?:card|visa|pan:)[^0-9\n]{0,24}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII | re.IGNORECASE),
}
HEX_LEAST = 24
HEX_RUN = re.compile(r"[0-9a-f]+")
HEX_PROBE = re.compile(r"[0-9a-f]")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def crc62(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those after the prefix."""
    body, value, digits = token[4:-6], zlib.crc32(token[4:-6].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return bool(body) and digits.rjust(6, "0") == token[-6:]


def base58check(token: str) -> bool:
    value = 0
    for letter in token:
        value = value * 58 + BASE58.index(letter)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def luhn(digits: str) -> bool:
    numbers = [int(d) for d in digits if d.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in numbers[-2::-2]]
    return 13 <= len(numbers) <= 19 and (sum(doubled) + sum(numbers[-1::-2])) % 10 == 0 and any(numbers)


VALID = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: crc62(m[0]),
    "npm": lambda m: crc62(m[0]),
    "wallet": lambda m: base58check(m[0]),
    "card": lambda m: luhn(m[1]),
}


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal hexadecimal runs of 24 or more: each covers a multiple of 24, so only those places are looked at."""
    spans, covered = [], 0
    for probe in HEX_PROBE.finditer(text[::HEX_LEAST]):
        place = probe.start() * HEX_LEAST
        if place < covered:
            continue
        start = place
        while start > covered and text[start - 1] in "0123456789abcdef":
            start -= 1
        covered = HEX_RUN.match(text, place).end()
        if covered - start >= HEX_LEAST:
            spans.append((start, covered))
    return spans


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), by start and then kind."""
    if not text:
        return []
    spans = [("hex", *span) for span in hex_spans(text)]
    ended: dict[str, int] = {}
    for last, (size, kind) in automaton().iter(lower_ascii(text)):
        start = last - size + 1
        if start < ended.get(kind, 0):
            continue
        match = PATTERNS[kind].match(text, start)
        # Of two keywords at one place (none is a prefix of another here) each is tried.
        if match:
            ended[kind] = match.end()
            if VALID[kind](match):
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """`docs` with an array of (kind, start, end) in the column `spans` (replaced if it is there)."""
    docs = docs.drop(spans)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(text.as_py())] for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(SPAN), True)]))
