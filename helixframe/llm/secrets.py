"""Secret scan: fixed patterns, and guess costs of values that stand in a credential context.

Three patterns give the base spans, leftmost and non-overlapping for each kind:
`assign` (a credential name, a sign and a value of at least 6 characters),
`access` (AKIA and on, at least 20) and `hex` (at least 24 digits of lower case).

On top of them, every value behind a credential name - of more names than
`assign` knows - is judged by dynamic programming: the least number of guesses
over all ways to cut it into dictionary words, dates, repeats of a unit of up to
LONGEST characters, keyboard walks and brute-force spans. A value that costs at least 10**STRONG guesses gives a
span `guess` of the value alone. A quoted value ends at its closing quote on
the same line, any other at white space, a quote, a comma, a bracket, a
semicolon or the next field of a query string. A quoted value with blanks is
strong if one of its words is, or, behind `passphrase`, as a whole.

The dictionary is the fixed list below and the words of public tokenizers'
vocabularies, whose order is that of their frequency (`word_ranks`; the files are a
parameter). It doesn't depend on the table: what is a secret in one table is one in
every other.

Defined results: a null text counts as empty; an empty text has no spans; each
of equal rows has the same result; an empty table gives an empty result; other
columns pass through `redacted` and are not read by `spans`. Offsets are in
code points. Batches follow Spark's Arrow limits, so memory doesn't grow with
the table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from math import log10
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import small, table, utf8

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CONTEXT = re.compile(
    rb"(password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth)[\"']?\x20*[:=]\x20*"
    rb"(?:\"([^\"\\\n]*(?:\\.[^\"\\\n]*)*)\"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|[\"']?((?:[!#$%*+./0-9:=?@A-Z\\^_a-z|~-]|&(?!amp;|[\w.%-]+=))+))",
    re.I,
)
#: One of these stands in every text that ASSIGN or CONTEXT matches (lower case).
HINTS = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"api", b"_key", b"sskey", b"tekey", b"credential", b"auth")
#: Decimal logarithm of the guesses from which a value counts as a secret.
STRONG = 8.0
LONGEST = 24  # bytes
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")  # English, and many languages

# Frequent passwords and words, most frequent first; a word's rank is its cost.
WORDS = (
    "password 123456 qwerty letmein admin welcome login master secret dragon monkey shadow sunshine princess football baseball "
    "iloveyou trustno1 superman batman access hello charlie test guest root user pass default changeme temp demo server system "
    "public private token key api data the and for you that with this have from your what some time will there their about would "
    "which could other people into just over know take year good work first well even want because these give most love home "
    "house water light green blue black white red summer winter spring autumn monday friday january april june july august "
    "september october november december city world music computer internet windows office account money family friend "
    "tiger eagle lion wolf bear horse star moon sun river ocean mountain flower coffee pizza apple orange banana cherry"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_RANK = {w: log10(k + 1.0) for k, w in enumerate(WORDS)}
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLAIN = str.maketrans({"4": "a", "@": "a", "3": "e", "0": "o", "1": "i", "$": "s", "5": "s", "7": "t"})
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
# Year; year and month; year, month and day; day, month and year.
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_DATES = tuple((re.compile("[-/.]?".join(x), re.A), log10(c)) for x, c in (((_YEAR,), 120), ((_YEAR, _MONTH), 120 * 12), ((_YEAR, _MONTH, _DAY), 120 * 365), ((_DAY, _MONTH, _YEAR), 120 * 365)))
_KEYS = 2.0 * sum(map(len, ROWS))
_JOIN = log10(2)  # what each further segment multiplies the guesses by


def _values(text: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
    """(name, start, end, quoted) of each value behind a credential name."""
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        end = m.end(k) if k < 4 else m.start(k) + len(m[k].rstrip(b"."))
        yield m[1], m.start(k), end, k < 4


def _has_hint(text: bytes) -> bool:
    low = text.lower()
    return any(x in low for x in HINTS)


def word_ranks(paths: Sequence[str] | None = None) -> dict[str, float]:
    """Decimal logarithms of the words' ranks: their places among the words of each vocabulary file, and in the fixed list.

    A word is a token that begins with a space and goes on with letters alone, of 3 to LONGEST bytes. A file
    has a line a token in the order of ranks, the token in base 64 first.
    """
    ranks = dict(_RANK)
    for path in paths or map(public_tokenizers.path, VOCABULARIES):
        found: dict[bytes, None] = {}
        for line in Path(path).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0])
            word = token[1:].translate(_LETTERS)
            if token.startswith(b" ") and 3 <= len(word) <= LONGEST and b" " not in word:
                found.setdefault(word)
        for k, word in enumerate(found, 1):
            text = word.decode("utf-8", "ignore")
            if text.encode() == word:
                ranks[text] = min(log10(k + 1.0), ranks.get(text, 99.0))
    return ranks


def _each(value: str) -> float:
    """Decimal logarithm of the characters that a brute-force span of the value draws from."""
    kinds = (any("a" <= c <= "z" for c in value) * 26) + (any("A" <= c <= "Z" for c in value) * 26) + (any("0" <= c <= "9" for c in value) * 10)
    return log10(max(10, kinds + 33 * any(not c.isalnum() for c in value)))


def _least(starts: list[int], best: list[float], i: int, unit: int) -> float:
    """The least best[j] + log10((i - j) / unit) over the starts.

    The later of two starts gains on the earlier one less and less, so that a
    start that an earlier one beats is beaten from then on, and goes for good.
    """
    least, keep = float("inf"), []
    for j in starts:
        c = best[j] + log10((i - j) / unit)
        if c < least:
            least = c
            keep.append(j)
    starts[:] = keep
    return least


def guess_cost(value: str, rank: dict[str, float] = _RANK, repeats: bool = True) -> float:
    """Decimal logarithm of the least guesses over all segmentations.

    Segments: brute force; a date; three keys or more, each beside the one
    before; a word, as it is, in other case or with digits and signs for letters;
    a unit of up to LONGEST characters two times or more, which costs as the unit
    alone would (without repeats in it) and the number of times.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(_PLAIN)
    each = _each(value)
    dates: dict[int, list[tuple[int, float]]] = {}
    for at in range(n):
        if value[at].isdigit():
            for pattern, c in _DATES:
                if m := pattern.match(value, at):
                    dates.setdefault(m.end(), []).append((at, c))
    best = [0.0] * (n + 1)
    forced = [0.0] * (n + 1)  # least cost with a brute-force span at the end
    join = lambda j: _JOIN if j else 0.0
    first: list[float] = [0.0] * (n + 1)  # best[j] and the join that a segment from j on pays
    walk, walks = 0, []  # where the current walk began, and where in it a segment may start
    same = [0] * (LONGEST + 1)  # for each period how many characters equal the one a period before
    begun: dict[tuple[int, int], list[int]] = {}  # by period and phase
    units: dict[str, float] = {}
    for i in range(1, n + 1):
        forced[i] = min(forced[i - 1] if i > 1 else 0.0, first[i - 1]) + each
        least = forced[i]
        if i > 1 and low[i - 2 : i] not in _NEXT:
            walk, walks = i - 1, []
        if i - walk >= 3:
            walks.append(i - 3)
            least = min(least, log10(_KEYS) + _least(walks, first, i, 1))
        for period in range(1, min(LONGEST, i - 1) + 1) if repeats else ():
            if value[i - 1] != value[i - 1 - period]:
                if same[period] >= period:
                    for phase in range(period):
                        begun.pop((period, phase), None)
                same[period] = 0
                continue
            same[period] += 1
            if same[period] >= period:
                starts = begun.setdefault((period, i % period), [])
                starts.append(i - 2 * period)
                unit = value[i - period : i]
                if unit not in units:
                    units[unit] = guess_cost(unit, rank, False)
                least = min(least, units[unit] + _least(starts, first, i, period))
        for at, c in dates.get(i, ()):
            least = min(least, first[at] + c)
        for at in range(max(0, i - LONGEST), i - 2):
            if (c := rank.get(low[at:i])) is None and (c := rank.get(plain[at:i])) is not None:
                c += _JOIN
            if c is not None:
                least = min(least, first[at] + c + (0.0 if value[at:i] == low[at:i] else _JOIN))
        best[i] = least
        first[i] = least + join(i)
    return best[n]


def _strong(name: bytes, value: str, quoted: bool, rank: dict[str, float]) -> bool:
    parts = value.split() if quoted and name.lower() != b"passphrase" else [value]
    return any(len(x) >= 6 and guess_cost(x, rank) >= STRONG for x in parts)


def find(text: bytes, rank: dict[str, float] = _RANK) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans by start, then kind; offsets in code points."""
    found = []
    if _has_hint(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        found += [(start, 3, end) for name, start, end, quoted in _values(text) if _strong(name, text[start:end].decode("utf-8"), quoted, rank)]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if found and not text.isascii():
        at, chars, where = 0, 0, {}
        for x in sorted({x for start, _, end in found for x in (start, end)}):
            chars += len(text[at:x].decode("utf-8"))
            at, where[x] = x, chars
        found = [(where[start], kind, where[end]) for start, kind, end in found]
    return sorted(found)


def spans(docs: DataFrame, rank: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess: one row a document."""
    rank = docs.sparkSession.sparkContext.broadcast(rank or word_ranks())
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole)):
            rows = []
            for text in utf8(batch.column("text")):
                got = find(text or b"", rank.value)
                said = [f"{KINDS[kind]}:{start}:{end}" for start, kind, end in got]
                count = [sum(kind == k for _, kind, _ in got) for k in range(4)]
                base = ",".join(x for x, (_, kind, _) in zip(said, got, strict=True) if kind < 3)
                rows.append((*count[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), count[3]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, schema)


def redact(text: str | None, rank: dict[str, float] = _RANK) -> str | None:
    """text with each span, overlapping ones together, put as [SECRET]."""
    if not text or not (found := find(text.encode("utf-8"), rank)):
        return text
    out, at = [], 0
    for start, _, end in found:
        if end > at:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, rank: dict[str, float] | None = None) -> DataFrame:
    """docs with the secrets in `text` replaced; all columns stay."""
    rank = docs.sparkSession.sparkContext.broadcast(rank or word_ranks())

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole)):
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array([redact(x, rank.value) for x in batch.column(k).to_pylist()], batch.schema.field(k).type))

    return docs.mapInArrow(cleaned, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
