"""Fuzzy reads: anchor search, CIGAR walks, edit alignments and alignment text.

Anchors are searched with the bit vectors of Myers (1999), edit alignments come from
rows of edit matrices, a batch of reads at a time; each read is a small, independent
piece of work. Pairs of long sequences are aligned within a band, of which every
few rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.dna import cigar_operations, reverse_complement
from helixframe.functions.tables import IUPAC

CELLS = 2_000_000  # of edit matrices that are filled at once


def infix(pattern: str, texts: pd.Series, most: int, codes: bool = False) -> pd.DataFrame:
    """distance, start and end (0-based, inclusive) of a pattern in each text: the first best end, and its farthest start; -1 beyond `most` edits.

    A text may begin and end anywhere (free end gaps in the text). The start is found
    from the end backwards, with the reversed pattern.
    """
    size = texts.str.len().fillna(0).to_numpy(int)
    out = np.full((len(texts), 3), -1)
    for some in _alike(size, size):  # so that one long text doesn't widen all
        out[some] = _infix(pattern, texts.iloc[some], size[some], most, codes)
    return pd.DataFrame(out, columns=["distance", "start", "end"])


def _alike(order: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """The places of rows in groups of like order, of some CELLS padded cells each."""
    rows = np.argsort(order, kind="stable")
    at = 0
    while at < len(rows):
        most = np.maximum.accumulate(cells[rows[at:]] + 1) * np.arange(1, len(rows) - at + 1)
        to = at + max(1, int(np.searchsorted(most, CELLS, "right")))
        yield rows[at:to]
        at = to


def _distances(pattern: str, text: np.ndarray, codes: bool, anchored: bool) -> Iterator[np.ndarray]:
    """For each place of the texts (place, text), the edit distances of the pattern to what ends there.

    The texts' stretches begin anywhere, or with `anchored` where the texts do. A column of
    the edit matrix is held by its steps down, a bit each, in words of 64 places; a
    step along the last place of a word is carried to the next one.
    """
    m, one = len(pattern), np.uint64(1)
    words = -(-m // 64)
    equal = np.zeros((words, 256), np.uint64)
    for k, c in enumerate(pattern):
        for b in (IUPAC.get(c, c) if codes else c) + c:
            equal[k // 64, ord(b)] |= one << np.uint64(k % 64)
    up, down = np.full((words, text.shape[1]), ~np.uint64(0)), np.zeros((words, text.shape[1]), np.uint64)
    score, last = np.full(text.shape[1], m), np.uint64((m - 1) % 64)
    for chars in text:
        plus, minus = np.full(text.shape[1], np.uint64(anchored)), np.zeros(text.shape[1], np.uint64)
        for w in range(words):
            eq, vp, vn = equal[w][chars], up[w], down[w]
            x = eq | vn
            eq |= minus
            h = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(h | vp), vp & h
            if w == words - 1:
                score = score + ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64)
            hp, hn, plus, minus = hp << one | plus, hn << one | minus, hp >> np.uint64(63), hn >> np.uint64(63)
            up[w], down[w] = hn | ~(x | hp), hp & x
        yield score


def _infix(pattern: str, texts: pd.Series, size: np.ndarray, most: int, codes: bool) -> np.ndarray:
    n, m = len(texts), len(pattern)
    raw = np.zeros((n, int(size.max()) if n else 0), np.uint8)
    raw[np.arange(raw.shape[1]) < size[:, None]] = np.frombuffer("".join(t or "" for t in texts.where(texts.notna(), None)).encode("ascii", "replace"), np.uint8)
    best, end = np.full(n, m), np.full(n, -1)
    if m:
        for j, score in enumerate(_distances(pattern, np.ascontiguousarray(raw.T), codes, False)):
            better = (j < size) & (score < best)
            best[better], end[better] = score[better], j
    found = np.flatnonzero((best <= most) & (end >= 0))
    start = np.where(best <= most, end + 1, -1)  # an empty stretch
    if len(found):
        reach = int(min(m + best[found].max(), end[found].max() + 1))
        at = end[found] - np.arange(reach)[:, None]
        back = np.where(at >= 0, raw[found, np.maximum(at, 0)], 0)
        start[found] = np.where(best[found] == m, end[found] + 1, start[found])
        for j, score in enumerate(_distances(pattern[::-1], back, codes, True)):
            here = (score == best[found]) & (at[j] >= 0)
            start[found[here]] = at[j][here]
    far = best > most
    return np.stack([np.where(far, -1, best), np.where(far, -1, start), np.where(far, -1, end)], axis=1)


def find_anchor(c: Column, pattern: str, most: int, codes: bool = False) -> Column:
    """struct(distance, start, end) of a pattern in a string column."""

    def run(s: pd.Series) -> pd.DataFrame:
        return infix(pattern, s, most, codes)

    return F.pandas_udf(run, "distance int, start int, end int")(c)


def anchored_windows(reads: DataFrame, seq: str, qual: str, left: str, right: str, window: int, most: int = 16) -> DataFrame:
    """reads with strand, status, window and window_qual.

    The window follows the left anchor, found on either strand; the right anchor
    must stand in the stretch of its own length behind the window. status: direct,
    no_left_anchor, short_window or indel_in_right_window.
    """
    rows = reads.withColumn("__f", find_anchor(F.col(seq), left, most)).withColumn("__rc", reverse_complement(F.col(seq), "keep"))
    rows = rows.withColumn("__r", find_anchor(F.col("__rc"), left, most))
    forward = F.col("__f.distance") >= 0
    found = forward | (F.col("__r.distance") >= 0)
    oriented = F.when(forward | ~found, F.col(seq)).otherwise(F.col("__rc"))
    flipped = F.when(forward | ~found, F.col(qual)).otherwise(F.reverse(qual))
    begin = F.when(forward, F.col("__f.end")).otherwise(F.col("__r.end")) + 2  # 1-based, behind the anchor
    rows = rows.withColumns({"strand": F.when(forward, "+").when(found, "-").otherwise("?"), "__s": oriented, "__q": flipped, "__b": begin})
    rows = rows.withColumns({"window": F.when(found, F.substr("__s", F.col("__b"), F.lit(window))), "window_qual": F.when(found, F.substr("__q", F.col("__b"), F.lit(window))), "__next": F.coalesce(F.substr("__s", F.col("__b") + window, F.lit(len(right))), F.lit(""))})
    rows = rows.withColumn("__a", find_anchor(F.col("__next"), right, most))
    status = F.when(~found, "no_left_anchor").when(F.length("window") < window, "short_window").when(F.col("__a.distance") < 0, "indel_in_right_window").otherwise("direct")
    return rows.withColumn("status", status).drop("__f", "__r", "__rc", "__s", "__q", "__b", "__next", "__a")


_LIKE = np.eye(128, dtype=bool)
_LIKE[127, 127] = False  # stands for all characters beyond, which are compared themselves
_LIKE_CODES = _LIKE.copy()
for _code, _bases in IUPAC.items():
    for _base in _bases:
        _LIKE_CODES[ord(_code), ord(_base)] = True


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) code points, 0 beyond the end, and the lengths."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return out, size


def edit_alignments(a: list[str], b: list[str], codes: bool = False) -> list[tuple[int, str, str, str]]:
    """(distance, top, marks, bottom) of global alignments; back from the end a diagonal goes before a deletion before an insertion.

    One row of all edit matrices at a time, and one step back of all pairs at a time; a
    pair of more than CELLS cells by itself, within a band.
    """
    out: list = [None] * len(a)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    cells = (sizes[:, 0] + 1) * (sizes[:, 1] + 1)
    for k in np.flatnonzero(cells > CELLS).tolist():
        out[k] = banded_alignment(a[k], b[k], codes)
    short = np.flatnonzero(cells <= CELLS)
    for some in _alike(sizes[short].sum(1), cells[short]):
        some = short[some]
        for k, x in zip(some, _alignments([a[k] for k in some], [b[k] for k in some], codes), strict=True):
            out[k] = x
    return out


def edit_alignment(a: str, b: str) -> tuple[int, str, str, str]:
    """The alignment of edit_alignments for one pair, without arrays of it.

    Whole columns of the edit matrix are bits of two numbers (Myers 1999): where a step down
    costs one, and where a step across costs nothing. The way back reads them.
    """
    m, n = len(a), len(b)
    if (m + 1) * (n + 1) > CELLS:
        return banded_alignment(a, b)
    full, equal = (1 << m) - 1, {}
    for k, c in enumerate(a):
        equal[c] = equal.get(c, 0) | 1 << k
    up, down, columns = full, 0, []
    for c in b:
        eq = equal.get(c, 0)
        free = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(free | up)), up & free
        more, less = more << 1 | 1, less << 1
        up, down = full & (less | ~(free | more)), full & more & free
        columns.append((free, up))
    i, j, distance = m, n, 0
    top, marks, bottom = [], [], []
    while i or j:
        fits = i and j and a[i - 1] == b[j - 1]
        free, steps = columns[j - 1] if j else (0, full)
        if fits or (i and j and not free >> (i - 1) & 1):
            i, j = i - 1, j - 1
            top.append(a[i])
            marks.append("|" if fits else ".")
            bottom.append(b[j])
            distance += not fits
            continue
        distance += 1
        marks.append(" ")
        if i and steps >> (i - 1) & 1:
            i -= 1
            top.append(a[i])
            bottom.append("-")
        else:
            j -= 1
            top.append("-")
            bottom.append(b[j])
    return distance, "".join(reversed(top)), "".join(reversed(marks)), "".join(reversed(bottom))


class _Band:
    """Rows of the edit matrix of x and y within `width` of its diagonal: place o of row i is column i + o - width."""

    def __init__(self, x: np.ndarray, y: np.ndarray, width: int, codes: bool) -> None:
        self.x, self.width, self.n = x, width, len(y)
        self.like = _LIKE_CODES if codes else _LIKE
        self.y = np.concatenate([np.zeros(width, np.uint32), y, np.zeros(len(x) + width + 1, np.uint32)])
        self.low = np.minimum(self.y, 127)
        self.ramp = np.arange(2 * width + 1, dtype=np.int32)

    def first(self) -> np.ndarray:
        return np.where(self.ramp >= self.width, self.ramp - self.width, 1 << 29).astype(np.int32)

    def same(self, i: int) -> np.ndarray:
        """Whether x[i - 1] fits what each column of row i stands behind."""
        c = self.x[i - 1]
        part = slice(i - 1, i + 2 * self.width)
        return (self.y[part] == c) | self.like[min(int(c), 127)][self.low[part]]

    def next(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i from the one above."""
        new = row + ~self.same(i)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new = np.minimum.accumulate(new - self.ramp) + self.ramp  # insertions run along the row
        if i <= self.width:
            new[: self.width - i] = 1 << 29  # before the first column
        return new.astype(np.int32)


def banded_alignment(a: str, b: str, codes: bool = False) -> tuple[int, str, str, str]:
    """The alignment of edit_alignments for a pair of long sequences.

    All optimal paths stay within the distance of the diagonal, so that a band at least
    as wide holds them all; it doubles until it does. One row in some sqrt(rows) is
    kept, and the rows between two of them are made again on the way back: memory is the
    band times that root.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    m, n = len(x), len(y)
    every, width = max(1, int(m**0.5)), max(64, abs(m - n))
    while True:
        band = _Band(x, y, width, codes)
        row, kept = band.first(), []
        for i in range(m + 1):
            if i:
                row = band.next(row, i)
            if i % every == 0:
                kept.append(row)
        distance = int(row[n - m + width])
        if distance <= width:
            break
        width = min(2 * width, max(m, n))
    i, j, top, marks, bottom = m, n, [], [], []
    while i or j:
        begin = (max(i - 1, 0) // every) * every
        rows = [kept[begin // every]]
        for k in range(begin + 1, i + 1):
            rows.append(band.next(rows[-1], k))
        while i > begin or (not i and j):
            here, o = rows[i - begin][j - i + width], j - i + width
            above = rows[i - begin - 1] if i else None
            fits = bool(i and j) and (x[i - 1] == y[j - 1] or bool(band.like[min(int(x[i - 1]), 127), min(int(y[j - 1]), 127)]))
            if i and j and here == above[o] + (not fits):
                step = (a[i - 1], "|" if fits else ".", b[j - 1])
                i, j = i - 1, j - 1
            elif i and o + 1 < len(above) and here == above[o + 1] + 1:
                step = (a[i - 1], " ", "-")
                i -= 1
            else:
                step = ("-", " ", b[j - 1])
                j -= 1
            for line, c in zip((top, marks, bottom), step, strict=True):
                line.append(c)
    return distance, *("".join(reversed(line)) for line in (top, marks, bottom))


def _alignments(a: list[str], b: list[str], codes: bool) -> Iterator[tuple[int, str, str, str]]:
    (x, m), (y, n) = _padded(a), _padded(b)
    like = _LIKE_CODES if codes else _LIKE
    x_, y_ = np.minimum(x, 127), np.minimum(y, 127)
    ramp = np.arange(y.shape[1] + 1, dtype=np.int32)
    d = np.empty((len(a), x.shape[1] + 1, len(ramp)), np.int32)
    d[:, 0] = ramp
    for i in range(x.shape[1]):
        same = (x[:, i, None] == y) | like[x_[:, i, None], y_]
        row = d[:, i + 1]
        row[:, 0] = i + 1
        row[:, 1:] = np.minimum(d[:, i, :-1] + ~same, d[:, i, 1:] + 1)
        row[:] = np.minimum.accumulate(row - ramp, axis=1) + ramp  # insertions run along the row
    each, i, j = np.arange(len(a)), m.copy(), n.copy()
    steps = []
    while (live := (i > 0) | (j > 0)).any():
        up, back = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        p, q, here = x[each, up], y[each, back], d[each, i, j]
        same = (p == q) | like[np.minimum(p, 127), np.minimum(q, 127)]
        across = live & (i > 0) & (j > 0) & (here == d[each, up, back] + ~same)
        gone = live & ~across & (i > 0) & (here == d[each, up, j] + 1)
        came = live & ~across & ~gone
        steps.append((np.where(across | gone, p, np.where(came, ord("-"), 0)), np.where(across, np.where(same, ord("|"), ord(".")), np.where(live, ord(" "), 0)), np.where(across | came, q, np.where(gone, ord("-"), 0))))
        i, j = i - (across | gone), j - (across | came)
    lines = [np.array([s[k] for s in reversed(steps)], np.uint32).reshape(-1, len(a)).T for k in range(3)]
    for k in range(len(a)):
        said = [line[k][line[k] > 0].astype("<u4").tobytes().decode("utf-32-le") for line in lines]
        yield int(d[k, m[k], n[k]]), *said


def aligned(df: DataFrame, a: str, b: str, codes: bool = False) -> DataFrame:
    """df with distance, top, marks, bottom of the alignment of two string columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(edit_alignments(x.fillna("").tolist(), y.fillna("").tolist(), codes), columns=["distance", "top", "marks", "bottom"])

    return df.withColumn("__x", F.pandas_udf(run, "distance int, top string, marks string, bottom string")(a, b)).select("*", "__x.*").drop("__x")


def rescued(df: DataFrame, seq: str, reference: str, first: int, last: int, most: int = 32) -> DataFrame:
    """df with `rescued`: the bases under reference positions first..last (1-based), or NULL where an indel touches the motif or there are too many edits."""

    def cut(distance: int, top: str, bottom: str) -> str | None:
        if distance > most:
            return None
        out, at = [], 0
        for x, y in zip(top, bottom, strict=True):
            if x != "-":
                at += 1
                if first <= at <= last:
                    if y == "-":
                        return None
                    out.append(y)
            elif first - 1 <= at <= last:
                return None
        return "".join(out)

    def run(reads: pd.Series) -> pd.Series:
        texts = reads.fillna("").tolist()
        found = edit_alignments([reference] * len(texts), texts, True)
        return pd.Series([cut(distance, top, bottom) if text else None for text, (distance, top, _, bottom) in zip(texts, found, strict=True)], dtype=object)

    return df.withColumn("rescued", F.pandas_udf(run, "string")(seq))


def observed_bases(alignments: DataFrame, pos: str = "pos", cigar: str = "cigar", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One row for each reference position that an alignment covers: ref_pos, base (- for a deletion), q (99 where the qualities are `*`).

    M, = and X consume both; I and S the read; D and N the reference; H and P
    nothing: running sums over the operations place each of them.
    """
    reference, read = F.array(*map(F.lit, "M=XDN")), F.array(*map(F.lit, "M=XIS"))

    def place(acc: Column, op: Column) -> Column:
        r, q = F.array_contains(reference, op["op"]), F.array_contains(read, op["op"])
        step = F.struct(acc["r"].alias("r"), acc["q"].alias("q"), op["n"].alias("n"), q.alias("has_base"))
        return F.struct(
            (acc["r"] + F.when(r, op["n"]).otherwise(0)).alias("r"), (acc["q"] + F.when(q, op["n"]).otherwise(0)).alias("q"), F.when(r, F.array_append(acc["out"], step)).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.col(pos).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int,has_base:boolean>>").alias("out"))
    spans = F.aggregate(cigar_operations(F.col(cigar)), start, place, lambda a: a["out"])
    each = alignments.withColumn("__s", F.explode(spans)).filter("__s.n > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__s.n") - 1)))
    at = F.col("__s.q") + F.col("__i") + 1
    base = F.when(F.col("__s.has_base"), F.substr(F.col(seq), at, F.lit(1))).otherwise("-")
    q = F.when(~F.col("__s.has_base"), 0).when(F.col(qual) == "*", 99).otherwise(F.ascii(F.substr(F.col(qual), at, F.lit(1))) - 33)
    return each.withColumns({"ref_pos": F.col("__s.r") + F.col("__i"), "base": base, "q": q}).drop("__s", "__i")


def equalities(spark: SparkSession) -> DataFrame:
    """code, base: which bases each ambiguity code stands for."""
    rows = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(base).alias("base")) for code, bases in IUPAC.items() for base in bases))
    return spark.range(1).select(F.inline(rows))


def usable_alignments(df: DataFrame, flag: str = "flag", name: str = "qname", order: str = "pos") -> DataFrame:
    """Mapped primary alignments, the first of each read: no 0x4, 0x100 or 0x800 in the flag."""
    kept = df.filter(F.col(flag).cast("int").bitwiseAND(0x904) == 0)
    return kept.groupBy(name).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__r")).select("__r.*")


def alignment_blocks(df: DataFrame, width: int = 60, top: str = "top", marks: str = "marks", bottom: str = "bottom") -> DataFrame:
    """df with block, line_top, line_marks, line_bottom, end_top, end_bottom: alignment text in blocks with running ungapped coordinates."""
    n = F.greatest(F.lit(1), F.ceil(F.length(top) / width)).cast("int")
    rows = df.withColumn("block", F.explode(F.sequence(F.lit(1), n)))
    at = (F.col("block") - 1) * width + 1
    cut = lambda c: F.substr(F.col(c), at, F.lit(width))
    until = lambda c: F.length(F.replace(F.substr(F.col(c), F.lit(1), F.col("block") * width), F.lit("-"), F.lit("")))
    return rows.withColumns({"line_top": cut(top), "line_marks": cut(marks), "line_bottom": cut(bottom), "end_top": until(top), "end_bottom": until(bottom)})

