"""Column expressions on sequences: strands, canonical form, read quality, tag hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enzymes import Enzyme, enzyme


def revcomp(seq: Column | str) -> Column:
    """The other strand; bases other than A, C, G, T in either case stay (N is its own complement)."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def canonical(seq: Column | str) -> Column:
    """The lexicographically smaller of a sequence and its other strand."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.least(c, revcomp(c))


def all_windows(seq: Column | str, key: str | int | Enzyme) -> Column:
    """Array of the windows at every offset where the site lies on either strand, overlaps included, by ascending offset."""
    return F.regexp_extract_all(seq, F.lit(f"(?=({enzyme(key).either}))"), F.lit(1))


def windows_of_both(seq: Column | str, key: str | int | Enzyme) -> Column:
    """The windows of :func:`all_windows`, those of the forward strand first: faster, where their order does not matter."""
    e = enzyme(key)
    forward, *turned = (F.regexp_extract_all(seq, F.lit(r), F.lit(1)) for r in e.anchored)
    # A window that reads as the site on both strands is one window.
    return F.concat(forward, F.filter(turned[0], lambda w: ~w.rlike(f"^{e.forward}$"))) if turned else forward


def first_window(seq: Column | str, key: str | int | Enzyme) -> Column:
    """The leftmost window on the forward strand, else the leftmost on the reverse strand, else null."""
    e = enzyme(key)
    return F.coalesce(*[F.nullif(F.regexp_extract(seq, r, 0), F.lit("")) for r in dict.fromkeys((e.forward, e.reverse))])


@dataclass(frozen=True)
class ReadQuality:
    """Read filter: at most ``max_n`` N bases (a share if between 0 and 1, else a number), at least ``min_percent`` percent of the bases of quality ``min_quality``."""

    enabled: bool = True
    max_n: float = 0.08
    min_quality: int = 30
    min_percent: int = 80
    offset: int = 33

    def few_n(self, seq: Column | str) -> Column:
        """Counts upper-case N. An empty read fails a share."""
        if not self.enabled:
            return F.lit(True)
        c = F.col(seq) if isinstance(seq, str) else seq
        n = F.length(c) - F.length(F.replace(c, F.lit("N"), F.lit("")))
        if 0 < self.max_n < 1:
            return F.coalesce(F.try_divide(n.cast("double"), F.length(c).cast("double")) <= self.max_n, F.lit(False))
        return n <= self.max_n

    def good_quality(self, qual: Column | str) -> Column:
        """Whole percent of bases of the least quality; a read without qualities passes."""
        if not self.enabled:
            return F.lit(True)
        c = F.col(qual) if isinstance(qual, str) else qual
        low = min(max(self.min_quality + self.offset, 0), 126)
        good = F.length(F.regexp_replace(c, rf"[^\x{low:02x}-\x7e]", ""))
        percent = F.floor(F.try_divide(good * 100, F.length(c)))
        return F.when(c.isNull() | (F.length(c) == 0), F.lit(True)).otherwise(percent >= self.min_percent)


_MULTIPLIER = np.uint64(0x517CC1B727220A95)  # fixed value of the hash


def hash_bytes(tags: np.ndarray) -> np.ndarray:
    """64-bit hashes of equally long tags given as rows of bytes: words of 8, then 4, then single bytes are rotated, mixed and multiplied in."""
    h = np.zeros(len(tags), dtype=np.uint64)
    at, length = 0, tags.shape[1]
    for width, kind in ((8, "<u8"), (4, "<u4"), (1, "u1")):
        while length - at >= width:
            word = np.ascontiguousarray(tags[:, at : at + width]).view(kind).ravel().astype(np.uint64)
            h = (((h << np.uint64(5)) | (h >> np.uint64(59))) ^ word) * _MULTIPLIER
            at += width
            if width == 4:
                break
    return h


@F.pandas_udf(T.LongType())
def tag_hash(tags: pd.Series) -> pd.Series:
    """Hash of canonical tags as signed 64-bit values; null for null."""
    out = pd.Series(pd.array([pd.NA] * len(tags), dtype="Int64"))
    tags = tags.reset_index(drop=True)
    lengths = tags.str.len()
    for n in lengths.dropna().unique():
        at = np.flatnonzero((lengths == n).to_numpy())
        raw = "".join(tags.iloc[at]).encode("latin-1", "replace")
        block = np.frombuffer(raw, dtype=np.uint8).reshape(len(at), int(n)) if n else np.zeros((len(at), 0), dtype=np.uint8)
        out.iloc[at] = hash_bytes(block).view(np.int64)
    return out


def unsigned(h: Column | str) -> Column:
    """A 64-bit hash as the unsigned number it stands for."""
    c = F.col(h) if isinstance(h, str) else h
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def hash_hex(h: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")
