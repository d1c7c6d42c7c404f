"""Splitting whole texts for the byte-level tokenizers.

A text is cut into fragments, and what a short fragment gives is kept by fragment. As the pattern looks ahead for nothing but
the end of white space, and never back, a match begins at each of these places, and what stands before and after it can be
tokenised apart: before white space after a visible character; between letter, digit and other sign, whichever comes first,
unless an apostrophe comes before a letter (it may begin a contraction) or after a sign; after a single tab or line break
between visible characters. Kinds are told for ASCII and for the letters of Latin-1 and Latin Extended-A, which are 2 bytes
from C3 on, and are open for all other characters.

So texts in other letters are long fragments. Matches never cross a single space that stands between two other visible
characters: that space begins the match after it. Such texts can be split at these spaces into pieces, which are kept alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries kept between batches in each worker, beyond which those of the last batch stay, and the longest fragment that is
#: kept, in characters. Both bound memory (to about 100 MB), not results.
KEPT, LONGEST = 200_000, 64

#: Kinds of bytes, and between which two of them, as 8 * before + after, a fragment ends.
OPEN, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, BREAK = range(7)
KINDS = np.full(256, OPEN, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[0x30:0x3A] = DIGIT
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = LETTER
KINDS[0x27], KINDS[0x20], KINDS[0x09:0x0E] = APOSTROPHE, SPACE, BREAK
ENDS = np.zeros(64, bool)
for before_, after_ in ((LETTER, (DIGIT, SIGN, APOSTROPHE)), (DIGIT, (LETTER, SIGN, APOSTROPHE)), (SIGN, (LETTER, DIGIT)), (APOSTROPHE, ())):
    ENDS[[8 * before_ + x for x in (*after_, SPACE, BREAK)]] = True


def pieces(text: str) -> list[str]:
    """Strings whose matches, one after the other, are the text's."""
    first, *rest = text.split(" ")
    if first and not first[-1].isspace() and all(rest) and not any(x[0].isspace() or x[-1].isspace() for x in rest):
        return [first, *[" " + x for x in rest]]
    out, held = [], [first]
    for before, x in zip([first, *rest], rest, strict=False):
        if before and x and not before[-1].isspace() and not x[0].isspace():
            out.append(held)
            held = ["", x]
        else:
            held.append(x)
    return [x for x in map(" ".join, [*out, held]) if x]


def fragments(texts: pa.Array, whole: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct fragments of an array of strings, which of them all texts consist of, one after the other, and where in
    that each text ends. A text that holds one of the strings named is one fragment."""
    begins = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    held = pa.py_buffer(texts.buffers()[2] or b"").slice(begins[0], begins[-1] - begins[0])
    data, begins = np.frombuffer(held, np.uint8), begins - begins[0]
    kinds = KINDS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    lead = lead[(data[lead] > 0xC3) | (data[lead + 1] & 0xDF != 0x97)]  # but for the signs of multiplication and division
    kinds[lead] = kinds[lead + 1] = LETTER
    seen = (kinds >= LETTER) & (kinds <= APOSTROPHE)
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = ENDS[8 * kinds[:-1] + kinds[1:]]
    ends[2:-1] |= seen[:-2] & (kinds[1:-1] == BREAK) & seen[2:]
    for x in whole:
        for i in np.flatnonzero(pc.match_substring(texts, x)):
            ends[begins[i] : begins[i + 1]] = False
    ends[begins] = True
    places = np.flatnonzero(ends)
    coded = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), held).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(places, begins[1:])


class Memo(dict):
    """fragment, piece or word -> value, filled for a batch of them at once by fill()."""

    def __init__(self, fill: Callable[[list[str]], Iterable], kept: int = KEPT):
        super().__init__()
        self.fill, self.kept = fill, kept

    def of(self, lists: list[list[str]]) -> list[list]:
        seen = {x for xs in lists for x in xs}
        if len(self) > self.kept:
            last = {x: self[x] for x in seen.intersection(self)}
            self.clear()
            self.update(last)
        new = list(seen.difference(self))
        self.update(zip(new, self.fill(new), strict=True))
        out = [list(map(self.__getitem__, xs)) for xs in lists]
        for x in new:
            if len(x) > LONGEST:
                del self[x]
        return out

    def distinct(self, keys: list[str]) -> list:
        """Values of fragments of which none comes twice."""
        got = list(map(self.get, keys))
        if len(self) > self.kept:
            self.clear()
            self.update((x, y) for x, y in zip(keys, got, strict=True) if y is not None)
        new = [x for x, y in zip(keys, got, strict=True) if y is None]
        values = list(self.fill(new))
        self.update((x, y) for x, y in zip(new, values, strict=True) if len(x) <= LONGEST)
        rest = iter(values)
        return [next(rest) if y is None else y for y in got]


def parts(texts: pa.Array, most: int = 8_000_000) -> Iterator[pa.Array]:
    """Slices of an array of strings that hold about so many bytes each."""
    upto, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(upto, most + (upto[start - 1] if start else 0), side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def runs(texts: list[str], most: int = 3_000_000) -> Iterator[list[str]]:
    """Parts of a batch that hold about so many characters each."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(x)
    if texts:
        yield texts[start:]
