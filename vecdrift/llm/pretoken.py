"""Cutting texts in Arrow columns: a batch of texts becomes its distinct words,
or the parts that byte-pair merges stay within, and numbers into them, so that
Python only handles what is new."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The characters that are white space to any of the libraries.
_SPACE = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space next to other white space, or at an end: there the words on its two
#: sides cannot be cut apart from each other.
_UNEVEN_SPACE = rf"(?:^|[{_SPACE}]) | (?:[{_SPACE}]|$)"
#: The commonest parts: letters, then marks that one word takes all of.
_COMMON = r"^(?P<a> ?\pL+)(?P<b>[.,;:!?|#%&*$<>]*)$"


#: The letters and numbers of later Unicode versions, which the
#: tokenizer libraries (tiktoken and tokenizers) take for other characters.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


@lru_cache(maxsize=8)
def compiled(pattern: str):
    """The pattern with the classes of letters and numbers that the libraries have."""
    later = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in LATER)
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(name, f"[{name}--[{later}]]")
    return regex.compile(pattern, regex.V1)


def strings(column: pa.Array) -> pa.Array:
    """A column of texts without nulls (null is the empty text)."""
    return pc.fill_null(column, "")


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def totals(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same of doubles, each run on its own, so that none takes another's error."""
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths), values, len(lengths))


def runs(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (lengths[i] of them), for each i."""
    at = offsets(lengths)
    return np.arange(at[-1]) + np.repeat(start - at[:-1], lengths)


def lists(flat: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(lengths), pa.int32()), flat)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of `lengths` values."""
    total, at = offsets(values), offsets(lengths)
    return total[at[1:]] - total[at[:-1]]


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts (see common.WORD), the words of all texts
    in order as numbers into them, and each text's number of words."""
    cut = pc.ascii_split_whitespace(texts)
    flat, n = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # next to space at an end
    words = flat.filter(pa.array(some)).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), sums(some.astype(np.int64), n.astype(np.int64))


class CodedWords:
    """coded_words() of many texts, a slice at a time: a slice's own numbers are
    held until the end, its texts are not."""

    def __init__(self):
        self.words, self.codes, self.lengths = [], [], []

    def add(self, texts: pa.Array) -> None:
        words, codes, lengths = coded_words(texts)
        self.words.append(words)
        self.codes.append(codes.astype(np.int32))
        self.lengths.append(lengths)

    def result(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        distinct = pa.concat_arrays([pa.array([], pa.string()), *self.words]).dictionary_encode()
        place, at = distinct.indices.to_numpy(zero_copy_only=False), offsets(np.array([len(w) for w in self.words], np.int64))
        codes = [place[a:b][own] for a, b, own in zip(at[:-1], at[1:], self.codes, strict=True)]
        return distinct.dictionary, np.concatenate([np.zeros(0, np.int32), *codes]), np.concatenate([np.zeros(0, np.int64), *self.lengths])


def coded_parts(texts: pa.Array, findall: Callable[[str], list[str]], whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of the texts, the parts of all texts in order as
    numbers into them, and each text's number of parts.

    Parts are cut before single spaces. A word takes at most the one space before
    it along and no word goes on after a space, so that the words of a text are
    those of its parts. Texts in which a space touches other white space, and
    those marked in `whole`, are cut into words by findall instead."""
    uneven = pc.match_substring_regex(texts, _UNEVEN_SPACE).to_numpy(zero_copy_only=False)
    if whole is not None:
        uneven = uneven | whole
    even = np.flatnonzero(~uneven)
    cut = pc.split_pattern(texts.take(pa.array(even)), " ")
    n = pc.list_value_length(cut).to_numpy()
    flat = cut.flatten().dictionary_encode()
    codes, inner = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    first = offsets(n)[:-1]
    is_first = np.zeros(len(codes), bool)
    is_first[first] = True
    # a text's first part has no space in front
    own, own_code = np.unique(codes[first], return_inverse=True)
    later, later_code = np.unique(codes[~is_first], return_inverse=True)
    words = [findall(t) for t in texts.take(pa.array(np.flatnonzero(uneven))).to_pylist()]
    rest = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    spaced = pc.binary_join_element_wise(pa.array([""] * len(later), pa.string()), inner.take(pa.array(later)), " ")
    parts = pa.concat_arrays([spaced, inner.take(pa.array(own)), rest.dictionary])
    codes[first] = len(later) + own_code
    codes[~is_first] = later_code
    lengths = np.zeros(len(texts), np.int64)
    lengths[even], lengths[uneven] = n, [len(x) for x in words]
    at, out = offsets(lengths), np.empty(lengths.sum(), np.int64)
    out[runs(at[:-1][even], n)] = codes
    out[runs(at[:-1][uneven], lengths[uneven])] = rest.indices.to_numpy().astype(np.int64) + len(later) + len(own)
    # a part may be there twice, with a space and as a word of an uneven text
    distinct = parts.dictionary_encode()
    return distinct.dictionary, distinct.indices.to_numpy().astype(np.int64)[out], lengths


def words_of(parts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The words of all parts in order, and each part's number of words."""
    found = pc.extract_regex(parts, _COMMON)
    common = found.is_valid().to_numpy(zero_copy_only=False)
    a, b = found.field("a").filter(pa.array(common)), found.field("b").filter(pa.array(common))
    two = pc.not_equal(b, "").to_numpy(zero_copy_only=False)
    other = [compiled(pattern).findall(p) for p in parts.filter(pa.array(~common)).to_pylist()]
    lengths = np.zeros(len(parts), np.int64)
    lengths[common], lengths[~common] = 1 + two, [len(x) for x in other]
    at = offsets(lengths)[:-1]
    place = np.concatenate([at[common], at[common][two] + 1, runs(at[~common], lengths[~common])])
    flat = pa.concat_arrays([a, b.filter(pa.array(two)), pa.array([w for x in other for w in x], pa.string())])
    return flat.take(pa.array(np.argsort(place))), lengths


class Known:
    """Results for strings met lately, as Arrow columns: `key` and others. Keeps
    at most `most` of them, or what the last call used if that is more."""

    def __init__(self, schema: pa.Schema, most: int, longest: int):
        self.table, self.most, self.longest = schema.empty_table(), most, longest

    def get(self, keys: pa.Array, make: Callable[[pa.Array], pa.Table]) -> pa.Table:
        """A row for each of the distinct keys; make() gives the new ones'."""
        at = pc.index_in(keys, value_set=self.table.column("key"))
        new = pc.is_null(at)
        found = self.table.take(at.drop_null())
        made = make(keys.filter(new)).select(self.table.schema.names)
        short = made.filter(pc.less_equal(pc.binary_length(made.column("key")), self.longest))
        old = self.table if len(self.table) + len(short) <= self.most else found
        self.table = pa.concat_tables([old, short]).combine_chunks()
        is_new = new.to_numpy(zero_copy_only=False)
        order = np.empty(len(keys), np.int64)
        order[~is_new], order[is_new] = np.arange(len(found)), len(found) + np.arange(len(made))
        return pa.concat_tables([found, made]).combine_chunks().take(pa.array(order))
