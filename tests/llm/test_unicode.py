"""Tokens of every code point against both tokenizer libraries."""

import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from vecdrift.llm import bpe_codec, pretoken, token_counts, vocab



def texts(points):
    """Each code point before an apostrophe, which a letter or number parts from,
    and before a full stop, where the short pattern applies."""
    points = [chr(c) for c in points if not 0xD800 <= c <= 0xDFFF]
    return [" ".join(f"{c}'s {c}." for c in points[i : i + 200]) for i in range(0, len(points), 200)]


def test_ids_at_the_classes_borders():
    given = texts(sorted({c for a, b in pretoken.LATER for c in (a - 1, a, b, b + 1)} | set(range(0, 0x600)) | set(range(0x2000, 0x3100))))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(vocab.path(bpe_codec.FILE)), special_tokens={})
    codec = bpe_codec.TextCodec(vocab.path(bpe_codec.FILE), public_tokenizers.PATTERN)
    ids, _, _ = codec.run(pa.array(given))
    assert [t for t, own in zip(given, ids.to_pylist(), strict=True) if own != " ".join(map(str, enc.encode_ordinary(t)))] == []


def test_counts_of_all_code_points():
    given = texts(range(0x110000))
    path = vocab.path("byte_bpe_50k.json")
    totals, _ = token_counts._counts(pa.array(given), token_counts._counter(path), 20)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(given, add_special_tokens=False)]
    assert [i for i, (a, b) in enumerate(zip(totals, want, strict=True)) if a != b] == []
