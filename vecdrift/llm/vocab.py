"""Readers of the public vocabulary files. Each file is read once per Python
process; paths are parameters."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(file: str) -> dict[bytes, int]:
    """Token bytes to rank, of a .tiktoken file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def merges(file: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], tuple[str, ...]]:
    """Of a .json file: token bytes to id, pair of ids to (place in the merge
    order, merged id), and the contents of added tokens."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    chars = byte_alphabet()
    raw = {t: bytes(chars[c] for c in t) for t in spec["model"]["vocab"] if all(c in chars for c in t)}
    added = tuple(t["content"] for t in spec["added_tokens"])
    ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw and t not in added}
    pairs = {}
    for place, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs[ids[raw[a]], ids[raw[b]]] = (place, ids[raw[a] + raw[b]])
    return ids, pairs, added


@lru_cache(maxsize=2)
def pieces(file: str) -> tuple[dict[str, int], list[float], list[int]]:
    """Of a .model file: ordinary pieces without inner word marks to a dense
    index, their scores, and the dense indexes of the 256 byte pieces (which
    follow the ordinary ones)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    found, scores = {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) and "▁" not in piece[1:]:
            found[piece] = len(scores)
            scores.append(model.get_score(i))
    return found, scores, list(range(len(scores), len(scores) + 256))
