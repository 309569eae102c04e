"""Whole-text token ids, chunk by chunk.

Both vocabularies split a text before they apply their merges, and never across the boundary between a
character that isn't white space and white space after it. The ids of a text are therefore those of its
chunks (white space, then the characters up to the next white space), which repeat: each worker keeps
the ids of chunks that it has seen, up to a fixed number, and only new ones go to the tokenizers library.
The byte-level vocabulary never merges across the end of a run of letters either, so there a word and the
marks after it are chunks of their own, and new words go to the library's model without its splitter.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Chunks of up to 16 characters kept by one worker; about 200 MB a million.
MEMO = 1_000_000
LONGEST = 16
#: Letters of the Latin blocks (all of category L).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CHUNK = re.compile(rf"\s*+[{_LETTERS}]++(?=[\s.,!?;:%&$*#|()\"-]|\Z)|\s*\S+|\s+")
_WORD = re.compile(rf" ?[{_LETTERS}]+")
#: The splitter that ``_CHUNK`` is made for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Marks that no merge joins to an ASCII letter before them.
_MARKS = ".,!?;:%&$*#|"
_ODD = "\x1c\x1d\x1e\x1f"  # white space to Python only
_loaded: dict[str, Callable[[Iterable[str]], list[bytes]]] = {}


def in_groups(texts: list[str], chars: int = 1 << 20) -> Iterable[list[str]]:
    """``texts`` in runs of about ``chars`` characters, so that what is held at once is bounded."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= chars:
            yield group
            group, held = [], 0
    if group:
        yield group


class _Memo(dict):
    """Chunks to their ids; a new chunk is encoded when it is first asked for."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.most = most
        self.batch = tokenizer.encode_batch_fast

    def encode(self, chunk: str) -> bytes:
        return array("I", self.batch([chunk], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < self.most and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class _LowerMemo(_Memo):
    """Chunks without white space: those of a word and marks are put together from both."""

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if word != chunk and word and word[-1].isascii() and word[-1].isalpha():
            return self[word] + self[chunk[len(word) :]]
        return super().__missing__(chunk)


class _ByteMemo(_Memo):
    """Chunks of a byte-level vocabulary: a word is one piece to its splitter, so the model gets it as it is."""

    def __init__(self, tokenizer, most: int):
        super().__init__(tokenizer, most)
        self.model = tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.names = dict(zip(plain, plain, strict=True))
        self.names |= {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in self.names)}

    def encode(self, chunk: str) -> bytes:
        if not _WORD.fullmatch(chunk):
            return super().encode(chunk)
        return array("I", [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.names))]).tobytes()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, drops_space: bool, most: int = MEMO) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers.

    ``drops_space``: the vocabulary ignores white space and case, so chunks needn't hold them; otherwise it must be a
    byte-level one. ``most``: chunks kept.
    """
    if (path, drops_space) in _loaded:
        return _loaded[path, drops_space]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if not drops_space:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != _BYTE_LEVEL or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} isn't a byte-level vocabulary")
    memo = (_LowerMemo if drops_space else _ByteMemo)(tok, most)

    def chunks(text: str) -> list[str]:
        if any(c in text for c in _ODD):
            return [text]
        if drops_space:  # and case
            return (text.lower() if text.isascii() else text).split()
        return _CHUNK.findall(text)

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join(map(memo.__getitem__, chunks(t))) for t in texts]

    _loaded[path, drops_space] = encode
    return encode
