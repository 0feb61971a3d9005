"""Token ids of whole texts, through the ``tokenizers`` library.

``TextEncoder`` returns the ids of a text as little-endian unsigned 32-bit bytes.
For the two kinds of tokenizer below, a text may be cut at certain blanks without
changing any id, so each distinct piece is encoded once per worker and looked up
afterwards; every other tokenizer encodes whole texts.

* ``dropped``: the normalizer collapses white space and the splitter removes it, so
  pieces between blanks and newlines are independent.
* ``leading``: byte-level BPE with its own pattern.  In a run of white space before
  a visible character the last blank always opens the next word, and a newline
  between two visible characters always stands alone.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

#: Entries of each of the two generations of a piece cache.
CACHE_ENTRIES = 500_000

_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_WORD = re.compile(r" (?=\S)")
_open: dict[str, TextEncoder] = {}


def tokenizer_kind(path: str) -> str:
    """``dropped``, ``leading`` or ``whole``, from the tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("truncation") or spec.get("padding") or spec.get("post_processor"):
        return "whole"
    if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec.get("added_tokens", [])):
        return "whole"
    if any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
        return "whole"
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "leading"
    steps = (norm or {}).get("normalizers", [])
    squeeze = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    parts = pre.get("pretokenizers", [])
    removed = parts and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    if squeeze in steps and removed and all(s == squeeze or s["type"] in ("NFC", "Lowercase") for s in steps):
        if parts[1:] and all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in parts[1:]):
            return "dropped"
    return "whole"


class _Pieces(dict):
    """Ids of pieces, each encoded when first met.  What fell out of use is forgotten."""

    def __init__(self, call: Callable[[str], bytes], word: Callable[[str], bytes], before: str, fold: bool):
        super().__init__()
        self.call, self.word, self.before, self.fold = call, word, before, fold
        self.older: dict[str, bytes] = {}
        self.ends = {c: call(c) for c in ".,"}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            end = self.ends.get(piece[-1:], b"")
            bare = piece[:-1] if end else piece
            if bare.isalpha() and max(bare) < "\u0100":  # Latin letters are one word to every splitter here, and a full stop or comma the next
                low = bare.lower() if self.fold else bare
                found = (self.word(self.before + low) if low == piece else self[low]) + end
            else:
                found = self.call(self.before + piece)
        self[piece] = found
        return found

    def tidy(self, most: int) -> None:
        """Keep what was used since the last time and drop the rest, if there is much."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class TextEncoder:
    def __init__(self, path: str, kind: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in (0x20, *range(0x80, 0x100))}
        self.kind = kind or tokenizer_kind(path)
        fold = self.kind == "dropped"
        self.first, self.rest = _Pieces(self._ids, self._word, "", fold), _Pieces(self._ids, self._word, " ", False)
        self.newline = self._ids("\n")

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds no memory for them."""
        for cache in (self.first, self.rest):
            cache.clear()
            cache.older = {}

    def _ids(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str) -> bytes:
        """As _ids for one word in its normal form: only the library's byte alphabet and its model are needed."""
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.alphabet))]).tobytes()

    def encode(self, texts: list[str | None], most: int = CACHE_ENTRIES) -> list[bytes]:
        """Ids of each text as bytes; a null text has none.  About ``most`` pieces are remembered."""
        self.first.tidy(most)
        self.rest.tidy(most)
        one = {"dropped": self._dropped, "leading": self._leading, "whole": self._ids}[self.kind]
        return [one(t) if t else b"" for t in texts]

    def _dropped(self, text: str) -> bytes:
        return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))

    def _leading(self, text: str) -> bytes:
        plain = "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        if plain and text.replace("\n", "").isprintable():  # else blanks of other kinds may touch
            lines = [x.split(" ") for x in text.split("\n")]
        else:
            lines = [_WORD.split(x) for x in _LINE.split(text)]
        first, rest = self.first, self.rest.__getitem__
        return self.newline.join([first[x[0]] + b"".join(map(rest, x[1:])) for x in lines])


def encoder(path: str, kind: str | None = None) -> TextEncoder:
    """One encoder for each file and worker process; with the ``kind`` given, a worker does not read the file for it, which takes memory."""
    if path not in _open:
        _open[path] = TextEncoder(path, kind)
    return _open[path]


def public_path(name: str) -> str:
    """Where a public vocabulary file lies; imported late, as it is only needed here."""
    import public_tokenizers

    return public_tokenizers.path(name)
