"""Token ids as the tokenizer's own library gives them, made faster by caches where that cannot change them.

Two layouts of a `.json` file have a fast path over texts of Latin characters: byte-level BPE (ids of whole texts by
byte ranks) and lower-cased BPE with word ends (ids of each distinct word once). Any other file, and any text with other
characters, with a special token's string or with a very long word, goes through the library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Anything but the characters whose class is the same in every Unicode version; a dotted capital I changes its length.
_OTHER = re.compile("[^\\t-\\r -~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2022\\u2026\\u20ac]")
_LONG_SPACE = re.compile(f"[{_SPACE}]{{400}}")
_WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_CONTROL = re.compile("[\\0-\x08\x0e-\x1f\x7f]")
#: Stands for the end of a word in byte ranks; a text that holds it takes the library's way.
_END = "\x01"
CACHED_WORDS = 300_000


def _bytes_of_characters() -> dict[str, int]:
    """Printable stand-ins of bytes, as byte-level BPE files write them."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def version_of(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read())
    digest.update((tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__).encode())
    return digest.hexdigest()


class _Words(dict):
    """Packed ids by word; a missing word is encoded."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        parts = _WORD_PARTS.findall(word)
        found = self[word] = array("I", self.encode(_END.join(parts) + _END)).tobytes() if parts else b""
        return found


class Tokens:
    """Ids and counts of texts by one tokenizer file, without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = self.words = None
        self.special: list[str] = []
        if not path.endswith(".json"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.pieces = None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", ())]
        self._fast_path(spec)

    def _fast_path(self, spec: dict) -> None:
        import tiktoken

        model, split, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
        as_byte = _bytes_of_characters()
        end = model.get("end_of_word_suffix")
        if plain and not end and normal is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            special = set(self.special)
            ranks = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            if len(ranks) == 1 + max(ranks.values()):
                pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        elif plain and end and _WORDS_LAYOUT == _layout(normal, split):
            special = set(self.special)
            ranks = {}
            for t, i in model["vocab"].items():
                if t not in special:
                    body = t.removesuffix(end)
                    ranks[bytes(as_byte[c] for c in body) + _END.encode() * (t != body)] = i
            first = sorted(i for b, i in ranks.items() if len(b) <= 2 and (len(b) == 1 or b.endswith(_END.encode())) and i < 512)
            if len(ranks) == 1 + max(ranks.values()) and len(first) == 512:
                # the lowest ranks join a word's last byte with its end, as the file's alphabet does
                self.words = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
                self.cache = _Words(self.words)

    def _safe(self, text: str) -> bool:
        if (not text.isascii() or _CONTROL.search(text)) and _OTHER.search(text):
            return False
        return max(map(len, text.split()), default=0) < 400 and _LONG_SPACE.search(text) is None and not any(s in text for s in self.special)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.words is not None and self._safe(text):
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            return b"".join(map(self.cache.__getitem__, text.lower().split()))
        return array("I", self.ids(text)).tobytes()

    def ids(self, text: str) -> list[int]:
        if self.pieces is not None:
            return self.pieces.encode(text, num_threads=1)
        if self.fast is not None and self._safe(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4 if self.words is not None else len(self.ids(text))


def _layout(normal: dict | None, split: dict) -> tuple:
    kinds = tuple(x["type"] for x in (normal or {}).get("normalizers", ()))
    parts = split.get("pretokenizers", ())
    return kinds, tuple(x["type"] for x in parts), parts[0].get("pattern", {}).get("Regex") if parts else None, parts[0].get("invert") if parts else None


#: The layout that the word cache reproduces.
_WORDS_LAYOUT = (("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"), "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", True)
_LOADED: dict[str, Tokens] = {}


def load(path: str) -> Tokens:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]
