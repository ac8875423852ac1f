"""Token ids of whole texts as little-endian 16-bit bytes, with a bounded cache of words.

The tokenizer's normaliser turns each white-space run into a space and its splitter never joins across
white space, so a text's ids are the ids of its pieces between spaces and line feeds, one after another.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers

from tessera.llm.textbytes import trim

TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 2
CACHE = 800_000
#: Two signs in a row are one piece for the splitter, so such texts aren't cut at their full stops and commas.
_SIGNS = re.compile(r"[.,](?:(?<![^\W_].)|(?!\s|$))")
_TOGETHER = 400


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Encoder:
    def __init__(self, path: str | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        spec = json.loads(self.tokenizer.to_str())
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.light = Tokenizer.from_str(json.dumps(spec))  # the same merges for words that need no other preparation
        del spec
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        self.closes = np.zeros(1 << 16, bool)  # ids that end a word
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache, self.limit = {"": b""}, cache
        del vocabulary
        trim()

    def _learn(self, words: list[str]) -> None:
        """Words of letters go through the tokenizer many at a time: each is one piece and has one closing id."""
        plain = [w for w in words if w.isalpha() and w.islower() and _latin(w)]
        plain.sort(key=str.isascii)  # runs of ASCII words need no translation
        for at in range(0, len(plain), _TOGETHER * 50):
            part = plain[at : at + _TOGETHER * 50]
            lines = [" ".join(part[k : k + _TOGETHER]) for k in range(0, len(part), _TOGETHER)]
            lines = [x if x.isascii() else x.translate(self.as_bytes) for x in lines]
            ids = [np.array(x.ids, "<u2") for x in self.light.encode_batch_fast(lines, add_special_tokens=False)]
            ids = np.concatenate(ids)
            ends = (2 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't close each word once")
            flat = ids.tobytes()
            self.cache.update(zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        rest = list(set(words).difference(plain))
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[word] = np.array(got.ids, "<u2").tobytes()

    @staticmethod
    def _pieces(text: str | None) -> list[str]:
        """The text between spaces; Latin texts lower-cased, with single full stops and commas on their own."""
        if not text:
            return []
        if _latin(text) and not _SIGNS.search(text):
            text = text.lower().replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null is empty."""
        pieces = [self._pieces(t) for t in texts]
        if len(self.cache) > self.limit:
            self.cache = {"": b""}
        cache = self.cache
        if new := [w for w in set().union(*pieces) if w not in cache]:  # a difference of sets would walk the whole cache
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, cache: int = CACHE) -> Encoder:
    """The worker's own encoder; ``cache`` bounds the words it remembers, at about 200 bytes each."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def forget() -> None:
    """Drops this worker's encoders and their caches."""
    _encoders.clear()


def chunks(texts: list[str | None], size: int = 1 << 20):
    """Runs of whole texts of about ``size`` characters: (first, texts)."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
