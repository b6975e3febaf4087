"""Token ids of whole texts, by a public tokenizer whose file is a parameter."""

import json
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Stretches and words that a worker remembers, and as many that it is about to forget.
MEMORY = 300_000

# Fixed value: the pattern by which word_bpe_49k.json cuts lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which that pattern and lower-casing mean the same in Python: ASCII and Latin
#: letters that NFC leaves alone. All else is asked of the tokenizer as it stands.
LATIN = "À-ÖØ-öø-įı-ňŊ-ž"
PLAIN = re.compile(rf"[\x00-\x7f{LATIN}]*")
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+".replace(r"\s", r"\t-\r "))


def byte_names() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself where Latin-1
    prints it, else the next one from U+0100 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Remembered(dict):
    """A mapping that forgets what was not asked for since about MEMORY entries ago."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class WordTokenizer:
    """For a tokenizer that drops white space: each stretch between ASCII white space has ids of
    its own, which are asked of the tokenizer once and remembered as little-endian unsigned 32-bit
    bytes. Other tokenizers get whole texts. With ``ordinary``, the strings of special tokens in a
    text are text like any other."""

    def __init__(self, path: str, ordinary: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        how = json.loads(self.tokenizer.to_str())
        cuts = [p.get("pattern", {}).get("Regex") for p in (how["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_stretch = cuts[:1] == [PATTERN]
        self.special = [] if ordinary else [a["content"] for a in how["added_tokens"]]
        self.names = byte_names()
        self.words, self.stretches = Remembered(self.word), Remembered(self.stretch)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        named = word.encode().decode("latin-1").translate(self.names)
        return packed([t.id for t in self.tokenizer.model.tokenize(named)])

    def stretch(self, raw: bytes) -> bytes:
        text = raw.decode()
        if PLAIN.fullmatch(text) and not (b"<" in raw and any(s in text for s in self.special)):
            return b"".join(map(self.words.__getitem__, CUT.findall(text.lower())))
        return self.whole(text)

    def ids(self, texts: list[bytes]):
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        for text in texts:
            if self.by_stretch:
                yield b"".join(map(self.stretches.__getitem__, text.split()))
            else:
                yield self.whole(text.decode())


MADE: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, ordinary: bool = False) -> WordTokenizer:
    """One for each worker, path and treatment of special tokens."""
    if (path, ordinary) not in MADE:
        MADE[path, ordinary] = WordTokenizer(path, ordinary)
    return MADE[path, ordinary]
