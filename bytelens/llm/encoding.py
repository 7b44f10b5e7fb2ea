"""Token ids of whole texts by a tokenizer file of the tokenizers library, and each id's bytes.

A byte-level BPE without normalizer cuts a text into pieces before its merges, so a text's ids are those of its pieces in a row; a task
asks the library's model once for a piece it has not met before. Any other kind of tokenizer, and any text that holds the string of an
added token which isn't plain text, goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from hashlib import sha256

import numpy as np

#: The pattern by which a byte-level tokenizer with use_regex cuts texts.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of characters below U+0250 but control characters, superscripts and fractions: letters and blanks among these.
_LETTERS, _BLANKS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "\\t-\\r \\x85\\xa0"
_PLAIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}{_LETTERS}0-9]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
_NOT_PLAIN = "[^\\t-\\r -~\\x85\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]"


def byte_letters() -> dict[int, int]:
    """The letter (code point) that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others
    from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class ByteBpe:
    """Encodes texts without adding special tokens. plain_specials: special tokens' strings in a text are ordinary text;
    otherwise they are tokens, which is the library's default. The table of pieces is dropped when it has table_limit
    entries, which costs time only."""

    def __init__(self, path: str, plain_specials: bool = False, table_limit: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(self.vocabulary.values(), default=0) < 1 << 16 else "<u4")
        cuts, model, added = rules["pre_tokenizer"] or {}, rules["model"], rules["added_tokens"]
        self.by_pieces = not rules["normalizer"] and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and model["type"] == "BPE" and not model["dropout"] and not model.get("ignore_merges")
        apart = [a["content"] for a in added if not (a["special"] and plain_specials)]
        self.whole = re.compile("|".join(map(re.escape, apart))).search if apart else lambda text: None
        self.pieces, self.plain = regex.compile(_PIECES).findall, re.compile(_PLAIN).findall
        self.not_plain, self.odd = re.compile(_NOT_PLAIN).search, re.compile("[\\x1c-\\x1f]").search  # blanks to some libraries only
        self.letters, self.limit, self.table = byte_letters(), table_limit, {}

    def encode(self, text: str) -> bytes:
        """The ids in a row, each as a little-endian number of self.kind."""
        if not self.by_pieces or self.whole(text) or (other := self.not_plain(text)) and self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        pieces = (self.pieces if other else self.plain)(text)
        out = list(map(self.table.get, pieces))
        if None in out:
            table, tokenize, letters = self.table, self.tok.model.tokenize, self.letters
            if len(table) > self.limit:
                table.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    ids = table.get(piece)
                    if ids is None:
                        own = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]
                        ids = table[piece] = np.array(own, self.kind).tobytes()
                    out[i] = ids
        return b"".join(out)

    def id_bytes(self) -> list[bytes]:
        """Of a byte-level vocabulary: the bytes of each id."""
        back, out = {v: k for k, v in self.letters.items()}, [b""] * (max(self.vocabulary.values(), default=-1) + 1)
        for token, i in self.vocabulary.items():
            out[i] = bytes(back[ord(x)] for x in token) if all(ord(x) in back for x in token) else token.encode()
        return out


_loaded: dict[tuple, object] = {}


def in_worker(data: bytes, suffix: str, make):
    """make(path of a file with this content), once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (sha256(data).hexdigest(), make.__qualname__, getattr(make, "__defaults__", None))
    if key not in _loaded:
        with tempfile.NamedTemporaryFile(suffix=suffix) as f:
            f.write(data)
            f.flush()
            _loaded[key] = make(f.name)
    return _loaded[key]
