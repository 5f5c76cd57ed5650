"""Pre-tokens of a byte-level BPE tokenizer and what each one is made of, worked out once per distinct pre-token."""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Callable, Iterable

from tokenizers import Token, Tokenizer

TOKEN_SLICE = 1 << 20  # bytes of text split together: a pre-token as an object takes some ten times its bytes
MEMO = 500_000  # pre-tokens remembered by one worker; beyond that it starts anew, with the same results
MEMO_BYTES = 64 << 20  # the same bound for their bytes, in `values`

# Fixed value: the split rule of the byte-level tokenizer for texts without the characters of _ODD, for which the regex
# library and the tokenizer may differ on what is a letter, a number or a space. Texts with them are split by the tokenizer.
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0180-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]")


def _listed(kind: str) -> str:
    """A class of all characters of a kind that _ODD leaves: the library looks them up much faster than it judges a kind."""
    own = (c for c in map(chr, range(0x2100)) if not _ODD.match(c) and re.match(kind, c))
    return "[" + "".join(map(re.escape, own)) + "]"


_LETTERS, _DIGITS, _SIGNS = map(_listed, (r"[^\W\d_]", r"\d", r"[^\s\w]|_"))
_SPLIT_LATIN = re.compile(rf" ?{_LETTERS}+|'(?:[stmd]|ll|ve|re)| ?{_DIGITS}+| ?{_SIGNS}+|\s+(?!\S)|\s+")


def _byte_characters() -> str:
    """The printable character by which a byte-level vocabulary writes each byte: itself, or the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(free)) for b in range(256))


_CHARACTERS = _byte_characters()


class _Memo(dict):
    """What is looked up and not held is worked out and kept; `held` counts its characters."""

    def __init__(self, work_out: Callable[[str], object]):
        self.work_out, self.held = work_out, 0

    def __missing__(self, item: str) -> object:
        self.held += len(item)
        self[item] = value = self.work_out(item)
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Vocabulary:
    """The tokenizer file, with a memo of `value(tokens)` per pre-token."""

    def __init__(self, path: str, value: Callable[[list], object]):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.value = value
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {text: value([Token(i, text, (0, len(text)))]) for text, i in added.items()}
        self.memo = _Memo(self._work_out())
        self._cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._marks = list(added)

    def _pretokens(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT_LATIN.findall(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens, with the strings of special tokens as items of their own (they are keys of `special`)."""
        if self._cut is None or not any(m in text for m in self._marks):
            return self._pretokens(text)
        out: list[str] = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self._pretokens(part))
        return out

    def _work_out(self) -> Callable[[str], object]:
        special, tokenize, value = self.special, self.model.tokenize, self.value  # without self: a cycle would outlive the task

        def work_out(item: str) -> object:
            return special[item] if item in special else value(tokenize(charmap_decode(item.encode(), "strict", _CHARACTERS)[0]))

        return work_out

    def learn(self, items: Iterable[str]) -> dict[str, object]:
        """The memo, holding at least these items."""
        items = set(items)
        new = [x for x in items if x not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = items
        for x in new:
            self.memo[x]
        return self.memo

    def values(self, items: list[str]) -> list:
        """The value of each item, in order. The memo passes its bounds by the items of one text at most."""
        if self.memo.held > MEMO_BYTES or len(self.memo) > MEMO:
            self.memo.clear()
        return list(map(self.memo.__getitem__, items))
