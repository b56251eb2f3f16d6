"""Words of letters and trailing punctuation encoded together, as the tokenizer would.

A tokenizer file with word ends merges bytes by rank; a byte that ends a word is another
symbol than the same byte within one. Words of ASCII and Latin-1 letters have 119 symbols,
few enough for each to be an ASCII character. A rank encoder over those characters then
takes many words as one string.

Ranks of tokens instead of pairs give the same ids where every token, alone, merges to
itself: parts next to each other that make up a token have seen the merges that the token
has alone, so that the pair is the one that makes it. Tokens that don't are left out.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .bpe import NEVER, merge

#: The split that the file must have (a fixed value); with others there is no short way.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Lower-case letters other than ASCII: U+00DF to U+00FF but for the division sign.
MORE = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
LEAD = 0xC3
ASCII = [chr(c) for c in range(97, 123)]
LONGEST = 64


def _symbols() -> tuple[dict[int, str], dict[int, str]]:
    """Bytes within a word and bytes that end one, to ASCII characters. Ends and LEAD are no letters."""
    others = iter([chr(c) for c in range(128) if not chr(c).isalpha()])
    ends = {b: next(others) for b in [*map(ord, ASCII), *(c.encode()[1] for c in MORE)]}
    inner = {LEAD: next(others)} | {ord(c): c for c in ASCII}
    free = iter([*map(chr, range(65, 91)), *others])
    return inner | {c.encode()[1]: next(free) for c in MORE}, ends


INNER, ENDS = _symbols()
#: What a letter becomes within a word (of any case) and at its end.
WITHIN = {ord(u): INNER[ord(c)] for c in ASCII for u in (c, c.upper())} | {ord(u): INNER[LEAD] + INNER[c.encode()[1]] for c in MORE for u in {c, c.upper()} if "\xbf" < u < "Ā"}
LAST = {u: ENDS[ord(c)] for c in ASCII for u in (c, c.upper())} | {u: INNER[LEAD] + ENDS[c.encode()[1]] for c in MORE for u in {c, c.upper()} if "\xbf" < u < "Ā"}
_LETTERS = "".join(map(re.escape, LAST))
#: Of each line: letters and punctuation after them, or anything else.
SHAPE = re.compile(rf"^(?:([{_LETTERS}]{{1,{LONGEST}}})([!-/:-@\[-`{{-~]*)|(.*))$", re.M)


def _unicode_bytes() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def letter_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens over the symbols, as ASCII, to their ids; empty if the file is of another kind."""
    spec = json.loads(data)
    model, kinds = spec["model"], [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or splits != [SPLIT, None] or model.get("end_of_word_suffix") != SUFFIX or model.get("dropout"):
        return {}
    vocab = model["vocab"]
    pairs, last = {}, -1
    for a, b in model["merges"]:
        if (made := vocab[a + b]) <= last:
            return {}  # ids don't rise with ranks
        last = pairs[vocab[a], vocab[b]] = made
    bytes_of, ranks = _unicode_bytes(), {}
    look = lambda a, b: pairs.get((a, b), NEVER)
    for token, rank in vocab.items():
        ended = token.endswith(SUFFIX) and token != SUFFIX
        chars = token.removesuffix(SUFFIX) if ended else token
        codes = [bytes_of.get(c, -1) for c in chars]
        symbols = [INNER.get(b) for b in codes[: len(codes) - ended]] + ([ENDS.get(codes[-1])] if ended else [])
        if None in symbols:
            continue
        alone = [vocab[c] for c in chars[: len(chars) - ended]] + ([vocab[chars[-1] + SUFFIX]] if ended else [])
        if len(alone) == 1 or merge(alone, look) == [rank]:
            ranks["".join(symbols).encode()] = rank
    return ranks


class Letters:
    """Encodes words that SHAPE finds to be letters, many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        top = max(ranks.values()) + 1
        free = (b for b in (bytes([b]) for b in range(256)) if b not in ranks)
        every = ranks | {b: top + i for i, b in enumerate(free)}  # the encoder wants all single bytes; these aren't met
        marks = "".join(f"\\x{ord(c):02x}" for c in ENDS.values())
        self.encoder = tiktoken.Encoding("letters", pat_str=f"[^{marks}]*[{marks}]", mergeable_ranks=every, special_tokens={})
        self.ends = np.zeros(top + 256, bool)
        self.ends[[r for t, r in ranks.items() if chr(t[-1]) in set(ENDS.values())]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = self.encoder.encode_to_numpy("".join([w[:-1] + LAST[w[-1]] for w in words]).translate(WITHIN), disallowed_special=()).astype("<u4")
        cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
