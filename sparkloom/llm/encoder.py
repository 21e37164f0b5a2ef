"""A byte-level BPE encoder for worker processes: the tokenizers library, and joins of encodings that it made apart.

Between a character and white space after it the splitting pattern always parts, whatever stands
around them, so the encoding of a text is that of its segments - white space and the characters up to
the next - one after the other. The library encodes segments; those met lately are remembered.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: White space as the tokenizer's splitting pattern sees it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Between these two characters the splitting pattern always parts, whatever stands around them.
_SAFE = re.compile(f"[^{_SPACE}](?=[ \\n])")
_WHITE = re.compile(f"[{_SPACE}]+")
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A blank or line end that follows other white space; without any, segments begin at each of the two.
_RUN = re.compile(f"[{_SPACE}][ \\n]")
#: White space other than blanks and line ends; in ASCII only the first four.
_RARE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Segments that a worker remembers, twice over, for texts with and without runs: about 25 MB at most.
SEGMENTS = 60_000
#: Mean characters of a segment beyond which fewer are remembered.
SEGMENT_CHARS = 20
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 4

_own: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _own:
        _own[path] = Encoder(path)
    return _own[path]


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Seen(dict):
    """Segment -> ids. When full it becomes the older half of what is remembered, and what is met again moves over.

    With `blank`, a segment is named without the blank before it; one that begins with a line end has none.
    """

    def __init__(self, own: Encoder, blank: bool):
        self.own, self.chars, self.older, self.blank = own, 0, {}, blank
        self.lead, self.model = own.letters[32] if own.letters and blank else "", own.tok.model

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = self._made(segment)
        most = self.own.segments
        if len(self) >= most or self.chars + len(segment) > most * SEGMENT_CHARS:
            self.older, self.chars = dict(self), 0
            self.clear()
        if len(segment) <= most * SEGMENT_CHARS:
            self[segment] = ids
            self.chars += len(segment)
        return ids

    def _made(self, segment: str) -> bytes:
        if self.lead and segment.isascii() and segment.isalpha():
            # the commonest case: bytes are their own letters
            return array("I", [t.id for t in self.model.tokenize(self.lead + segment)]).tobytes()
        blank, word = (True, segment) if self.blank and segment[:1] != "\n" else (segment[:1] == " ", segment.removeprefix(" "))
        if not self.own.letters:
            return self.own.encoded(" " * blank + word)
        letters = word.rstrip(_SIGNS)
        if letters != word and _plain(letters.removeprefix("\n")):
            # letters and the signs after them are two pretokens
            signs = word[len(letters) :]
            head = segment[: -len(signs)]
            return (self.get(head) or self.older.get(head) or self._made(head)) + self.own.signs[signs]
        if _plain(word):
            # letters, with the blank before them, are one pretoken
            return self._letters(self.own.letters[32] * blank, word)
        if word[:1] == "\n" and not blank and _plain(word[1:]):
            # a line end and the letters after it are two
            return self.own.signs["\n"] + self._letters("", word[1:])
        return self.own.encoded(" " * blank + word)

    def _letters(self, lead: str, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(lead + word.encode().decode("latin-1").translate(self.own.letters))]).tobytes()


class _Signs(dict):
    """Signs, or a line end -> ids; as many are remembered as there are short ones in common use."""

    def __init__(self, own: Encoder):
        self.own = own

    def __missing__(self, signs: str) -> bytes:
        ids = self.own.encoded(signs)
        if len(signs) <= 4 and len(self) < 4096:
            self[signs] = ids
        return ids


#: ASCII signs that make one pretoken with those beside them, whatever letters stand before; the apostrophe does not.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _runs(text: str) -> bool:
    """Whether _RUN is found, by searches for single characters first."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
        return True
    return any(c in text for c in (_RARE[:4] if text.isascii() else _RARE)) and bool(_RUN.search(text))


def _plain(word: str) -> bool:
    """Letters alone, of scripts whose letters have long been settled."""
    return word.isalpha() and max(word) < "\u0250"


class Encoder:
    """Encodes as the library does with add_special_tokens=False and without truncation and padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.segments = SEGMENTS
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self._bytes: dict[int, bytes] | None = None
        kind = json.loads(self.tok.to_str())
        split = kind["pre_tokenizer"] or {}
        usual = not kind["normalizer"] and kind["model"]["type"] == "BPE" and not kind["model"]["dropout"] and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
        #: byte -> letter where a pretoken may be given to the library's model directly, else nothing
        self.letters = {b: c for c, b in _byte_letters().items()} if usual and not any(s.strip(".,;:!?").isalpha() or not (t := s.rstrip(_SIGNS)) or t.isalpha() for s in self.special) else {}
        self._white_special = any(_WHITE.search(s) for s in self.special)

        self._seen, self._after_blank = _Seen(self, False), _Seen(self, True)
        self.signs = _Signs(self)

    @property
    def token_bytes(self) -> dict[int, bytes]:
        if self._bytes is None:
            letters = _byte_letters()
            self._bytes = {i: t.encode() if t in self.special else bytes(letters[c] for c in t) for t, i in self.tok.get_vocab().items()}
        return self._bytes

    def plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Drop the remembered segments: the worker may next serve an operator that needs the memory."""
        for seen in (self._seen, self._after_blank):
            seen.clear()
            seen.older, seen.chars = {}, 0

    def encoded(self, text: str) -> bytes:
        return array("I", self.plain(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self._white_special:
            return [self.encoded(t) for t in texts]
        return [self._segments(t) for t in texts]

    def _segments(self, text: str) -> bytes:
        if _runs(text):
            return b"".join(map(self._seen.__getitem__, _SEGMENT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        begun = self._seen._made(first) if self.letters and _plain(first) else self.encoded(first)
        return begun + b"".join(map(self._after_blank.__getitem__, rest))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def pretokens(self, text: str) -> list[str]:
        """The units that are encoded on their own: pretokens, and special tokens."""
        out: list[str] = []
        split = re.split("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text) if self.special else [text]
        for part in split:
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def leaves(self, text: str, size: int) -> list[tuple[str, bool]]:
        """The text in parts of about `size` characters, each with whether the cut after it lies inside a pretoken.

        Cuts are made between a character and a blank where the next `size` characters have such a
        place, else between pretokens, and inside a pretoken only where it is longer than `size`.
        """
        if self._white_special:
            return [(text, False)]
        out: list[tuple[str, bool]] = []
        at = 0
        while at < len(text):
            found = _SAFE.search(text, at + size - 1) if len(text) - at > size else None
            end = found.end() if found else len(text)
            if end - at <= 2 * size:
                out.append((text[at:end], False))
            else:
                out += self._hard(text[at:end], size)
            at = end
        return out

    def _hard(self, text: str, size: int) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        ready: list[str] = []

        def flush() -> None:
            # two white pretokens at the end would be one without the character after them
            split = len(ready) - (len(ready) > 1 and bool(_WHITE.fullmatch(ready[-1])) and bool(_WHITE.fullmatch(ready[-2])))
            out.extend(("".join(x), False) for x in (ready[:split], ready[split:]) if x)
            ready.clear()

        held = 0
        for unit in self.pretokens(text):
            long = len(unit) > size and unit not in self.special
            if long or held + len(unit) > size:
                flush()
                held = 0
            if long:
                out += [(unit[i : i + size], i + size < len(unit)) for i in range(0, len(unit), size)]
            else:
                ready.append(unit)
                held += len(unit)
        flush()
        return out

    def join(self, a: list[int], b: list[int], window: int = WINDOW) -> list[int]:
        """The encoding of two adjacent parts of one pretoken, given the encodings of each.

        Re-encodes a window around the join, doubled until its first and last token agree with the
        parts: a sequence of tokens is the encoding of an unsplit text if each adjacent pair is that
        of its own text, and with agreeing ends every pair comes from one of the three encodings.
        """
        text_of = self.token_bytes
        while True:
            i, j = max(0, len(a) - window), min(len(b), window)
            while i > 0 and text_of[a[i]][0] & 0xC0 == 0x80:
                i -= 1
            while j < len(b) and text_of[b[j]][0] & 0xC0 == 0x80:
                j += 1
            middle = self.plain(b"".join([text_of[x] for x in (*a[i:], *b[:j])]).decode())
            if (i == 0 or middle[:1] == a[i : i + 1]) and (j == len(b) or middle[-1:] == b[j - 1 : j]):
                return a[:i] + middle + b[j:]
            window *= 2


class Node:
    """The encoding of some adjacent leaves. `head` and `tail` count the tokens at its ends that belong to a pretoken which goes on beyond."""

    __slots__ = ("ids", "head", "tail")

    def __init__(self, ids: list[int], head: int, tail: int):
        self.ids, self.head, self.tail = ids, head, tail

    def followed_by(self, b: Node, own: Encoder) -> Node:
        if not self.tail:
            # the cut parts two pretokens: both sides agree as they are
            return Node(self.ids + b.ids, self.head, b.tail)
        left, right = len(self.ids) - self.tail, b.head
        middle = own.join(self.ids[left:], b.ids[:right])
        head = len(middle) if self.head == len(self.ids) else self.head
        tail = len(middle) if b.tail == len(b.ids) else b.tail
        return Node(self.ids[:left] + middle + b.ids[right:], head, tail)


def joined(nodes: list[Node], own: Encoder) -> Node:
    """Adjacent nodes joined pairwise, level by level."""
    while len(nodes) > 1:
        nodes = [nodes[i].followed_by(nodes[i + 1], own) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]
