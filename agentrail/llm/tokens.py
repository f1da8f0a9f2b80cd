"""Token ids of whole texts, fast enough for a corpus: every text is cut where
the vocabulary's own pattern always cuts, and each distinct part is encoded
once in a worker by the tokenizers library."""

from __future__ import annotations

import gc
import itertools
import os
import re
import string
import sys
from array import array

import numpy as np
import regex

#: Parts remembered in a worker; beyond it new ones, which are the rare ones,
#: are forgotten after use.  Bounds a worker's memory to about 250 MB.
MOST_PARTS = 1_000_000

# Unicode white space, as the pattern of byte-level vocabularies sees it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space but space and line end.
_OTHER_WS = [c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c) and c not in " \n"]
#: A space and the run behind it, or the white space that such a run leaves:
#: the vocabulary's pattern cuts at all these places.
PARTS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

# Fixed value: the pattern by which byte-level vocabularies cut a text.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

# Fixed value: how byte-level vocabularies spell a space.
SPACE = "\u0120"
#: Marks that the pattern cuts off behind a word, as one run.
MARKS = string.punctuation


def byte_letters() -> str:
    """How byte-level vocabularies spell the bytes 0 to 255: visible Latin-1
    characters as themselves, the others by characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


_LETTERS = dict(enumerate(byte_letters()))


def special_strings(tokenizer) -> dict[str, int]:
    """Strings that the library takes for one id wherever a text has them."""
    added = tokenizer.get_added_tokens_decoder()
    odd = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
    if odd:
        raise ValueError(f"added tokens that depend on their neighbours are not supported: {odd}")
    return {t.content: i for i, t in added.items()}


def special_pattern(strings) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")") if strings else None


def cut_parts(text: str) -> list[str]:
    """Parts between which the vocabulary's pattern always cuts.  Where every
    space stands alone and the only other white space is line ends, it cuts
    before every space."""
    if "  " in text or "\n " in text or text.endswith(" ") or "\0" in text or any(c in text for c in _OTHER_WS):
        return PARTS.findall(text)
    parts = text.replace(" ", "\0 ").split("\0")
    return parts if parts[0] else parts[1:]


class _Known(dict):
    """Ids by part.  A part looked up for the first time is merged at once if
    the pattern surely leaves it whole or cuts it at its line ends and before
    its last marks only; any other is None and kept in ``odd`` until learned."""

    def __init__(self, merge):
        self.merge, self.odd, self.missed = merge, set(), 0

    def __missing__(self, part: str) -> bytes | None:
        if part[0] == " " and part[1:].isalpha():
            ids = self._merged(part)
        elif "\n" in part:
            line, end, rest = part.partition("\n")
            # no other white space beside the line end
            ids = (self._joined(line, end, rest)
                   if line and rest and not line[-1].isspace() and not rest[0].isspace() else None)
        else:
            word = part.rstrip(MARKS)
            if word == part:
                ids = self._merged(part) if part.isalpha() else None
            elif word == "" or word == " ":
                ids = self._merged(part)
            else:
                ids = self._joined(word, part[len(word):]) if word[word[0] == " ":].isalpha() else None
        if ids is None:
            self.odd.add(part)
            self.missed += 1
        else:
            self[part] = ids
        return ids

    def _joined(self, *parts: str) -> bytes | None:
        found = [self[p] for p in parts]
        return None if None in found else b"".join(found)

    def _merged(self, piece: str) -> bytes | None:
        """A piece of the pattern, spelt byte by byte.  Letters beyond Latin-1
        are left to the library, which may know others than Python."""
        if piece.isascii():
            spelt = piece.replace(" ", SPACE)
        else:
            try:
                piece.encode("latin-1")
            except UnicodeEncodeError:
                return None
            spelt = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()


class Encoder:
    """Encodes texts by one tokenizer file; ids come as little-endian unsigned
    32-bit numbers in bytes.  Special strings inside texts are their own ids,
    as the library has it by default, or with ``special`` off plain text."""

    def __init__(self, path: str, special: bool = True, most: int = MOST_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {s: array("I", [i]).tobytes() for s, i in special_strings(self.tokenizer).items()} if special else {}
        self.apart = special_pattern(self.special)
        self.tokenizer.encode_special_tokens = True     # for the parts between them
        self.most = most
        self.merge = self.tokenizer.model.tokenize
        self.known = _Known(self.merge)
        # bytes that each id stands for: a byte-level vocabulary spells each
        # byte as one character
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.sizes = np.array([len(n) for n in names], np.int64)
        self._learn({"\n"})

    def _learn(self, parts: set[str]) -> None:
        """Cut by the vocabulary's pattern; what is new among the pieces goes
        to the library, and a part's ids are those of its pieces.  Pieces that
        are a space and letters are encoded many in one text, which the pattern
        cuts between them, and told apart by the bytes their ids stand for."""
        known, new, ended, cut = self.known, set(), [], []
        for p in parts:
            if p[0] == " " and p[1:].isalpha():
                new.add(p)
            elif p[0] == " " and p[-1] in ".,;:!?" and p[1:-1].isalpha():
                new.add(p[:-1])
                ended.append(p)
            else:
                pieces = PATTERN.findall(p)
                new.update(pieces)
                cut.append((p, pieces))
        new.update(".,;:!?")
        new.difference_update(known)
        # a space and ASCII letters: the library's merges take them as they
        # are, with the space in the vocabulary's spelling
        simple = [p for p in new if p[0] == " " and p.isascii() and p[1:].isalpha()]
        merge = self.merge
        for p in simple:
            known[p] = array("I", [t.id for t in merge(SPACE + p[1:])]).tobytes()
        new.difference_update(simple)
        plain = [p for p in new if p[0] == " " and p[1:].isalpha()]
        odd = list(new.difference(plain))
        for piece, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            known[piece] = array("I", e.ids).tobytes()
        for lo in range(0, len(plain), 200):
            some = plain[lo:lo + 200]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in some])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            raw, first = ids.tobytes(), 0
            for piece, end in zip(some, (cuts * 4).tolist()):
                known[piece] = raw[first:end]
                first = end
        for p in ended:
            known[p] = known[p[:-1]] + known[p[-1]]
        for p, pieces in cut:
            known[p] = b"".join([known[x] for x in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text.  Nothing here refers to itself, so Python's
        search for cycles among millions of small objects is left out."""
        on = gc.isenabled()
        gc.disable()
        try:
            marked = {i: self.apart.split(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
            out = self._encode([t if i not in marked else "" for i, t in enumerate(texts)] if marked else texts)
            for i, some in marked.items():
                plain = iter(self._encode(some[::2]))
                out[i] = b"".join(self.special[x] if k % 2 else next(plain) for k, x in enumerate(some))
            return out
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        known, before, get, out, late = self.known, len(self.known), self.known.__getitem__, [], []
        for i, text in enumerate(texts):
            parts, missed = cut_parts(text), known.missed
            ids = list(map(get, parts))
            if known.missed > missed:                    # some parts are not learned yet
                late.append((i, parts))
                out.append(ids)
            else:
                out.append(b"".join(ids))
        if late:
            odd, known.odd = known.odd, set()
            self._learn(odd)
            for i, parts in late:
                out[i] = b"".join([known[p] if x is None else x for p, x in zip(parts, out[i])])
        if len(known) > self.most:
            for part in list(itertools.islice(reversed(known), len(known) - max(before, self.most))):
                del known[part]
        return out


def encoder(path: str, special: bool = True, most: int = MOST_PARTS) -> Encoder:
    """The worker's encoder for ``path``, which remembers ``most`` parts."""
    store = sys.__dict__.setdefault("_llm_encoders", {})  # outlives one task's copy of this module
    if (path, special) not in store:
        store[path, special] = Encoder(path, special, most)
    return store[path, special]


def text_groups(texts: list[str], most: int = 4 << 20):
    """Runs of rows with about ``most`` characters: (first, end)."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def vocabulary() -> str:
    """The vocabulary that the registered queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
