"""Token ids of whole texts by a byte-level BPE tokenizer file, inside Spark tasks.

The tokenizer splits text into pieces before merging bytes, and no piece crosses a space
that follows or precedes a character other than white space. So a text's ids are the
ids of its space-separated words, which are encoded once and remembered. The few
texts with a space between white space are encoded whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a Python worker, which bounds its memory.
WORDS = 700_000
#: Characters of texts encoded at once by callers, about, which bounds their memory.
CHARACTERS = 1 << 23
#: Characters handed to the tokenizer at once.
SLAB = 1 << 11
# letters whose kind no edition of Unicode disputes, and the printable ASCII that is none
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ʯ]+", r"[!-@\[-`{-~]+"
#: A word of letters, then signs, then perhaps a line's end and such a word again: pieces end at each change.
FORM = re.compile(rf"({_LETTERS})({_SIGNS})?(?:\n({_LETTERS})({_SIGNS})?)?")

_tokenizers: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        n = self.tokenizer.get_vocab_size()
        # a byte-level token has one character for each byte
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        # a space before white space or the end; whether white space precedes it too is looked at then
        self.loose = re.compile(r" (?:\s|\Z)")
        self.within = re.compile(r"\s \s|\s \Z")
        # words after a space, those not met since the last change of generation, and parts of words after none
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str], sign: str, into: dict[str, bytes]) -> None:
        """Encode words, each after a sign, in slabs; cut the ids where the words end. A line's end is cut off."""
        if not words:
            return
        lengths = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64) + 1
        slab = (np.cumsum(lengths) - lengths) // SLAB
        edges = [*np.flatnonzero(np.diff(slab, prepend=-1)).tolist(), len(words)]
        skip = 0 if sign == " " else len(self.line_end)
        for at, end in zip(edges, edges[1:]):
            part = words[at:end]
            ids = np.array(self.tokenizer.encode_batch_fast([sign + sign.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths[at:end]), side="left") + 4).tolist()
            raw, last = ids.tobytes(), 0
            for w, c in zip(part, cuts):
                into[w] = raw[last + skip : c]
                last = c

    def _remember(self, words: list[str], first: list[str]) -> None:
        """Have the ids of words, each after a space, in ``known``, and of first words after none in ``parts``."""
        if len(self.known) > WORDS // 2:
            self.before, self.known = self.known, {}
        if len(self.parts) > WORDS // 4:
            self.parts = {}
        known, before, parts = self.known, self.before, self.parts
        new = []
        for w in set(words).difference(known):
            if w in before:
                known[w] = before[w]
            else:
                new.append(w)
        plain, formed, bits = set(), [], set()
        for w in new:
            if not w.isalpha() and (m := FORM.fullmatch(w)):
                found = m.groups()
                formed.append((w, *found))
                if found[0] not in known:
                    plain.add(found[0])
                bits.update(found[1:])
            else:
                plain.add(w)
        for w in set(first).difference(parts):
            if (m := FORM.fullmatch(w)) and m[1] == w:
                bits.add(w)
            else:
                parts[w] = self.whole(w) if w else b""
        bits.discard(None)
        self._learn(list(plain), " ", known)
        self._learn(list(bits.difference(parts)), "\n", parts)
        for w, stem, signs, stem2, signs2 in formed:
            ids = known[stem] + parts[signs] if signs else known[stem]
            if stem2:
                ids += self.line_end + parts[stem2] + (parts[signs2] if signs2 else b"")
            known[w] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty.

        Arrow splits the batch, numbers its words and joins their ids; Python sees each different word once.
        """
        apart = {i for i, t in enumerate(texts) if t and self.loose.search(t) and self.within.search(t)}
        split = pc.split_pattern(pa.array(["" if t is None or i in apart else t for i, t in enumerate(texts)], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        # a text's first word stands after no space
        begins = split.offsets.to_numpy().astype(np.int64)
        first, at = np.unique(codes[begins[:-1]], return_inverse=True)
        firsts = [words[c] for c in first.tolist()]
        gc.disable()  # many small tuples and no cycles
        try:
            self._remember(words, firsts)
        finally:
            gc.enable()
        codes[begins[:-1]] = len(words) + at
        values = pa.array([*map(self.known.__getitem__, words), *map(self.parts.__getitem__, firsts)], pa.large_binary())
        joined = values.take(pa.array(codes))
        _, offsets, ids = joined.buffers()
        cuts = np.frombuffer(offsets, "<i8", len(joined) + 1)[begins].tolist()
        ids = ids.to_pybytes() if ids else b""
        return [self.whole(t) if i in apart else ids[a:b] for i, (t, a, b) in enumerate(zip(texts, cuts, cuts[1:]))]


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some million characters, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]
