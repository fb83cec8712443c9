"""Token ids of whole texts by the tokenizers library, with a bounded cache of the units between single spaces.

Both tokenizers end a token before a space that stands between two characters that are no white space (the byte-level
one keeps the space at the head of the next token, the lower-casing one drops it), so a text's ids are the ids of its
units, joined. Units that the cache lacks are encoded by the library in one batch; a text with runs of white space is
cut only at such single spaces. A text that holds a special token's string, in any case, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from . import common

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_RUN = re.compile(r"\s\s")
_loaded: dict[tuple, "UnitEncoder"] = common.cached({})


class UnitEncoder:
    """ids(texts) -> one uint32 array a text. ``drops_space``: the tokenizer drops all white space and lower-cases."""

    def __init__(self, path: str, drops_space: bool, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)", re.IGNORECASE)
        self.drops_space, self.most = drops_space, most
        self.known: dict[str, bytes] = {}
        # ids of tokens that begin with the byte-level sign of a space
        self.opens = np.zeros(1 << 16, dtype=bool)
        self.opens[[k for t, k in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def encode(self, units: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode_new(self, units: list[str], run: int = 256) -> Iterator[tuple[str, bytes]]:
        """Each unit with its ids. Where tokens keep the space, ``run`` units that are one space and then no white space
        are encoded as one text: each begins at its only token that opens with a space."""
        spaced = [] if self.drops_space else [u for u in units if u[:1] == " " and u.split() == [u[1:]]]
        rest = units if not spaced else list(set(units).difference(spaced))
        parts = [spaced[k : k + run] for k in range(0, len(spaced), run)]
        for part, code in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(code.ids, dtype=np.uint16)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):  # not the expected tokens: each unit by itself
                rest = rest + part
                continue
            data, cuts = ids.tobytes(), [*(2 * at).tolist(), 2 * len(ids)]
            for k, unit in enumerate(part):
                yield unit, data[cuts[k] : cuts[k + 1]]
        yield from zip(rest, self.encode(rest), strict=True)

    def units(self, text: str) -> list[str]:
        if self.drops_space:
            try:  # in Latin-1, lowering first changes nothing: no composition, no context
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ").split(" ")
        if _RUN.search(text) or text[:1].isspace():
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if "\0" not in text else _CUT.split(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = {k: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in enumerate(texts) if self.special.search(t)}
        cut = [[] if k in whole else self.units(t) for k, t in enumerate(texts)]
        known = self.known
        need = {u for units in cut for u in units if u not in known}
        if need:
            if len(known) + len(need) > self.most:
                known.clear()
                need.update(u for units in cut for u in units)
            # an ASCII letter followed by one last comma or point: a token ends between them
            ends = [u for u in need if u[-1:] in ",." and u[-2:-1].isascii() and u[-2:-1].isalpha()]
            need.difference_update(ends)
            need.update(u for u in (*{u[:-1] for u in ends}, ",", ".") if u not in known)
            known.update(self.encode_new(list(need)))
            known.update((u, known[u[:-1]] + known[u[-1]]) for u in ends)
        return [whole[k] if k in whole else np.frombuffer(b"".join(map(known.__getitem__, units)), dtype=np.uint16).astype(np.uint32) for k, units in enumerate(cut)]


def encoder(path: str, drops_space: bool) -> UnitEncoder:
    """One encoder a process, so its cache serves all tasks of a worker, until another operator's task empties it."""
    key = (path, drops_space)
    if key not in _loaded:
        _loaded[key] = UnitEncoder(path, drops_space)
    return _loaded[key]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
