"""Exact, memoised use of a tokenizer: texts are cut where no token can cross, each distinct piece is encoded once.

The ids are those of the ``tokenizers`` library for the whole text. The file itself
says which cuts are proven safe (``kind_of`` reads its normaliser and splitter):

* ``words`` (as word_bpe_49k): the normaliser turns white space into a space and the
  splitter drops white space, so tokens never cross it, and neither composition
  (NFC) nor lower-casing looks across white space.
* ``spaces`` (as byte_bpe_50k): the splitter takes at most one leading space into a
  word, and a single line feed between two characters that aren't white space is a
  token of its own. So the text may be cut around such a line feed, and before a
  space that follows a character and precedes a character, none of them white
  space. A text with any other white space (tabs, runs of spaces, edges) is
  encoded whole.
* In both, a run of ASCII punctuation at a piece's end is split from the letter or
  digit before it; ``words`` also lower-cases, so an ASCII piece shares its ids with
  its lower-case form.
* ``whole``: any other file. Texts are encoded by the library as they are.

Texts that hold the start of a special token's string are encoded whole.
Memory is bounded: a memo of more than ``MOST`` pieces keeps the half used most.
"""

from __future__ import annotations

import gc
import json
import re
import string
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 600_000
#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{WHITE}]+")
#: White space other than single inner spaces and line feeds, and the mark that cuts.
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\0")
_ODD_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPECIAL = "<|"
#: Letters alone are one word to both splitters, and composed already: only the model's merges remain to be applied.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

#: Whether a byte is ASCII punctuation; whether it is an ASCII letter or digit.
_SIGN = np.array([chr(b) in string.punctuation for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Fixed value: the splitter of ``words`` files.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's sign for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def kind_of(path: str) -> str:
    """Which cuts a tokenizer file allows: words, spaces or whole."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, normal, split = told["model"], told.get("normalizer"), told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix")
    plain = plain and not told.get("truncation") and not told.get("padding")
    plain = plain and all(t["content"].startswith(SPECIAL) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens", []))
    if plain and normal is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not model.get("end_of_word_suffix"):
        return "spaces"
    if plain and normal and normal["type"] == "Sequence" and split.get("type") == "Sequence":
        steps = [(n["type"], (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in normal["normalizers"]]
        parts = [(p["type"], (p.get("pattern") or {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("use_regex")) for p in split["pretokenizers"]]
        if steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and parts == [("Split", _WORDS, "Removed", True, None), ("ByteLevel", None, None, None, False)]:
            return "words"
    return "whole"


class Store:
    """Pieces and their ids: a dict to numbers, the ids in one flat array."""

    def __init__(self, dtype: np.dtype):
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.hits = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])

    def add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.index), len(pieces)
        at = int(self.starts[n])
        self.index.update(zip(pieces, range(n, n + m), strict=True))
        self.ids, self.starts, self.hits = self._room(self.ids, at + len(ids)), self._room(self.starts, n + m + 1), self._room(self.hits, n + m + 1)
        self.ids[at : at + len(ids)] = ids
        self.starts[n + 1 : n + m + 1] = at + np.cumsum(lengths)
        self.hits[n : n + m] = 0

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of these pieces in turn."""
        n = self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(n)
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.starts[which] - ends + n, n)], ends

    def halve(self) -> None:
        """Keep the half of the pieces that was used most."""
        n = len(self.index)
        keep = np.sort(np.argpartition(-self.hits[:n], n // 2)[: n // 2])
        ids, ends = self.gather(keep)
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        hits = self.hits[keep] // 2
        self.ids, self.starts = ids, np.concatenate([[0], ends])
        self.hits = np.concatenate([hits, [0]])


class PieceEncoder:
    """Encodes texts to little-endian unsigned ids, 2 or 4 bytes each as the vocabulary needs."""

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.most = Tokenizer.from_file(path), kind_of(path), most
        self.top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = np.dtype("<u2" if self.top < 1 << 16 else "<u4")
        self.store = Store(self.dtype)
        self.model, signs = self.tokenizer.model, byte_letters()
        self.space = signs[0x20]
        self.signs = {c: "".join(signs[b] for b in chr(c).encode()) for c in [0x20, *range(0xC0, 0x100)]}

    def raw(self, texts: list[str]) -> list[bytes]:
        """The ids by the library alone."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts) -> list[bytes]:
        """The ids of every text as bytes; null and empty texts have none."""
        return [x.tobytes() for x in self.stream(texts)]

    def stream(self, texts, chars: int = 4 << 20, lean: bool = False):
        """An array of ids for one text after the other; memory is bounded by the longest text and ``chars``.

        lean: Arrow's memory pool, which else keeps the pages of past blocks, hands them back after each.
        """
        block, held = [], 0
        for t in texts:
            block.append(t or "")
            held += len(t or "")
            if held >= chars:
                yield from self._block(block)
                block, held = [], 0
                if lean:
                    pa.default_memory_pool().release_unused()
        yield from self._block(block)
        if lean:
            pa.default_memory_pool().release_unused()

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.store.index) > self.most:
            self.store.halve()
        cut = {"words": self._words, "spaces": self._spaces, "whole": lambda t: None}[self.kind]
        out: list[np.ndarray | None] = [None] * len(texts)
        marked, at = [], []
        for i, t in enumerate(texts):
            m = None if SPECIAL in t or "\0" in t or not t else cut(t)
            if m is None:
                out[i] = np.frombuffer(self.raw([t])[0], self.dtype) if t else np.empty(0, self.dtype)
            else:
                marked.append(m)
                at.append(i)
        if not marked:
            return out
        last = np.cumsum([m.count("\0") + 1 for m in marked])
        coded = pc.split_pattern(pa.array(["\0".join(marked)], pa.large_string()), "\0").values.dictionary_encode()
        del marked
        got = self._known(coded.dictionary).take(coded.indices)
        ids = np.frombuffer(got.buffers()[2] or b"", self.dtype)
        last = np.frombuffer(got.buffers()[1], np.int32)[last] // self.dtype.itemsize
        for i, lo, hi in zip(at, [0, *last[:-1]], last, strict=True):
            out[i] = ids[lo:hi]
        return out

    def _known(self, pieces: pa.Array) -> pa.Array:
        """Each distinct piece's ids, as an array of binaries. Signs at the end and capitals are taken off on the bytes of all pieces at once."""
        n = len(pieces)
        off = np.frombuffer(pieces.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: off[-1]]
        size = np.diff(off)
        full = np.flatnonzero(size)
        cut = off[1:].copy()
        # where the run of signs at the end begins: after the last byte that is none
        body = np.where(_SIGN[data], -1, np.arange(len(data)))
        body = np.maximum.reduceat(body, off[full]) if len(full) else body[:0]
        some = (body >= 0) & (body + 1 < off[full + 1])
        at, which = body[some], full[some]
        letter = _ALNUM[data[at]] | (at > off[which]) & (data[at - 1] == 0xC3) & (data[at] >= 0x80) & (data[at] != 0x97) & (data[at] != 0xB7)
        cut[which[letter]] = at[letter] + 1
        inside = np.arange(len(data)) < np.repeat(cut, size)
        base, signs = data[inside], data[~inside]
        base_off = np.concatenate([[0], np.cumsum(cut - off[:-1])])
        if self.kind == "words":
            wide = np.concatenate([[0], np.cumsum(base > 127)])
            plain = wide[base_off[1:]] == wide[base_off[:-1]]
            base = base + 32 * ((base >= 65) & (base <= 90) & np.repeat(plain, np.diff(base_off))).astype(np.uint8)
        parts = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(np.concatenate([base_off, base_off[-1] + np.cumsum(off[1:] - cut)])), pa.py_buffer(np.concatenate([base, signs])))
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and a collection walks the whole memo
        known = np.fromiter(map(self.store.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            begin = len(self.store.index)
            known[new[self._learn([names[i] for i in new.tolist()])]] = np.arange(begin, begin + len(new))
        if collects:
            gc.enable()
        self.store.hits[known] += 1
        # a piece is its body followed by its signs
        ids, ends = self.store.gather(known[coded.indices.to_numpy()].reshape(2, n).T.reshape(-1))
        offsets = np.concatenate([[0], ends[1::2] * self.dtype.itemsize]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Add pieces to the store; gives their positions in the order in which they were added."""
        spaced = self.kind == "spaces"
        plain, wide, rest = [], [], []
        for i, p in enumerate(pieces):
            if not _LETTERS.fullmatch(p, p[:1] == " " and spaced):
                rest.append(i)
            elif p.isascii():
                plain.append(i)
            else:
                wide.append(i)
        tokenize = self.model.tokenize
        text = "\0".join([pieces[i] for i in plain])
        signed = text.replace(" ", self.space).split("\0") if plain else []
        signed += [(pieces[i] if spaced else pieces[i].lower()).translate(self.signs) for i in wide]
        lists = [[t.id for t in tokenize(p)] for p in signed]
        lists += [e.ids for e in self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)]
        order = np.array(plain + wide + rest)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.store.add([pieces[i] for i in order.tolist()], np.fromiter(chain.from_iterable(lists), self.dtype, int(lengths.sum())), lengths)
        return order

    @staticmethod
    def _words(text: str) -> str:
        """The text with the mark between its words; an empty piece has no ids."""
        if any(x in text for x in _ODD_ASCII) or not text.isascii() and _ODD_WIDE.search(text):
            return _WHITE.sub("\0", text)
        return text.replace("\n", "\0").replace(" ", "\0")

    @staticmethod
    def _spaces(text: str) -> str | None:
        """The text with the mark at each proven cut; None: none is proven."""
        if any(x in text for x in _ODD_ASCII) or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and _ODD_WIDE.search(text):
            return None
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ")


@lru_cache(2)
def encoder(path: str, most: int = MOST) -> PieceEncoder:
    """One encoder a worker process: its memo outlives the tasks, its size stays bounded."""
    return PieceEncoder(path, most)


def columns(batches, rows: int = 256):
    """Tuples of the Arrow batches' values, of few rows at a time as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def arrow(frame, schema: str) -> pa.RecordBatch:
    """A pandas frame as an Arrow batch of a schema of long, int, double, string and boolean columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.Array.from_pandas(frame[n], type=kinds[k]) for n, k in fields], names=[n for n, _ in fields])
