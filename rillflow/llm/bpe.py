"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

A byte-pair encoding of a string has a prefix property: whether a token can end
at a place depends only on the token that ends where it starts.  So every
prefix has one last token, found by trying the vocabulary's tokens that end
there against the state at their start (just one fits); the encoding is read
back along these states.  Prefixes are nodes of a trie of the distinct words;
its depth-first order is the sorted order of the words, so the traversal keeps
one stack of states and a word starts from the depth it shares with the word
before: a shared prefix is computed once.

Texts are split into words by the vocabulary's own pattern; the encodings of
distinct words are kept in caches bounded in entries and characters in each
Python worker.  Special tokens' strings in a text become their ids, as in the
tokenizers library's default.

Which characters are letters, and their lower case, differs between versions of
Unicode.  Where only ids are wanted (``LibraryBpe``) each new character beyond
ASCII is tried on the library itself; texts with one that the library takes
otherwise are encoded by the whole library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, map_batches, texts_of

#: Unicode white space as the library's pattern engine has it, and the two splitting patterns.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

#: Words, runs and pairs of tokens that a worker keeps; at the bound a cache starts anew.
CACHE_WORDS, CACHE_RUNS, CACHE_PAIRS = 500_000, 800_000, 1_000_000
#: What str.split() takes for a space but the patterns don't.
ODD = regex.compile("[\x1c-\x1f]")
#: Marks the end of a word; no UTF-8 text holds this byte.
END = 0xFF


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


class Coder:
    """Splits texts into words as one vocabulary file of the tokenizers library has it (byte-level BPE, with or without a word-end suffix), and keeps the words' encodings; how a word is encoded is up to ``code_words``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = bool(spec["model"].get("end_of_word_suffix"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self.pieces = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = Cache(CACHE_WORDS)  # words, as the pattern splits them
        self.runs = Cache(CACHE_RUNS)  # what stands between spaces
        self.load(spec["model"])

    def load(self, model: dict) -> None:
        raise NotImplementedError

    def code_words(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the distinct words."""
        raise NotImplementedError

    def coded(self, words: set[str]) -> dict[str, bytes]:
        """The encodings of words, new ones put into the cache."""
        out = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in out]
        for w, ids in zip(new, self.code_words(new), strict=True):
            packed = out[w] = array("I", ids).tobytes()
            if self.known.room(len(w)):
                self.known[w] = packed
        return out

    def coded_runs(self, runs: set[str]) -> dict[str, bytes]:
        out = {r: self.runs[r] for r in runs if r in self.runs}
        lead = "" if self.suffix else " "
        split = {r: self.pattern.findall(lead + r) for r in runs if r not in out}
        get = self.coded({w for ws in split.values() for w in ws}).__getitem__
        for r, ws in split.items():
            packed = out[r] = b"".join(map(get, ws))
            if self.runs.room(len(r)):
                self.runs[r] = packed
        return out

    # -- texts -----------------------------------------------------------
    def prepare(self, text: str) -> str:
        """Normalised as the vocabulary asks for."""
        if self.suffix:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by single characters, as the library has it
            text = text.lower()
        return text

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """Words before, and runs from the first space on.

        No word of the patterns goes past a space but by starting with it, so
        runs between spaces are encoded on their own.  Where that doesn't hold
        (two spaces, separators that Python alone takes for spaces), the
        pattern splits the whole text.
        """
        text = self.prepare(text)
        if self.suffix:
            return ([], text.split()) if not ODD.search(text) else (self.pattern.findall(text), [])
        if "  " in text:
            return self.pattern.findall(text), []
        first, *runs = text.split(" ")
        return self.pattern.findall(first), runs

    def parts(self, text: str) -> list[str | int]:
        """Stretches of text, and ids of special tokens."""
        if self.pieces is None or "<|" not in text:
            return [text]
        return [self.special[p] if k % 2 else p for k, p in enumerate(self.pieces.split(text))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 64):
            split = [[p if isinstance(p, int) else self.split(p) for p in self.parts(t)] for t in texts[at : at + 64]]
            words: set[str] = set()
            runs: set[str] = set()
            for parts in split:
                for p in parts:
                    if not isinstance(p, int):
                        words.update(p[0])
                        runs.update(p[1])
            get, get_run = self.coded(words).__getitem__, self.coded_runs(runs).__getitem__
            for parts in split:
                out.append(b"".join(struct.pack("<I", p) if isinstance(p, int) else b"".join((*map(get, p[0]), *map(get_run, p[1]))) for p in parts))
        return out


class TrieBpe(Coder):
    """Encoder and decoder by the traversal."""

    def load(self, model: dict) -> None:
        alphabet = _byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            if suffix and token.endswith(suffix):
                return bytes(alphabet[c] for c in token[: -len(suffix)]) + bytes([END])
            return bytes(alphabet[c] for c in token)

        self.vocab: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.ranks: dict[int, tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], (k, self.vocab[a + b]))
        # tokens by their bytes from the last to the first: byte -> (token or -1, what may come before)
        self.ends: dict[int, tuple[int, dict]] = {}
        for t in sorted(self.vocab, key=len):
            if END in t[: max(1, len(t) - self.suffix)]:  # no text has this byte
                continue
            node = self.ends
            for b in t[:0:-1]:
                node = node.setdefault(b, (-1, {}))[1]
            old = node.get(t[0])
            node[t[0]] = (self.vocab[t], old[1] if old else {})
        self._pairs: dict[int, bool] = {}
        self._spines: dict[int, tuple] = {}

    # -- pairs of tokens -------------------------------------------------
    def spines(self, token: int) -> tuple[bool, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Whether a token's bytes encode as just it; the last and the first unit while they do, each with the ranks at which it came and went."""
        known = self._spines.get(token)
        if known is None:
            data = self.bytes[token]
            units = [data[i : i + 1] for i in range(len(data))]
            if self.suffix and data[-1] == END:
                units[-2:] = [data[-2:]]
            ids = [self.vocab[u] for u in units]
            right, left = [(ids[-1], -1)], [(ids[0], -1)]
            while len(ids) > 1:
                best = min(((self.ranks[p], i) for i, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:], strict=False)) if p in self.ranks), default=None)
                if best is None:
                    break
                (rank, new), i = best
                ids[i : i + 2] = [new]
                if i == len(ids) - 1:
                    right.append((new, rank))
                if i == 0:
                    left.append((new, rank))
            spans = [[(t, born, x[k + 1][1] if k + 1 < len(x) else 1 << 60) for k, (t, born) in enumerate(x)] for x in (right, left)]
            known = self._spines[token] = (ids == [token], *spans)
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (a < 0: b starts the word): no merge across their border comes before those inside."""
        key = (a + 1) << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self.spines(b)[0]
            if known and a >= 0:
                for x, came, went in self.spines(a)[1]:
                    for y, came_y, went_y in self.spines(b)[2]:
                        r = self.ranks.get(x << 20 | y)
                        # of equal merges the leftmost goes first
                        if r is not None and came < r[0] < went and came_y < r[0] <= went_y:
                            known = False
            self._pairs[key] = known
        return known

    # -- the trie --------------------------------------------------------
    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words (with END where the vocabulary marks word ends), by one depth-first traversal."""
        out: dict[bytes, list[int]] = {}
        ends, follows, pairs = self.ends, self.follows, self._pairs
        last: list[int] = [-1]  # last[i]: the token that ends at depth i of the current path; -1 at the root, -2 where none can
        before = b""
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                found, node = -2, ends
                for j in range(i - 1, -1, -1):
                    step = node.get(word[j])
                    if step is None:
                        break
                    token, node = step
                    if token >= 0:
                        state = last[j]
                        if state > -2:
                            ok = pairs.get((state + 1) << 20 | token)
                            if ok or (ok is None and follows(state, token)):
                                found = token  # only one can
                                break
                last.append(found)
            ids, at = [], n
            while at:
                token = last[at]
                ids.append(token)
                at -= len(self.bytes[token])
            out[word] = ids[::-1]
            before = word
        return out

    def code_words(self, words: list[str]) -> Iterator[list[int]]:
        end = bytes([END]) if self.suffix else b""
        raw = [w.encode() + end for w in words]
        return map(self.encode_words(raw).__getitem__, raw)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD.  For vocabularies without a word-end suffix."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Runs(Cache):
    """Runs between spaces and their ids' bytes, made when first met: one look-up a run, whatever its text."""

    def __init__(self, coder: LibraryBpe):
        super().__init__(CACHE_RUNS)
        self.coder = coder

    def __missing__(self, run: str) -> bytes:
        if self.coder.suffix and run[:-1].isalpha() and run[-1] in ".,;:!?":  # the most usual runs need no pattern
            made = self[run[:-1]] + self[run[-1]]
        elif self.coder.suffix and run.isalpha():
            made = self.coder.word(run)
        else:
            made = b"".join(map(self.coder.word, self.coder.pattern.findall(run if self.coder.suffix else " " + run)))
        if self.room(len(run)):
            self[run] = made
        return made


class LibraryBpe(Coder):
    """Encoder by the tokenizers library's own merges, word by word: where only the ids are wanted, several times faster."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.runs = Runs(self)
        self.usual: dict[str, bool] = {}  # characters beyond ASCII, and whether the library takes them as we do

    def load(self, model: dict) -> None:
        self.letters = {b: c for c, b in _byte_alphabet().items()}

    def mapped(self, w: str) -> str:
        return w.encode().decode("latin-1").translate(self.letters)

    def word(self, w: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(w if w.isascii() and w.isalnum() else self.mapped(w))]).tobytes()

    def alike(self, c: str) -> bool:
        """Whether the library normalises a character and splits next to it as we do.  What this Python's Unicode doesn't know counts as unlike, as it may combine with others."""
        own = self.usual.get(c)
        if own is None:
            own = unicodedata.category(c) != "Cn"
            for probe in (f"a{c}a", f"1{c}1", f"-{c}-", c + c):
                norm = self.prepare(probe)
                if self.library.normalizer is not None:
                    own = own and " ".join(norm.split()) == " ".join(self.library.normalizer.normalize_str(probe).split())
                if self.library.pre_tokenizer is not None:
                    own = own and list(map(self.mapped, self.pattern.findall(norm))) == [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
            self.usual[c] = own
        return own

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.runs.__getitem__
        for text in texts:
            if not text.isascii() and not all(map(self.alike, {c for c in set(text) if c > "\x7f"})):
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            made = []
            for p in self.parts(text):
                if isinstance(p, int):
                    made.append(struct.pack("<I", p))
                else:
                    words, runs = self.split(p)
                    made += map(self.word, words)
                    made += map(get, runs)
            out.append(b"".join(made))
        return out


@functools.cache
def coder(path: str) -> TrieBpe:
    """One coder a path and worker."""
    return TrieBpe(path)


@functools.cache
def library_coder(path: str) -> LibraryBpe:
    return LibraryBpe(path)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text encoded and decoded: number of tokens and digests of both.  Null text counts as empty: no tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            ids = code.encode_batch(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(code.decode(x).encode()).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, ENCODED)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's token ids as an array."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in code.encode_batch(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id long, ids array<long>")
