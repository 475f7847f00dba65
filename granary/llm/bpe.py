"""BPE encoding by backtracking over longest token matches, and decoding through an offset table.

A piece of text (what the pre-tokenizer keeps) is encoded from left to right: at each place the longest
token that starts there (all matches come from one Aho-Corasick pass) is tried; it may follow the token before
only if the pair is compatible, that is, if merging by rank would leave the border between the two alone.
A token that doesn't fit gives way to the next shorter one, and where none is left the last token is taken back.
Places that turned out to be dead ends are remembered, so each is tried once: time is linear in the piece. The
result is what merging by rank gives, for any vocabulary in which each merge makes a token of its own.

Where the vocabulary's normalizer and pre-tokenizer are the ones whose pieces never span white space (`WORDS`), texts of any
script are handled word by word, with a cache per Python worker that is bounded in bytes: a word that is new goes through the file's
own normalizer and pre-tokenizer, and its pieces through the encoder. With any other normalizer or pre-tokenizer these two see
whole texts, and the pieces are cached.

Defined cases: null text is the empty text, with no id; null or repeated ids are kept, one row each; an empty
table gives an empty result; extra columns are ignored. Whole texts are taken.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from granary.llm.common import SLICE_BYTES, slices, text_buffers

#: Entries that each generation of a Python worker's caches of words and of pieces keeps, at ENTRY bytes on average. A
#: worker that serves other operators too does with fewer (`cache` of `encode`).
CACHE, ENTRY = 600_000, 200
#: Texts of these characters alone are lowered and split here; all are composed (NFC) and lower to one character.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įĲ-ſ]*")
#: Fixed value: the pattern of a pre-tokenizer that drops white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_split() -> re.Pattern[str]:
    """PATTERN for lowered plain texts: its classes are spelled out, which the standard library matches several times faster."""
    plain = [c for c in map(chr, range(0x180)) if _PLAIN.fullmatch(c)]
    letters, numbers = ("".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile(PATTERN.replace(r"\s\p{L}\p{N}", r"\s" + letters + numbers).replace(r"\p{L}", letters).replace(r"\p{N}", numbers))


_PLAIN_SPLIT = _plain_split()
#: The normalizer and pre-tokenizer of vocabularies whose texts may be handled word by word.
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def default_vocabulary() -> str:
    """Path of the public vocabulary (a parameter of all functions here)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and tables of a byte-level BPE file, with or without an end-of-word suffix. Decoding joins tokens by a space
    (a file without decoder) or joins their bytes (one with the byte-level decoder)."""

    def __init__(self, path: str):
        import ahocorasick

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        decoder = spec.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError(f"decoder {decoder['type']} is unknown")
        self.spaced = decoder is None
        self.by_words = (spec.get("normalizer"), spec.get("pre_tokenizer")) == WORDS
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max([*ids.values(), *self.special.values()]) + 1
        names = [""] * self.size
        for token, k in ids.items():
            names[k] = token
        for token, k in self.special.items():
            names[k] = token
        self.names = names
        # a token's parts, and the token a pair makes; a token no merge makes is its own part
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.made: dict[tuple[int, int], int] = {}
        self.rank = [-1] * self.size
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = ids[a + b]
            if self.rank[token] >= 0:
                raise ValueError("two merges make the same token; the backtracking encoder needs one each")
            self.left[token], self.right[token], self.rank[token] = ids[a], ids[b], rank
            self.made[ids[a], ids[b]] = token
        self.letters = byte_letters()
        mark = ""  # the end of a word as one character of the automaton
        self.mark = mark if self.suffix else ""
        self.automaton = ahocorasick.Automaton()
        for token, k in ids.items():
            shape = token[: -len(self.suffix)] + mark if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token
            self.automaton.add_word(shape, (len(shape), k))
        self.automaton.make_automaton()
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)
        self._offsets: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank, given the tokens a and b side by side, leaves their border alone.

        Walk back through the merges inside both tokens from the last to the first. The parts that touch at the
        border must not form a pair that would have merged before the merge that hides one of them.
        """
        rank, made = self.rank, self.made
        until = len(rank)  # the pair at the border must not merge before this rank
        while True:
            token = made.get((a, b))
            if token is not None and rank[token] < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # undo the later merge: of equal ranks (the same token twice) the right one came later
            if rank[a] > rank[b]:
                until = rank[a]
                a = self.right[a]
            else:
                until = rank[b] + 1
                b = self.left[b]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        letters = self.letters
        return self.encode_letters("".join([letters[x] for x in piece.encode()]))

    def encode_letters(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as the letters of its bytes."""
        text = piece + self.mark
        n = len(text)
        if n == len(self.mark):
            return []
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(text):
            starts[end - length + 1].append((length, token))  # longer ones come later
        path: list[tuple[int, int]] = []  # (token, place in the list of its start)
        at, choice, last = 0, len(starts[0]) - 1, -1
        dead = set()
        places = [0]
        while at < n:
            options = starts[at]
            while choice >= 0:
                length, token = options[choice]
                if at + length not in dead and (last < 0 or self.compatible(last, token)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((token, choice))
                at += length
                places.append(at)
                last = token
                choice = len(starts[at]) - 1 if at < n else -1
            else:
                dead.add(at)
                if not path:
                    raise ValueError(f"no tokens for {piece!r}")
                _, choice = path.pop()
                places.pop()
                at = places[-1]
                last = path[-1][0] if path else -1
                choice -= 1
        return [token for token, _ in path]

    def table(self, what: str) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of each id's string: its decimal digits and a space, or its name (and a space, or as the bytes it stands for)."""
        if what not in self._offsets:
            if what == "name" and not self.spaced:
                back = {c: x for x, c in enumerate(self.letters)}
                rows = [bytes([back[c] for c in n]) if all(c in back for c in n) else n.encode() for n in self.names]
            else:
                rows = [f"{self.names[k] if what == 'name' else k} ".encode() for k in range(self.size)]
            data = np.frombuffer(b"".join(rows), np.uint8)
            self._offsets[what] = data, np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return self._offsets[what]

    def spelled(self, ids: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
        """The strings of the ids one after another, each with its space, and where each ends: a gather through the offsets."""
        data, offsets = self.table(what)
        begin = offsets[ids]
        length = offsets[ids + 1] - begin
        ends = np.cumsum(length)
        where = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        where += np.repeat(begin - (ends - length), length)
        return data[where], ends

    def decoded(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8, through the offset table."""
        data = bytes(self.spelled(np.asarray(ids, np.int64), "name")[0])
        return data[:-1] if self.spaced else data.decode("utf-8", "replace").encode()

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Cache(dict):
    """What `make` gives for a key, in two generations of entries: a full cache becomes the old one, from which what is still used
    comes back."""

    def __init__(self, most: int, make: Callable[[str | bytes], bytes]) -> None:
        super().__init__()
        self.most, self.size, self.make = most * ENTRY, 0, make
        self.old: dict = {}

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.size += len(key) + len(value) + 150
        return value

    def turn(self) -> None:
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by cached words and pieces; pieces are encoded by backtracking or by the library."""

    def __init__(self, path: str, backtrack: bool = True, cache: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.backtrack = backtrack
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = vocabulary(path)
        most = cache or CACHE
        # pieces of plain texts (lower case), words of other texts (UTF-8, as they stand), pieces (letters of their bytes)
        self.words, self.raw, self.pieces = _Cache(most, self._word), _Cache(most, self._any_word), _Cache(most, self._coded)

    def _coded(self, letters: str) -> bytes:
        """Ids of a piece, given as the letters of its bytes."""
        ids = self.vocabulary.encode_letters(letters) if self.backtrack else [t.id for t in self.library.model.tokenize(letters)]
        return array("I", ids).tobytes()

    def _word(self, piece: str) -> bytes:
        """Of a plain text."""
        letters = self.vocabulary.letters
        return self._coded(piece if piece.isascii() else "".join([letters[x] for x in piece.encode()]))

    def _any_word(self, word: bytes) -> bytes:
        text = word.decode()
        return self._plain(text) if _PLAIN.fullmatch(text) else self._pieces(text)

    def _plain(self, text: str) -> bytes:
        """A text of plain characters: the normalizer only lowers it, the pre-tokenizer splits it by PATTERN."""
        return b"".join(map(self.words.__getitem__, _PLAIN_SPLIT.findall(text.lower())))

    def _pieces(self, text: str) -> bytes:
        """Through the file's own normalizer and pre-tokenizer."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return b"".join([self.pieces[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def _part(self, text: str) -> bytes:
        """A text without special tokens."""
        if not self.vocabulary.by_words:
            coded = self._pieces(text)
        elif _PLAIN.fullmatch(text):
            coded = self._plain(text)
        else:  # word by word: bytes are split at ASCII white space alone; what else counts as white space is up to the normalizer
            coded = b"".join(map(self.raw.__getitem__, text.encode().split()))
        for cache in (self.words, self.raw, self.pieces):
            cache.turn()
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        out = []
        for text in texts:
            if any(x in text for x in special):
                parts = self.vocabulary.split_special.split(text)
                out.append(b"".join([np.array([special[p]], "<u4").tobytes() if p in special else self._part(p) for p in parts]))
            else:
                out.append(self._part(text))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, backtrack: bool, cache: int | None = None) -> Encoder:
    """One for each Python worker, with its cache."""
    return Encoder(path, backtrack, cache)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts), null as empty, at most about a megabyte at a time."""
    _, offsets = text_buffers(column)
    for a, b in slices(offsets, SLICE_BYTES):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id",), cache: int | None = None) -> DataFrame:
    """columns, n_tokens, ids (array<int>), decoded_chars (code points that the ids decode to): the general interface."""
    path = path or default_vocabulary()
    schema = docs.select(*columns).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            words = vocabulary(path)
            for a, b, texts in text_slices(batch.column(at)):
                coded = encoder(path, True, cache).encode(texts)
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                counts = np.array([len(x) // 4 for x in coded])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                if words.spaced:  # all texts at once: code points of the decoded bytes, but for the last space
                    data, ends = words.spelled(flat.astype(np.int64), "name")
                    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[np.append(0, ends)]
                    decoded = chars[offsets[1:]] - chars[offsets[:-1]] - (counts > 0)
                else:
                    decoded = np.array([len(words.decode(flat[i:j])) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[a:b] for k in range(at)]
                    + [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat)), pa.array(decoded, pa.int64())],
                    names=[*columns, "n_tokens", "ids", "decoded_chars"],
                )

    return docs.select(*columns, "text").mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns; ids and decoded texts are made and hashed slice by slice."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = vocabulary(path)
            for a, b, texts in text_slices(batch.column(1)):
                rows = []
                for data in encoder(path, True).encode(texts):
                    ids = np.frombuffer(data, "<u4").astype(np.int64)
                    decimal, decoded = hashlib.sha256(), hashlib.sha256()
                    step = 1 << 16
                    for k in range(0, len(ids), step):
                        part = ids[k : k + step]
                        cut = -1 if k + step >= len(ids) else None
                        decimal.update(words.spelled(part, "digits")[0][:cut])
                        if words.spaced:
                            decoded.update(words.spelled(part, "name")[0][:cut])
                    if not words.spaced:
                        decoded.update(words.decoded(ids))
                    rows.append((len(ids), decimal.hexdigest(), decoded.hexdigest()))
                n, decimals, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(decimals), pa.array(names)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGEST)
