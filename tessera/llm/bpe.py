"""Byte-pair encoding and decoding with a contiguous array of adjacent ranks.

A word is a list of part boundaries and, in a second list beside it, the rank
of each adjacent pair. Encoding scans the ranks for the minimum, deletes that
boundary and refreshes the two neighbouring ranks, until no pair has a rank.
Short words fit a few cache lines, so the scan beats any heap; words above
SHORT parts take a heap over linked parts, with the same result.

The codec reads a vocabulary file of the tokenizers library and follows its
normalizer, splitter, byte alphabet, word-end suffix and special tokens.

Defined results: a null or empty text has no ids; decoding no ids gives an
empty text, and null ids count as none; special tokens that are spelled out in
a text become their ids; whole texts of any length are encoded; rows repeat as
often as they come; input columns named like the output are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, tokenizer_path

#: Longest word, in parts, that the rank array handles.
SHORT = 64
#: Bytes that a Python worker's memory of words takes, and that its memory of other pieces takes per generation of two, about.
WORDS, REMEMBERED = 20 << 20, 4 << 20
#: Words whose distinct ones are looked for at once, and bytes of them where they are cut as bytes.
BLOCK, BLOCK_BYTES = 1 << 18, 1 << 22
#: Bytes of one entry besides its piece and ids: two objects and a place in the table.
ENTRY = 200
_NONE = 1 << 30
#: Splitter of byte-level vocabularies whose file says only use_regex (fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters and numbers, as ranges, that the splitter of word vocabularies is too old to know (fixed values: Unicode 16 there).
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686"
    " 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff"
    " 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
).split()

#: Separators that split() takes for white space and the vocabularies do not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A mark between a letter or number and white space is a piece of its own for both splitters.
_MARK = re.compile(r"(?<=[^\W_])([.,;:!?])(?=[ \n]|\Z)")
#: The same by bytes: marks, and letters and numbers.
_MARK_BYTES, _ALNUM_BYTES = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def byte_alphabet() -> list[str]:
    """One printable character for each byte: printable Latin-1 stands for itself, the rest is moved above U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, moved = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], moved = chr(0x100 + moved), moved + 1
    return [out[b] for b in range(256)]


def older(splitter: str) -> str:
    """The splitter with _NEWER taken out of its letters and numbers."""
    newer = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _NEWER)
    return "(?V1)" + splitter.replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]")


#: Lower case of capitals that Python is too old to know: single ones, and (first, last, distance) (fixed values).
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + away for first, last, away in ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)) for c in range(first, last + 1)}
_CAPITAL = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def lower(text: str) -> str:
    """Lower case character by character, blind to a sigma's place in its word."""
    text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
    return text if text.isascii() or not _CAPITAL.search(text) else text.translate(_LOWER)


#: Latin letters end before this one; their kind is the same in all versions of Unicode.
LAST_PLAIN = "\u0250"


def plain_letters(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < LAST_PLAIN)


def may_be_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters whose last bytes, all from 0x80, lie at these places can be white space; some that are none are among them."""
    c, b, a = data[at], data[at - 1], data[at - 2]
    return (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) & ((c < 0x90) | (c == 0x9F) | (c >= 0xA8) & (c < 0xB0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80)


def cuts(data: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """Places in [first, last) of UTF-8 texts, laid side by side, where no piece of the byte-level splitter goes on.

    These are the texts' beginnings, white space after anything else, what comes
    after a line feed between other things, and a mark between a letter or number
    and white space. Not all such places are found, which leaves some words in one.
    """
    found = np.zeros(last - first, bool)
    window = data[first : last + 1]
    at = np.flatnonzero((window == 0x20) | (window - np.uint8(9) < 5)) + first
    before = data[at - 1]
    word = (before > 0x20) & (before < 0x7F)
    high = np.flatnonzero(before >= 0x80)
    word[high] = ~may_be_space(data, at[high] - 1)
    own = at[word]
    found[own[own < last] - first] = True
    after = own[(own < last - 1) & (data[own] == 0x0A)] + 1
    found[after[_ALNUM_BYTES[data[after]] | (data[after] == 0xC3)] - first] = True
    a, b = np.searchsorted(ends, (first, last), "right")
    marks = np.concatenate([at[_MARK_BYTES[before]], ends[a : b + 1]]) - 1
    marks = marks[(marks >= first) & (marks < last)]
    marks = marks[_MARK_BYTES[data[marks]]]
    before, lead = data[marks - 1], data[marks - 2]
    found[marks[_ALNUM_BYTES[before] | (lead == 0xC3) & (before != 0x97) & (before != 0xB7)] - first] = True
    a, b = np.searchsorted(ends, (first, last))
    found[ends[a:b] - first] = True
    if first == 0:
        found[:1] = True
    return np.flatnonzero(found) + first


class Remembered(dict):
    """Results by piece: two generations, so that frequent pieces survive when the young one is full.

    A piece has at most SHORT letters, so entries bound bytes.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.most = make, {}, REMEMBERED // ENTRY

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in specials.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.by_word = spec["normalizer"] is not None
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.by_word else _BYTE_LEVEL
        splitter = older(splitter) if self.by_word else splitter
        self.pieces = regex.compile(splitter).findall
        alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.latin = {b: c for b, c in enumerate(alphabet)}
        self.byte_decoder = spec["decoder"] is not None
        self.blank = self.latin[0x20]
        self.known = Remembered(self.encode_piece)
        self.words: dict[str, bytes] = {}
        self.most_words = WORDS // ENTRY
        self.prepare(path, model["merges"])

    def prepare(self, path: str, merges: list) -> None:
        """Ranks by pair, and what each merge makes."""
        ids = self.vocab
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            self.ranks.setdefault(ids[left] << 20 | ids[right], rank)
            self.merged.append(ids[left + right])

    def merge(self, parts: list[int]) -> list[int]:
        """The rank array: parts lie between boundaries, ranks[i] belongs to the boundary after part i."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(new << 20 | parts[i + 1], _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for long words: (rank, place) in a heap over linked parts."""
        rank_of, merged, n = self.ranks.get, self.merged, len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = merged[rank], False
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank_of(parts[i] << 20 | parts[k], _NONE)) < _NONE:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := rank_of(parts[h] << 20 | parts[i], _NONE)) < _NONE:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p, ok in zip(parts, alive) if ok]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of the splitter; no merge leaves a piece."""
        letters = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.latin)
        return array("I", self.merge_letters(letters)).tobytes()

    def merge_letters(self, letters: str) -> list[int]:
        parts = [self.vocab[c] for c in letters[:-1]]
        return self.merge([*parts, self.vocab[letters[-1] + self.suffix]])

    def spell(self, word: str) -> bytes:
        """Ids of a word of plain letters, which is one piece, at byte level with the blank before it."""
        letters = (word if self.by_word else word.replace(" ", self.blank)) if word.isascii() else word.encode().decode("latin-1").translate(self.latin)
        return array("I", self.merge_letters(letters)).tobytes()

    def encode_word(self, word: str) -> bytes:
        """Ids of what lies between two places where no piece of the splitter can go on.

        By word: what stands between white space. Byte level: what lies between
        two cuts, white space before a word included.
        """
        if not self.by_word and "<|" in word and self.special and self.special.search(word):
            return self._whole(word)
        known = self.known
        return b"".join([known[p] for p in self.pieces(word)])

    def learn(self, wanted: set[str]) -> list[str]:
        """Puts the ids of all wanted words into ``words``; if these are many, what isn't wanted now goes. Returns those too long to stay."""
        missing = wanted.difference(self.words)
        if len(self.words) + len(missing) > self.most_words:
            self.words = {w: ids for w in wanted if (ids := self.words.get(w)) is not None}
        words, spell, long = self.words, self.spell, []
        for word in missing:
            words[word] = spell(word) if word.isalpha() and (word.isascii() or max(word) < LAST_PLAIN) else self.encode_word(word)
            if len(word) > SHORT:
                long.append(word)
        return long

    def learn_spaced(self, wanted: list[str]) -> list[bytes]:
        """The ids of distinct words that may begin with white space; those not too long go to ``words`` as in ``learn``."""
        found = [*map(self.words.get, wanted)]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(self.words) + len(missing) > self.most_words:
            self.words = {w: ids for w, ids in zip(wanted, found) if ids is not None}
        words, spell = self.words, self.spell
        for i in missing:
            word = wanted[i]
            bare = word[1:] if word[0] == " " else word
            found[i] = ids = spell(word) if bare.isalpha() and (bare.isascii() or max(bare) < LAST_PLAIN) else self.encode_word(word)
            if len(word) <= SHORT:
                words[word] = ids
        return found

    def split(self, text: str) -> list[str] | None:
        """The words of a text, by word; None where words don't tell the pieces."""
        if "<|" in text and self.special and self.special.search(text):
            return None
        text = lower(text if text.isascii() else unicodedata.normalize("NFC", text))
        return None if _ODD_SPACE.search(text) else _MARK.sub(r" \1", text).split()

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; each distinct word of a block of words is looked for once."""
        if not self.by_word:
            ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
            return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        data, block, held = [], [], 0

        def end_block() -> None:
            long = self.learn(set().union(*(w for _, w in block)))
            words = self.words.__getitem__
            for i, w in block:
                data[i].append(b"".join(map(words, w)))
            for word in long:
                del self.words[word]
            block.clear()

        for i, text in enumerate(texts):
            words = self.split(text) if text else []
            data.append([self._whole(text)] if words is None else [])
            for at in range(0, len(words or ()), BLOCK):
                block.append((i, words[at : at + BLOCK]))
                held += len(block[-1][1])
                if held >= BLOCK:
                    end_block()
                    held = 0
        end_block()
        return [np.frombuffer(b"".join(x), np.uint32) for x in data]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and where each text's end.

        At byte level the texts stay bytes: words lie between cuts, and only the
        distinct ones of a block become strings.
        """
        if self.by_word:
            rows = self.encode_many(texts.to_pylist())
            return np.concatenate([np.empty(0, np.uint32), *rows]), np.cumsum([len(r) for r in rows], dtype=np.int64)
        if texts.null_count:
            texts = texts.fill_null("")
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        narrow, n = pa.types.is_string(texts.type), len(texts)
        _, offsets, letters = texts.buffers()
        if not n or letters is None:
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        offsets = np.frombuffer(offsets, np.int32 if narrow else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
        letters = letters.slice(offsets[0], offsets[-1] - offsets[0])
        places, data = offsets[1:] - offsets[0], np.frombuffer(letters, np.uint8)
        out, ends, total, begin, held = [np.empty(0, np.uint32)], np.zeros(n, np.int64), 0, 0, []
        for first in range(0, len(data), BLOCK_BYTES):
            last = min(first + BLOCK_BYTES, len(data))
            found = cuts(data, places, first, last)
            bounds = np.concatenate([[begin], found[found > begin], [last] if last == len(data) else np.empty(0, np.int64)]).astype(np.int64)
            if len(bounds) < 2:
                continue
            ids, counted = self.encode_words(letters, bounds)
            a, b = np.searchsorted(places, (begin, bounds[-1]), "right")
            ends[a:b] = total + counted[np.searchsorted(bounds, places[a:b])]
            out.append(ids)
            total, begin = total + len(ids), int(bounds[-1])
        return np.concatenate(out), ends

    def encode_words(self, letters: pa.Buffer, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words between the bounds, and how many come before each bound."""
        offsets = (bounds - bounds[0]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), letters.slice(int(bounds[0]))).dictionary_encode()
        data = self.learn_spaced(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, counted, ids = pa.array(data, pa.large_binary()).take(words.indices).buffers()
        counted = np.frombuffer(counted, np.int64)[: len(bounds)] >> 2
        return np.frombuffer(ids, np.uint32)[: counted[-1]], counted

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def _whole(self, text: str) -> bytes:
        """A text with special tokens or unusual white space, piece by piece."""
        runs = self.special.split(text) if self.special and self.special.search(text) else [text]
        data = []
        for i, run in enumerate(runs):
            if i % 2:
                data.append(np.uint32(self.specials[run]).tobytes())
                continue
            if self.by_word:
                run = lower(run if run.isascii() else unicodedata.normalize("NFC", run))
            data += [self.known[p] for p in self.pieces(run)]
        return b"".join(data)

    def decode(self, ids) -> str:
        names = self.names
        if not self.byte_decoder:
            return " ".join([names[i] for i in ids])
        out, special = bytearray(), set(self.specials.values())
        for i in ids:
            name = names[i]
            out += name.encode() if i in special else bytes(self.bytes_of[c] for c in name)
        return out.decode("utf-8", "replace")


class LibraryCodec(Codec):
    """The same codec with the merges done by the tokenizers library's model."""

    def prepare(self, path: str, merges: list) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def merge_letters(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def spell(self, word: str) -> bytes:
        letters = (word if self.by_word else word.replace(" ", self.blank)) if word.isascii() else word.encode().decode("latin-1").translate(self.latin)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@functools.lru_cache(maxsize=1)
def library_codec(path: str, words: int = WORDS) -> LibraryCodec:
    """words: bytes that the memory of words may take in a worker."""
    made = LibraryCodec(path)
    made.most_words = words // ENTRY
    return made


def encode(df: DataFrame, path: str, *, text_col: str = "text", out_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but the text) and the ids of each whole text."""

    def run(columns):
        own = codec(path)
        rows = own.encode_many(columns[0].to_pylist())
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))]

    carry = [c for c in (carry or df.columns) if c not in (text_col, out_col)]
    return map_batches(df, carry, [F.col(text_col)], run, {out_col: "array<int>"})


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) and the text that the ids spell."""

    def run(columns):
        own, ids = codec(path), columns[0]
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
        return [pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())]

    carry = [c for c in (carry or df.columns) if c != out_col]
    return map_batches(df, carry, [F.coalesce(F.col(ids_col), F.array().cast("array<int>"))], run, {out_col: "string"})


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path).withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", " "), 256)}
    )
    texts = decode(ids, path, carry=["doc_id", "n_tokens", "ids_sha256"])
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
