"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can come last in its encoding. A suffix automaton (Aho-Corasick over
the vocabulary) lists the tokens that end at each position; the one whose pairing with the last token of the
remaining prefix is stable under the merges is stored, and back-pointers from the end give the ids. No merge loop
runs over the word, so a word of any length costs its matches only.

A pair of tokens is stable if undoing the merges of both, latest first, never shows a merge across their border
that would have come earlier.

Vocabulary files are those of the tokenizers library (word ends marked by a suffix); the path is a parameter.
Many words are encoded together in numpy: all take one step of the automaton, and the prefixes that end there are
settled, then the next. Texts are split at spaces in Arrow, and each distinct run of other characters is encoded once
a stretch of texts; a worker keeps nothing but a table of pairs of fixed size.

Defined results: null text is the empty text; it has no tokens and decodes to the empty string. Long texts are
handled whole. Rows that repeat give rows that repeat, an empty table an empty result, other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import text_chunks
from .shared import table, tidy, tidy_after

VOCABULARY = "word_bpe_49k.json"
CELLS = 1 << 20  # of the tables of transitions and of pairs
STRETCH = 1 << 22  # bytes of text that are split and encoded together
#: ASCII marks of which any run is one word of the vocabulary's pattern (the apostrophe and the digits aren't among them).
MARKS = re.escape('!"#$%&()*+,-./:;<=>?@[]^_`{|}~') + "\\\\"
#: White_Space of Unicode, which the vocabulary's normaliser squeezes.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, tail = spec["model"], spec["model"]["end_of_word_suffix"]
        names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.odd = re.compile("|".join([*map(re.escape, self.special), "[\x1c-\x1f]"]).encode()).search
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.chunks = re.compile(f"[^{SPACE}]+").findall
        # Symbols: chr(byte) inside a word, chr(256 + byte) at its end.
        text, byte = {}, byte_chars()
        for name, i in model["vocab"].items():
            if name in byte:
                text[i] = chr(byte[name])
            elif name.endswith(tail) and name[: -len(tail)] in byte:
                text[i] = chr(256 + byte[name[: -len(tail)]])
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[tuple[int, int], int] = {}  # rank of the merge of a pair
        self.rank = dict.fromkeys(text, -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = (model["vocab"][x] for x in (left, right, left + right))
            self.born[a, b] = rank
            if c not in self.parts and c not in self.rank:
                self.parts[c], self.rank[c], text[c] = (a, b), rank, text[a] + text[b]
        self.whole: dict[int, bool] = {}
        self._automaton({i: t for i, t in text.items() if self.is_whole(i)})
        self.whole.clear()
        # The same tables as arrays, for many words at a time.
        self.ranks = np.full(len(self.names), -1, np.int64)
        self.left, self.right = np.zeros((2, len(self.names)), np.int64)
        for i in text:
            self.ranks[i] = self.rank[i]
        for i, (a, b) in self.parts.items():
            self.left[i], self.right[i] = a, b
        pairs = np.array([(a << 20 | b, r) for (a, b), r in self.born.items()], np.int64).reshape(-1, 2)
        self.pairs, self.pair_rank = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.tried, self.held = np.full(CELLS, -1, np.int64), np.zeros(CELLS, bool)
        newer: set[str] = set()
        for a in range(0, 0x110000, 0x800):
            if a != 0xD800:  # surrogates
                newer.update(c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(a, a + 0x800)))) if unicodedata.category(c) == "Cn")
        self.newer = frozenset(newer)
        self.path, self.library = path, None
        self.parts = self.rank = self.born = None  # the arrays have it all
        del spec, model, names, text, pairs
        tidy()

    def _automaton(self, tokens: dict[int, str]) -> None:
        """Aho-Corasick over the tokens: nodes of a trie, the longest proper suffix that is a node too, and the next token that ends there."""
        goto: dict[int, int] = {}
        depth, token, parent = [0], [-1], [0]
        for i, t in tokens.items():
            node = 0
            for symbol in map(ord, t):
                after = goto.setdefault(node << 9 | symbol, len(depth))
                if after == len(depth):
                    depth.append(depth[node] + 1)
                    token.append(-1)
                    parent.append(node)
                node = after
            token[node] = i
        self.depth, self.token = np.array(depth, np.int64), np.array(token, np.int64)
        keys, nodes = np.array(list(goto), np.int64), np.array(list(goto.values()), np.int64)
        # Transitions in a hash table with open addressing.
        self.keys, self.nodes = np.full(CELLS, -1, np.int64), np.zeros(CELLS, np.int32)
        cell, left = self._cell(keys), np.arange(len(keys))
        while len(left):
            spot = cell[left]
            free = self.keys[spot] < 0
            self.keys[spot[free]] = keys[left[free]]
            put = self.keys[spot] == keys[left]
            self.nodes[spot[put]] = nodes[left[put]]
            left = left[~put]
            cell[left] = (cell[left] + 1) & (CELLS - 1)
        self.fail, self.ends = np.zeros((2, len(depth)), np.int64)
        by = np.argsort(self.depth[nodes], kind="stable")
        for level in range(1, max(depth) + 1):
            own = by[self.depth[nodes[by]] == level]
            node = nodes[own]
            if level > 1:
                self.fail[node] = self._step(self.fail[np.array(parent)[node]], keys[own] & 511)
            self.ends[node] = np.where(self.token[node] >= 0, node, self.ends[self.fail[node]])
        self.after = self.ends[self.fail]  # the next shorter token that ends at a node

    @staticmethod
    def _cell(key: np.ndarray) -> np.ndarray:
        return (key ^ key >> 17) * 0x2545F491 & (CELLS - 1)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state of each word after one more symbol."""
        out, at = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(at):
            key = state << 9 | symbol
            cell = self._cell(key)
            met = self.keys[cell]
            while len(clash := np.flatnonzero((met != key) & (met >= 0))):
                cell[clash] = (cell[clash] + 1) & (CELLS - 1)
                met[clash] = self.keys[cell[clash]]
            found = met == key
            out[at[found]] = self.nodes[cell[found]]
            go = ~found & (state > 0)
            state, symbol, at = self.fail[state[go]], symbol[go], at[go]
        return out

    def _stable(self, a: int, b: int, before: int) -> bool:
        """Whether nothing merges across the border of a and b before the given rank and before their own merges."""
        rank, parts, born = self.rank, self.parts, self.born
        while True:
            merge = born.get((a, b))
            if merge is not None and merge < before:
                return False
            # Undo the later merge; of equal ranks, the one on the right came later.
            if rank[a] > rank[b]:
                before, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def is_whole(self, token: int) -> bool:
        """Whether the merges turn the token's own text into this token."""
        known = self.whole.get(token)
        if known is None:
            a, b = self.parts.get(token, (None, None))
            known = a is None or self.is_whole(a) and self.is_whole(b) and self._stable(a, b, self.rank[token])
            self.whole[token] = known
        return known

    def _unstable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stable, negated, for many pairs: each step undoes one merge of every pair that is still open."""
        out = np.zeros(len(a), bool)
        at, before = np.arange(len(a)), np.full(len(a), len(self.pairs) + 1)
        while len(at):
            key = a << 20 | b
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            met = (self.pairs[spot] == key) & (self.pair_rank[spot] < before)
            out[at[met]] = True
            one, two = self.ranks[a], self.ranks[b]
            of_a = one > two
            go = ~met & (of_a | (two >= 0))
            before = np.where(of_a, one, two + 1)[go]
            a, b, at = np.where(of_a, self.right[a], a)[go], np.where(of_a, b, self.left[b])[go], at[go]
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair may stand side by side; a table of fixed size keeps what was found last."""
        key = a << 20 | b
        cell = self._cell(key)
        new = np.flatnonzero(self.tried[cell] != key)
        out = self.held[cell]
        if len(new):
            out[new] = ~self._unstable(a[new], b[new])
            self.tried[cell[new]], self.held[cell[new]] = key[new], out[new]
        return out

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (bytes one after the other) in a row, and how many each has.

        All words take a step of the automaton together, the longest first in the order, so that the unfinished ones stay in front.
        """
        counts = np.zeros(len(sizes), np.int64)
        ends = np.cumsum(sizes)
        if not len(data):
            return np.zeros(0, np.int64), counts
        symbols = data.astype(np.int64)
        symbols[ends[sizes > 0] - 1] += 256
        last = np.full(len(data), -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, longest = (ends - sizes)[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        for t in range(int(longest[0])):
            n = int(np.searchsorted(-longest, -t))
            state = self._step(state[:n], symbols[begin[:n] + t])
            at, node = begin[:n], self.ends[state]
            while len(at):  # tokens that end here, longest first, until one goes with what is before it
                some = node > 0
                at, node = at[some], node[some]
                token, start = self.token[node], t + 1 - self.depth[node]
                good = start == 0
                rest = np.flatnonzero(~good)
                before = last[at[rest] + start[rest] - 1]
                rest, before = rest[before >= 0], before[before >= 0]
                good[rest] = self.stable(before, token[rest])
                last[at[good] + t] = token[good]
                at, node = at[~good], self.after[node[~good]]
        chosen = np.zeros(len(data), bool)
        size_of = np.zeros(len(self.names), np.int64)
        size_of[self.token[self.token >= 0]] = self.depth[self.token >= 0]
        at, low = ends[sizes > 0] - 1, (ends - sizes)[sizes > 0]
        while len(at):
            chosen[at] = True
            at = at - size_of[last[at]]
            at, low = at[at >= low], low[at >= low]
        total = np.concatenate([[0], np.cumsum(chosen)])
        return last[chosen], total[ends] - total[ends - sizes]

    def encode_word(self, data: bytes) -> list[int]:
        return self.encode_words(np.frombuffer(data, np.uint8), np.array([len(data)]))[0].tolist()

    def _pieces(self, chunk: str) -> list[str] | list[int]:
        """The words of a run of non-space characters, as the model meets them; ids where only the library knows them."""
        if not chunk.isascii():
            if not self.newer.isdisjoint(chunk):
                return self._by_library(chunk)
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        text = chunk.lower()
        if text.isalpha():
            return [text]
        if text[-1:] in ".,;:!?" and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.words.findall(text)

    def _by_library(self, chunk: str) -> list[int]:
        """Letters that Python's Unicode tables don't know yet: only the library has the case and class it gives them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(chunk, add_special_tokens=False).ids

    def encode_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): the ids of all chunks, and where each one's begin and how many they are."""
        # ASCII letters, and perhaps marks behind them, are words as they stand; the others are looked at one by one.
        plain = pc.match_substring_regex(chunks, f"^[A-Za-z]+[{MARKS}]*$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        cut = pc.extract_regex(pc.ascii_lower(chunks.filter(plain)), f"^(?P<word>[a-z]+)(?P<marks>[{MARKS}]*)$")
        pieces, many, known = [], [], {}
        for k, chunk in enumerate(chunks.filter(pc.invert(plain)).to_pylist()):
            own = self._pieces(chunk)
            if own and not isinstance(own[0], str):
                known[k], own = own, []
            many.append(len(own))
            pieces += own
        n = len(cut)
        turn = pa.array(np.stack([np.arange(n), n + np.arange(n)], axis=1).reshape(-1))  # word, marks, word, marks, ...
        words = pa.concat_arrays([pa.concat_arrays([cut.field("word"), cut.field("marks")]).take(turn), pa.array(pieces, pa.string())])
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ids, counts = self.encode_words(data, np.diff(offsets))
        total = np.concatenate([[0], np.cumsum(counts)])
        first, until = np.empty((2, len(chunks)), np.int64)
        first[is_plain], until[is_plain] = total[: 2 * n : 2], total[2 : 2 * n + 1 : 2]
        spot = 2 * n + np.concatenate([[0], np.cumsum(np.array(many, np.int64))])
        first[~is_plain], until[~is_plain] = total[spot[:-1]], total[spot[1:]]
        others, at = np.flatnonzero(~is_plain), len(ids)
        for k, own in known.items():
            first[others[k]], until[others[k]] = at, at + len(own)
            at += len(own)
        return np.concatenate([ids, *map(np.array, known.values())]).astype("<u4"), first, until - first

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words."""
        out = []
        for part in self.split_special.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(pack([self.special[part]]))
            elif chunks := self.chunks(part):
                out.append(self.gathered(pa.array(chunks, pa.string()).dictionary_encode())[0].tobytes())
        return b"".join(out)

    def gathered(self, chunks: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        ids, first, count = self.encode_chunks(chunks.dictionary)
        own = chunks.indices.to_numpy(zero_copy_only=False)
        many = count[own]
        ends = np.cumsum(many)
        return ids[np.arange(int(many.sum())) + np.repeat(first[own] - (ends - many), many)], many

    def packed_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each one's end. Each distinct chunk is encoded once."""
        column = pa.array(texts, pa.binary()).cast(pa.string())
        lists = pc.utf8_split_whitespace(column)
        values, many = self.gathered(lists.flatten().dictionary_encode())
        ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        joined = b"".join(texts)
        odd = [k for k, t in enumerate(texts) if self.odd(t)] if (np.frombuffer(joined, np.uint8) - np.uint8(28) < 4).any() or any(x.encode() in joined for x in self.special) else []
        if odd:  # special tokens, or spaces that the vocabulary doesn't take as such
            parts = np.split(values, ends[:-1])
            for k in odd:
                parts[k] = np.frombuffer(self.packed(texts[k].decode()), "<u4")
            values, ends = np.concatenate(parts), np.cumsum(list(map(len, parts)))
        return values, ends

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by spaces, as a vocabulary without a decoder is decoded."""
        return " ".join([self.names[i] for i in ids])


def joined_digests(words: pa.BinaryArray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each text's words, each of which ends in a space, without the last space."""
    if not len(words):
        return [hashlib.sha256().hexdigest()] * (len(ends) - 1)
    offsets, data = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset), memoryview(words.buffers()[2])
    spots = offsets[ends].tolist()
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(spots[:-1], spots[1:], strict=True)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker and vocabulary file; by default the word vocabulary of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Encoder(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Rows (id_col, ids, decoded): the ids of every whole text, and the text that they decode to."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for at, texts in text_chunks(batch, 1, STRETCH):
                values, ends = e.packed_texts(texts)
                ids = np.split(values.astype(np.int32), ends[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(e.decode, ids), pa.string())], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Rows (id_col, n_tokens, ids_sha256, decoded_sha256), without moving ids between Python and the JVM."""

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        numbers = pa.array([f"{i} " for i in range(len(e.names))], pa.binary())
        names = pa.array([f"{n} ".encode() for n in e.names], pa.binary())
        for batch in batches:
            for at, texts in text_chunks(batch, 1, STRETCH):
                values, ends = e.packed_texts(texts)
                ends = np.concatenate([[0], ends])
                ids, decoded = (joined_digests(words.take(pa.array(values)), ends) for words in (numbers, names))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.diff(ends), pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
