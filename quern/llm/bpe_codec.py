"""Byte-level BPE encoding and decoding, the merges found by a segment tree.

The leaves of the tree are the ranks of the adjacent pairs of a word, each with
its place; a node holds the least of its children, so the root is the leftmost
pair of the lowest rank. A merge changes three leaves, each with a logarithmic
update, until the root says that no pair can be merged. A word of n bytes takes
O(n log n), also where it has a million.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_texts

#: Bytes of words, and of segments between spaces, whose ids a worker remembers: in two generations, of which the older goes when the younger is full.
REMEMBERED_BYTES = 64 << 20
#: Longest word or segment, in characters, that is remembered, and what an entry takes beside its text and ids.
SHORT, ENTRY_BYTES = 100, 220
#: Marks that often follow a word.
MARKS = tuple(".,;:!?")
#: Bytes of text that are encoded together.
CODEC_BYTES = 2 << 20
#: Characters that are split into words at a time.
PIECE_CHARS = 1 << 16
#: Trees that are advanced together, few enough to stay in a CPU's cache.
TOGETHER = 4096
#: Longest word, in bytes, that is merged beside others of its size.
BESIDE = 64

# Fixed value: how the byte-level pre-tokenizer of this vocabulary splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def merge_all(ids: list[int], ranks: dict[int, int]) -> list[int]:
    """Merges the leftmost pair of the lowest rank until there is none.

    ranks: rank << 20 | merged id, by left id << 20 | right id.
    """
    n = len(ids)
    if n < 2:
        return ids
    size = 1
    while size < n - 1:
        size *= 2
    place_bits = n.bit_length()
    none = 1 << 200
    tree = [none] * (2 * size)
    get, place_mask = ranks.get, (1 << place_bits) - 1

    def leaf(i: int, a: int, b: int) -> int:
        found = get(a << 20 | b)
        return none if found is None else (found >> 20 << place_bits | i) << 20 | found & 0xFFFFF

    for i in range(n - 1):
        tree[size + i] = leaf(i, ids[i], ids[i + 1])
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == none:
        return ids

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                break
            tree[k] = a

    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != none:
        i = root >> 20 & place_mask
        gone = after[i]
        ids[i] = root & 0xFFFFF
        after[i] = then = after[gone]
        ids[gone] = -1
        if gone < n - 1:
            put(gone, none)
        if then < n:
            before[then] = i
            put(i, leaf(i, ids[i], ids[then]))
        else:
            put(i, none)
        if i:
            p = before[i]
            put(p, leaf(p, ids[p], ids[i]))
    return [x for x in ids if x >= 0]


class Pairs:
    """Looks up many pairs at once: a hash table of the ranks with linear probing."""

    def __init__(self, ranks: dict[int, int]) -> None:
        keys = np.fromiter(ranks, np.int64, len(ranks))
        values = np.fromiter(ranks.values(), np.int64, len(ranks))
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        at, out = self.slot(keys), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != -1)
            left, keys, at = left[on], keys[on], (at[on] + 1) & self.mask
        return out


def merge_beside(words: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """merge_all() for many words of at most BESIDE bytes, a segment tree for each, advanced together."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    size = 2
    while size <= BESIDE:
        sized = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
        for at in range(0, len(sized), TOGETHER):
            rows = sized[at : at + TOGETHER]
            raw = np.frombuffer(b"".join(words[r].ljust(size, b"\0") for r in rows), np.uint8).reshape(-1, size)
            ids = merge_rows(byte_ids[raw], lengths[rows], size, pairs)
            kept = ids >= 0
            flat, ends = ids[kept].astype("<i4").tobytes(), np.cumsum(kept.sum(1)) * 4
            start = 0
            for r, end in zip(rows.tolist(), ends.tolist(), strict=True):
                out[r] = flat[start:end]
                start = end
        size *= 2
    return out


def merge_rows(ids: np.ndarray, lengths: np.ndarray, size: int, pairs: Pairs) -> np.ndarray:
    """ids: a row for each word, of which ``lengths`` count. Returns them merged, -1 where nothing stands any more."""
    n, none = len(ids), np.int64(1 << 62)
    place = np.arange(size)
    ids = np.where(place < lengths[:, None], ids, -1).astype(np.int64)
    place_bits = size.bit_length()

    def leaves(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = pairs.get(a << 20 | b)
        return np.where(found < 0, none, ((found >> 20) << place_bits | at) << 20 | found & 0xFFFFF)

    tree = np.full((n, 2 * size), none)
    row, col = np.nonzero(place[:-1] < lengths[:, None] - 1)
    tree[row, size + col] = leaves(ids[row, col], ids[row, col + 1], col)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))

    def put(rows: np.ndarray, at: np.ndarray, values) -> None:
        k = size + at
        tree[rows, k] = values
        while k[0] > 1:  # all leaves are equally deep
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    rows = np.flatnonzero(tree[:, 1] != none)
    while len(rows):
        root = tree[rows, 1]
        i, new = root >> 20 & ((1 << place_bits) - 1), root & 0xFFFFF
        gone = after[rows, i]
        then = after[rows, gone]
        ids[rows, i], ids[rows, gone], after[rows, i] = new, -1, then
        put(rows, gone, none)
        has = then < lengths[rows]
        value = np.full(len(rows), none)
        if has.any():
            before[rows[has], then[has]] = i[has]
            value[has] = leaves(new[has], ids[rows[has], then[has]], i[has])
        put(rows, i, value)
        if (has := i > 0).any():
            r, p = rows[has], before[rows[has], i[has]]
            put(r, p, leaves(ids[r, p], new[has], p))
        rows = rows[tree[rows, 1] != none]
    return ids


class Codec:
    """A vocabulary in the .json form of the tokenizers library, byte-level BPE without a normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre, model = config["pre_tokenizer"], config["model"]
        if config["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only a byte-level BPE without normaliser and prefix space can be read")
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.byte_array, self.pairs = np.array(self.byte_ids), Pairs(self.ranks)
        byte_of = {c: i for i, c in enumerate(letters)}
        of_id: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.added: dict[str, int] = {x["content"]: x["id"] for x in config["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in config["added_tokens"]):
            raise ValueError("added tokens that take in what is around them can't be read")
        of_id |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(PATTERN).findall
        self.marks = {c: np.array([self.byte_ids[ord(c)]], "<i4").tobytes() for c in MARKS}
        self.unsafe = regex.compile(r" (?:\s|$)").search
        self.inner_space = regex.compile(r"(?<=\S) (?=\S)").search if not any(" " in x for x in self.added) else lambda text, at: None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0
        table = [of_id.get(i, b"") for i in range(max(of_id) + 2)]  # the last has none
        self.nothing = len(table) - 1
        self.raw, self.sizes = np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table))

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        short = [i for i, x in enumerate(raw) if len(x) <= BESIDE]
        out = dict(zip([words[i] for i in short], merge_beside([raw[i] for i in short], self.byte_array, self.pairs), strict=True))
        if len(short) < len(raw):
            for w, x in zip(words, raw, strict=True):
                if len(x) > BESIDE:
                    out[w] = np.array(merge_all([self.byte_ids[b] for b in x], self.ranks), dtype="<i4").tobytes()
        return out

    def pieces(self, text: str) -> list[str]:
        """A long text cut at single spaces between characters that are no white space, where a word always starts."""
        out, start = [], 0
        while len(text) - start > PIECE_CHARS and (found := self.inner_space(text, start + PIECE_CHARS)):
            out.append(text[start : found.start()])
            start = found.start()
        return [*out, text[start:]]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end.

        A single space between two characters that are no white space always starts a
        word, so texts are cut there, as arrays; a segment that occurs again costs a
        number. A text with other white space around a space, or with the string of an
        added token, is split by the pattern piece by piece.
        """
        plain = [not self.unsafe(x) and not any(a in x for a in self.added) for x in texts]
        flat, ends = self.encode_plain([x for x, p in zip(texts, plain, strict=True) if p])
        if all(plain):
            return flat, ends
        cut = iter(np.split(flat, ends[:-1]))
        found = [next(cut) if p else self.encode_odd(x) for x, p in zip(texts, plain, strict=True)]
        return np.concatenate(found), np.cumsum([len(x) for x in found])

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = np.asarray(split.offsets)
        numbered = pc.dictionary_encode(split.flatten())
        number, first = np.asarray(numbered.indices), offsets[:-1]
        inner = np.ones(len(number), bool)
        inner[first] = False
        # a text's first segment has no space before it
        occurring = np.bincount(number[inner], minlength=len(numbered.dictionary)) > 0
        segments = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), numbered.dictionary.filter(pa.array(occurring)), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = self.ids_of(segments + numbered.dictionary.take(pa.array(number[first])).to_pylist())
        entry = (np.cumsum(occurring) - 1)[number]
        entry[first] = len(segments) + np.arange(len(first))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, lengths = gathered(np.frombuffer(b"".join(ids), "<i4"), sizes, entry)
        return flat, np.cumsum(lengths)[offsets[1:] - 1]

    def encode_odd(self, text: str) -> np.ndarray:
        out = []
        for i, x in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if i % 2:
                out.append(np.array([self.added[x]], dtype="<i4").tobytes())
            else:
                for piece in self.pieces(x):
                    out += self.ids_of(self.words(piece))
        return np.frombuffer(b"".join(out), "<i4")

    def ids_of(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, which begins and ends where words do, as little-endian 32-bit integers."""
        memo, older = self.memo, self.older
        found = list(map(memo.get, segments))
        new = {x for x, f in zip(segments, found, strict=True) if f is None}
        known = {x: older[x] for x in new if x in older} if older else {}
        # a space and letters of ASCII are one word, a mark after them is another; the rest is split by the pattern
        single, marked, rest = [], [], []
        for x in new.difference(known):
            if x.isascii() and x[1:].isalpha() and (x[0] == " " or x[0].isalpha()):
                single.append(x)
            elif x[-1:] in MARKS and x.isascii() and x[1:-1].isalpha() and (x[0] == " " or x[0].isalpha()):
                marked.append(x)
            else:
                rest.append(x)
        cut = [(x, self.words(x)) for x in rest]
        inner = {w for _, words in cut for w in words if w not in memo and w not in known}
        inner.update(single)
        inner.update([w for x in marked if (w := x[:-1]) not in memo])
        known |= {w: older[w] for w in inner if w in older} if older else {}
        fresh = self.merged([w for w in inner if w not in known]) | known
        for x, words in cut:
            if len(words) != 1:
                fresh[x] = b"".join([memo[w] if w in memo else fresh[w] for w in words])
        kept = {x: ids for x, ids in fresh.items() if len(x) < SHORT}
        for x in marked:  # put together anew each time, so that they take no memory from words
            w = x[:-1]
            fresh[x] = (memo[w] if w in memo else fresh[w]) + self.marks[x[-1]]
        size = ENTRY_BYTES * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.memo_bytes + size > REMEMBERED_BYTES // 2:
            self.older, self.memo, self.memo_bytes = memo, {}, 0
        if size <= REMEMBERED_BYTES // 2:
            self.memo.update(kept)
            self.memo_bytes += size
        return [fresh[x] if f is None else f for x, f in zip(segments, found, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].astype("<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """Unknown ids give nothing; bytes that are no UTF-8 give U+FFFD."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids that ends at ``ends``."""
        there = (flat >= 0) & (flat < len(self.sizes))
        raw, lengths = gathered(self.raw, self.sizes, np.where(there, flat, self.nothing))
        stops = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])].tolist()
        data = raw.tobytes()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(stops, stops[1:], strict=False)]


def gathered(values: np.ndarray, sizes: np.ndarray, entries: np.ndarray, together: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The values of the entries one after the other, where entry i has sizes[i] of them; and the size of each.

    Places are made for some entries at a time, as they take more than the values.
    """
    lengths, firsts = sizes[entries], np.cumsum(sizes) - sizes
    parts = [values[:0]]
    for at in range(0, len(entries), together):
        n = lengths[at : at + together]
        starts = firsts[entries[at : at + together]] - (np.cumsum(n) - n)
        parts.append(values[np.repeat(starts, n) + np.arange(int(n.sum()))])
    return np.concatenate(parts), lengths


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def ids_array(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the array of token ids of each whole text; a null text gives no ids.

    keep: the columns to return beside it (all others by default, ``out`` replaced if
    it is there). Strings of added tokens inside a text give their ids. No shuffle:
    a text is encoded where it was read. Repeated rows give equal rows, an empty
    table an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]

    def make():
        codec = load(tokenizer)
        return lambda texts: [ids_array(*codec.encode_all(texts))]

    return map_texts(docs, keep, text_col, [field(out, T.ArrayType(T.IntegerType()))], make, CODEC_BYTES)


def round_trip(docs: DataFrame, tokenizer: str, *, text_col: str = "text", out: str = "ids", decoded: str | None = "decoded", same: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass: adds ``out``, the ids of each text, ``decoded``, the text of those ids, and ``same``, whether that is the text (null: the empty one).

    Ids are decoded beside their text by the worker that made them, so one worker with
    one vocabulary serves both; with ``decoded`` None the decoded text doesn't leave it,
    with ``same`` None nothing is compared. Nulls, empty texts and ``keep`` as in encode().
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out, decoded, same)]
    fields = [field(out, T.ArrayType(T.IntegerType()))]
    fields += [field(decoded, T.StringType())] if decoded else []
    fields += [field(same, T.BooleanType())] if same else []

    def make():
        codec = load(tokenizer)

        def apply(texts):
            flat, ends = codec.encode_all(texts)
            back = codec.decode_all(flat, ends)
            made = [ids_array(flat, ends)]
            made += [pa.array(back, pa.string())] if decoded else []
            made += [pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())] if same else []
            return made

        return apply

    return map_texts(docs, keep, text_col, fields, make, CODEC_BYTES)


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the text of each array of ids; null and empty arrays give the empty text, null ids nothing."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [field(out, T.StringType())])

    def work(batches):
        codec = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("__ids")
                values, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))
                if values.dtype.kind == "f":  # null ids among them
                    values = np.nan_to_num(values, nan=-1)
                texts = codec.decode_all(values.astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(work, schema)
